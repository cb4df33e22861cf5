"""Packing and WARC bundles: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest import AWKWARD
from levelwise.llm import packing, warc

rng = random.Random(8)
PATH = packing.tokenizer_file()


def test_ids_are_those_of_the_tokenizer():
    plain, words = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDE   \n\t.,!?'’\"0123456789-_éèñüßÄŸžİıŉſ×²ªΣςЖ中̱́\x01\x85\x1c"
    texts = ["".join(rng.choice(alphabet if rng.random() < 0.4 else alphabet[:34]) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += ["It's I'LL we'd o'clock", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "x" * 500, "!!. ..., word., WORD.", "Ḵ ḵ", ""]
    for text in texts:
        assert words.text(text.encode()) == np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_and_places(docs, capacity):
    rows = [(i, " ".join(f"word{rng.randint(0, 99)}" for _ in range(rng.choice((0, 1, 5, 40, 300))))) for i in range(200)] + AWKWARD
    found = packing.pack(docs(*rows), PATH, capacity).collect()
    plain = Tokenizer.from_file(PATH)
    expected = []
    for i, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((str(i), piece, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    end: dict[int, int] = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= capacity
    assert len(end) <= best_fit_decreasing([r.length for r in found], capacity)


def best_fit_decreasing(sizes: list[int], capacity: int) -> int:
    room, bins = [0] * (capacity + 1), 0
    for size in sorted(sizes, reverse=True):
        fit = next((r for r in range(size, capacity + 1) if room[r]), None)
        if fit is None:
            bins, fit = bins + 1, capacity
        else:
            room[fit] -= 1
        room[fit - size] += 1
    return bins


def optimum(sizes: list[int], capacity: int) -> int:
    """Fewest bins, by trying everything."""
    best = len(sizes)

    def place(at: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(sizes):
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + sizes[at] <= capacity:
                place(at + 1, [*bins[:i], bins[i] + sizes[at], *bins[i + 1 :]])
        place(at + 1, [*bins, sizes[at]])

    place(0, [])
    return best


def test_bins_are_complete_and_near_the_optimum():
    over = 0
    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        histogram = {s: sizes.count(s) for s in sizes}
        bins = packing.complete_bins(histogram, 20)
        used: dict[int, int] = {}
        for times, filling in bins:
            assert sum(size * n for size, n in filling) <= 20
            for size, n in filling:
                used[size] = used.get(size, 0) + n * times
        assert used == histogram
        over += sum(times for times, _ in bins) - optimum(sizes, 20)
    assert over <= 2


def test_one_length_for_all_rows(docs):
    found = packing.pack(docs(*((i, "same") for i in range(500))), PATH, 7).collect()
    assert len({(r.sequence_id, r.offset) for r in found}) == 500 and len({r.sequence_id for r in found}) == 167
    assert packing.pack(docs(), PATH).count() == 0


def test_equal_rows_are_dealt_into_buckets(docs, monkeypatch):
    monkeypatch.setattr(packing, "BUCKETS", 1)
    monkeypatch.setattr(packing, "BUCKET_PIECES", 20)
    seen = []
    plain = packing.ranked
    monkeypatch.setattr(packing, "ranked", lambda pieces, buckets: seen.append((buckets, pieces)) or plain(pieces, buckets))
    found = packing.pack(docs(*[(None, "same")] * 300, *[(7, "")] * 90).repartition(6), PATH, 16).collect()
    buckets, pieces = seen[0]
    assert buckets == 15 and pieces.select("doc_id", "task").distinct().count() > 6
    assert len({(r.sequence_id, r.offset) for r in found}) == 390 == len(found)


PAGES = "page_id long, url string, html string, digest string, bundle string"


def pages_table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def test_archives_return_what_was_written(spark):
    big, other = "ä" * 600, "b" * 1000
    rows = [(1, "http://a/", big), (2, "http://b/ c\r\nX: y", big), (3, None, other), (4, "", "b" * 999), (5, "u", "b" * 999), (6, "u", None), (7, "u", ""),
            (8, "u", big), (8, "u", big), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 60), (None, "u", big), (10, "u", other * 3000)]
    index = warc.write_bundles(pages_table(spark, rows), frame_bytes=3000)
    found = warc.scan(index).collect()
    assert len(found) == len(rows)
    sha1 = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    expected = []
    for i, _, html in rows:
        revisit = html == big and i != 8
        expected.append((str(i), len((html or "").encode()), sha1(html), "revisit" if revisit else "response", 8 if revisit else None))
    assert sorted(map(repr, expected)) == sorted(repr((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in found)
    assert {r.url for r in found if r.page_id == 2} == {"http://b/%20c%0D%0AX:%20y"} and {r.url for r in found if r.page_id == 3} == {None}
    some = warc.fetch(index.filter("page_id IN (4, 8)")).collect()
    assert sorted(r.page_id for r in some) == [4, 8, 8]


def test_archives_are_read_back_in_proportion_to_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 10_000)
    index = warc.write_bundles(pages_table(spark, [(i, "u", f"{i} " * 900) for i in range(40)]), frame_bytes=4000)
    tasks = warc.read_tasks(index)
    assert tasks >= 10 and warc.scan(index).rdd.getNumPartitions() == tasks
    assert sorted(r.page_id for r in warc.scan(index).collect()) == list(range(40))


def test_bundles_are_seekable_zstandard(spark):
    import zstandard

    index = warc.write_bundles(pages_table(spark, [(i, "u", f"page {i} " * 50) for i in range(40)]), frame_bytes=2000).collect()
    for bundle in {r.bundle for r in index}:
        store, path = warc.open_store(bundle)
        with store.open_input_file(path) as source:
            frames = warc.read_seek_table(source)
            source.seek(0)
            data = source.read()
        whole = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + n]) for a, n in frames)
        reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
        assert reader.read() == whole and len(frames) > 1  # plain readers skip the seek table
        assert {r.frame for r in index if r.bundle == bundle} == set(range(len(frames)))


def test_no_pages(spark):
    assert warc.scan(warc.write_bundles(pages_table(spark, []))).count() == 0


def test_damage_is_noticed():
    data = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").digest(), None, False, warc.DATE)
    headers, block, end = warc.parse(data)
    assert end == len(data) and warc.described(headers, block)[0] == 1
    with pytest.raises(ValueError):
        warc.described(headers, block.replace(b"payload", b"pAyload"))


def test_bins_are_searched_beyond_the_first_filling():
    units = {16: 1, 14: 1, 13: 1, 11: 1, 8: 1, 6: 3, 4: 1}
    for times in (1, 1000):
        histogram = {146 * u: n * times for u, n in units.items()}
        bins = packing.complete_bins(histogram, 4096)
        used: dict[int, int] = {}
        for n, filling in bins:
            assert sum(length * k for length, k in filling) <= 4096
            for length, k in filling:
                used[length] = used.get(length, 0) + n * k
        assert used == histogram and sum(n for n, _ in bins) == 3 * times


def test_small_packings_are_optimal():
    draw = random.Random(11)
    for _ in range(150):
        sizes = sorted((draw.randint(2, 20) for _ in range(draw.randint(1, 9))), reverse=True)
        bins = packing.complete_bins({s: sizes.count(s) for s in sizes}, 20)
        least = packing.least_sequences({s: sizes.count(s) for s in sizes}, 20)
        assert least <= optimum(sizes, 20) == sum(n for n, _ in bins)
