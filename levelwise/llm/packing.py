"""Best-fit packing of tokenised documents by bin completion.

Documents become token ids in Arrow batches; only those longer than a sequence are cut into pieces. What can be
shared out is decided by lengths alone, and there are at most ``capacity`` distinct lengths however many documents
there are. So the corpus is reduced to a histogram of lengths (a counted aggregate) and bin completion runs on it:

* best fit of the whole histogram is the first incumbent, committing the least-waste filling of the largest length over
  and over (at most ``NODES`` branches a step) the second; if the better one meets the lower bound (total length, and
  Martello and Toth's bound on what large pieces leave), it is the answer;
* else branch and bound over bins: the largest length left branches over its ``WIDTH`` best undominated fillings, each
  repeated as often as the histogram allows or half as often. A branch ends when its waste leaves no room for a
  packing with fewer sequences than the incumbent. Branches are taken by limited discrepancy (steps off the first
  choice: none, then one, then two, ...) until the bound is met, all are done or ``BRANCHES`` were visited; then the
  incumbent stands. Nothing is left out; a packing may have more sequences than the least possible number.

The plan has at most one entry per filling and length, so its size is bounded by the capacity too. Pieces of one
length are interchangeable: each gets an exact rank among its length, from counts per (length, bucket) and a rank
inside its bucket, so that a length that a third of all pieces share is never ordered in one task. A lookup of
(length, rank) in the plan gives sequence and offset; text and ids do not move again. Buckets grow with the pieces of
the commonest length, and equal rows are dealt by the task that read them.

Defined results: null text is empty text, which is one piece holding only the end id; identical rows each get their
own place; null ids stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from levelwise.llm.common import read, stage

CAPACITY = 4096
END_ID = 1
# Buckets of the pieces of one length, and pieces of a length per bucket beyond them.
BUCKETS = 256
BUCKET_PIECES = 100_000
# Branches visited per filling; a bound on work, not on documents.
NODES = 20_000
# Of the search over bins: fillings per step, branches in all, and branches per step for its fillings.
WIDTH = 8
BRANCHES = 1_000_000
STEP = 2_000
# Words remembered per Python worker.
REMEMBERED = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length int, first_rank long, per_sequence long, first_sequence long, first_offset long"


class WordIds(dict):
    """Ids of white-space separated chunks, as little-endian bytes, remembered per chunk.

    White space never reaches a token of this vocabulary, so the ids of a text are those of its chunks in order.
    Chunks of letters go straight to byte-pair merging by rank; all others go through the tokenizer itself.
    """

    # Chunks whose normal form is plain lower case: ASCII and precomposed Latin letters.
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-įĲ-ž]+")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[!-/:-@\[-`{-~]+")

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = tiktoken.Encoding(
            "words", pat_str=r"(?s).+", mergeable_ranks=_ranks(self.tokenizer), special_tokens={}
        )._core_bpe.encode_single_piece
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, chunk: bytes) -> bytes:
        if len(chunk) <= 64 and chunk.isalpha():  # bytes: ASCII letters
            ids = self.packed(self.merge(chunk.lower() + b"\xff"))
        elif chunk[-1:] in (b".", b",") and chunk[-2:-1].isalpha():  # a letter and a mark never share a part
            ids = self[chunk[:-1]] + self[chunk[-1:]]
        else:
            ids = self.packed(self.encode(chunk.decode()))
        if len(chunk) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, chunk: str) -> list[int]:
        if len(chunk) > 64 or not self.PLAIN.fullmatch(chunk) or any(s in chunk for s in self.special):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        out: list[int] = []
        for part in self.PARTS.findall(chunk.lower()):
            out += self.merge(part.encode() + b"\xff")
        return out

    def text(self, text: bytes) -> bytes:
        # Combining marks may compose with capitals only, or with small letters only; special tokens keep their case.
        if not (b"\xcc" in text or b"\xcd" in text or b"<|" in text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


def _ranks(tokenizer) -> dict[bytes, int]:
    """The vocabulary as bytes; a final 0xFF, which UTF-8 never has, stands for the word end."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {}
    for token, rank in tokenizer.get_vocab(with_added_tokens=False).items():
        if token in special:
            continue
        end = token.endswith("</w>") and token != "</w>"
        ranks[bytes(letters[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = rank
    return ranks | {b"\xff": max(ranks.values()) + 1_000_000}


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise whole documents and cut those longer than ``capacity``: ``doc_id, piece, start, length, ids_crc32``."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer_path)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                ids = memoryview(words.text(text.as_py() or b"") + end)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_filling(lengths: list[int], left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Undominated filling of ``room`` with least waste: (length, count) pairs, largest first.

    ``lengths`` holds the lengths with pieces left, descending.
    """
    best: list[tuple[int, int]] = []
    taken, rest = [], room
    for length in lengths:  # the incumbent: best fit
        if length <= rest:
            n = min(left[length], rest // length)
            taken.append((length, n))
            rest -= n * length
    best, waste, nodes = taken, rest, 0
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(0, room, ())]
    # What the lengths from a place on can fill at most.
    fill, minus = [0] * (len(lengths) + 1), [-x for x in lengths]
    for i in range(len(lengths) - 1, -1, -1):
        fill[i] = min(fill[i + 1] + lengths[i] * left[lengths[i]], room + 1)
    while stack and waste and nodes < NODES:
        at, rest, chosen = stack.pop()
        nodes += 1
        if rest < waste:
            best, waste = list(chosen), rest
            if not waste:
                break
        if rest - fill[at] >= waste:
            continue
        at = max(at, bisect_left(minus, -rest))
        if at == len(lengths) or rest - fill[at] >= waste:
            continue
        length = lengths[at]
        most = min(left[length], rest // length)
        # Fewer of this length is dominated unless smaller ones fill its place; fullest branch on top.
        for n in range(0, most + 1):
            stack.append((at + 1, rest - n * length, chosen + ((length, n),) if n else chosen))
    return best


Bins = list[tuple[int, list[tuple[int, int]]]]


def greedy_bins(histogram: dict[int, int], capacity: int, fill: Callable) -> Bins:
    """Bins that take the largest length left with the filling ``fill`` gives, as often as it goes."""
    left = {length: n for length, n in histogram.items() if n > 0}
    lengths = sorted(left, reverse=True)
    bins = []
    while lengths:
        largest = lengths[0]
        left[largest] -= 1
        usable = [x for x in lengths if left[x] and x <= capacity - largest]
        filling = {largest: 1}
        for length, n in fill(usable, left, capacity - largest):
            filling[length] = filling.get(length, 0) + n
        left[largest] += 1
        times = min(left[length] // n for length, n in filling.items())
        for length, n in filling.items():
            left[length] -= n * times
        lengths = [x for x in lengths if left[x]]
        bins.append((times, sorted(filling.items(), reverse=True)))
    return bins


def best_fit(lengths: list[int], left: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The largest lengths that fit, one after the other."""
    taken = []
    for length in lengths:
        if n := min(left[length], room // length):
            taken.append((length, n))
            room -= n * length
    return taken


def least_sequences(histogram: dict[int, int], capacity: int) -> int:
    """Lower bound on the number of sequences: the total, and Martello and Toth's L2."""
    pieces = sorted((length, n) for length, n in histogram.items() if n > 0)
    length = np.array([p[0] for p in pieces], dtype=object)
    n = np.array([p[1] for p in pieces], dtype=object)
    best = -(-int((length * n).sum()) // capacity) if pieces else 0
    half = 2 * length > capacity
    for least in {0, *(x for x in length if 2 * x <= capacity)}:
        alone = length > capacity - least
        large, small = half & ~alone, ~half & (length >= least)
        free = n[large].sum() * capacity - (n[large] * length[large]).sum()
        over = max((n[small] * length[small]).sum() - free, 0)
        best = max(best, int(n[alone].sum() + n[large].sum() - (-over // capacity)))
    return best


def undominated_fillings(lengths: list[int], left: dict[int, int], room: int, most_waste: int, budget: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], int]:
    """Up to ``WIDTH`` fillings (waste, (length, count) pairs) that leave at most ``most_waste``, and branches visited."""
    found: list[tuple[int, list[tuple[int, int]]]] = []
    fill, minus = [0] * (len(lengths) + 1), [-x for x in lengths]
    for i in range(len(lengths) - 1, -1, -1):
        fill[i] = min(fill[i + 1] + lengths[i] * left[lengths[i]], room + 1)
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(0, room, ())]
    nodes = 0
    while stack and nodes < budget:
        at, rest, chosen = stack.pop()
        nodes += 1
        at = max(at, bisect_left(minus, -rest))
        if rest - fill[at] > most_waste:
            continue
        if at == len(lengths):
            if not dominated(minus, left, rest, chosen):
                found.append((rest, list(chosen)))
                if sum(w == 0 for w, _ in found) >= WIDTH:
                    break
            continue
        length = lengths[at]
        for n in range(min(left[length], rest // length) + 1):
            stack.append((at + 1, rest - n * length, chosen + ((length, n),) if n else chosen))
    # Large pieces first among equal waste: small ones are easier to place later.
    found.sort(key=lambda f: (f[0], sum(n for _, n in f[1])))
    return found[:WIDTH], nodes


def dominated(minus: list[int], left: dict[int, int], rest: int, chosen: tuple[tuple[int, int], ...]) -> bool:
    """Whether one piece that is not in the filling could take the place of some pieces of it, or of the rest.

    ``minus`` holds the lengths left over, negated, in ascending order.
    """
    used = dict(chosen)
    sums = {0: 0}  # sum of chosen pieces -> most pieces with it
    for length, n in chosen:
        for _ in range(min(n, 4)):
            sums |= {s + length: max(k + 1, sums.get(s + length, 0)) for s, k in list(sums.items())[:64]}
    for s, k in sums.items():
        # The largest length that fits in place of these pieces and is left over.
        for at in range(bisect_left(minus, -(s + rest)), len(minus)):
            length = -minus[at]
            if length < s or length == s and k < 2:
                break
            if left[length] > used.get(length, 0):
                return True
    return False


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, branches: int = BRANCHES) -> Bins:
    """Bins for all pieces: (how often, [(length, pieces of it per bin)])."""
    least = least_sequences(histogram, capacity)
    number = lambda bins: sum(times for times, _ in bins)
    best = min((greedy_bins(histogram, capacity, fill) for fill in (best_filling, best_fit)), key=number)
    off = 0
    while number(best) > least and branches > 0:
        best, branches, whole = search(histogram, capacity, best, least, off, branches)
        if whole:
            break
        off += 1
    return best


def search(histogram: dict[int, int], capacity: int, best: Bins, least: int, off: int, branches: int) -> tuple[Bins, int, bool]:
    """Packings that leave the first choice in at most ``off`` steps; ``True`` if no branch was left for want of steps."""
    fewest, whole = sum(times for times, _ in best), True
    chain: list[tuple[int, list[tuple[int, int]]]] = []
    # A state is entered with (depth, bin that led to it, sequences, pieces left before it, steps off the first choice left).
    stack: list[tuple] = [(0, None, 0, {x: n for x, n in histogram.items() if n > 0}, off)]
    while stack and branches > 0 and fewest > least:
        depth, led, count, left, may = stack.pop()
        del chain[max(depth - 1, 0) :]
        if led:
            chain.append(led)
            left = dict(left)
            for x, n in led[1]:
                left[x] -= led[0] * n
                if not left[x]:
                    del left[x]
        if not left:
            if count < fewest:
                best, fewest = list(chain), count
            continue
        # Waste that a better packing may have from here on.
        waste = (fewest - 1 - count) * capacity - sum(x * n for x, n in left.items())
        if waste < 0:
            continue
        largest = max(left)
        own = left | {largest: left[largest] - 1}
        usable = sorted((x for x, n in own.items() if n and x <= capacity - largest), reverse=True)
        fillings, nodes = undominated_fillings(usable, own, capacity - largest, min(waste, capacity), min(STEP, branches))
        branches -= nodes + len(left)
        whole &= nodes < STEP and len(fillings) < WIDTH
        nexts = []
        for _, filling in fillings:
            taken = {largest: 1}
            for x, n in filling:
                taken[x] = taken.get(x, 0) + n
            most = min(left[x] // n for x, n in taken.items())
            whole &= most <= 2
            for times in sorted({most, (most + 1) // 2}, reverse=True):
                nexts.append((times, taken))
        for i, (times, taken) in reversed(list(enumerate(nexts))):
            if i and not may:
                whole = False
                continue
            stack.append((depth + 1, (times, sorted(taken.items(), reverse=True)), count + times, left, may - (i > 0)))
    return best, branches, whole and not stack


def plan_rows(bins: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go, by rank: rows of ``PLAN``."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in bins:
        offset = 0
        for length, n in filling:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return rows


def ranked(pieces: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` with ``rank``, exact and gapless from 0 among pieces of equal length.

    ``task``, the number of the task that wrote a piece, deals equal rows into different buckets.
    """
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "task"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = bucketed.withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(counts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("nth")).drop("bucket", "base", "nth")


def place(pieces: DataFrame, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ranked pieces."""
    table = np.array(sorted(plan), "int64").reshape(-1, 5)
    keys = table[:, 0] << 44 | table[:, 1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = [*batch.drop_columns(["rank"]).columns, pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)]
            yield pa.record_batch(columns, names=[*batch.drop_columns(["rank"]).schema.names, "sequence_id", "offset"])

    return pieces.mapInArrow(assign, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = stage(cut_documents(docs, tokenizer_path, capacity).withColumn("task", F.spark_partition_id()), "pieces")
    # At most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_rows(complete_bins(histogram, capacity))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    buckets = max(BUCKETS, -(-max(histogram.values(), default=0) // BUCKET_PIECES))
    return place(ranked(pieces, buckets).select(columns), plan)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_file())
