"""Suffix-array dedup: bytes covered by any string of ``LENGTH`` bytes that starts at two places or more are removed.

The index is sparse: of all suffixes only those at content-chosen places are kept. The grams of ``GRAM`` bytes get
hash values; a window (a string of ``LENGTH`` bytes) belongs to its gram of least value, so equal windows belong to
equal grams wherever they stand. Consecutive windows of one gram form a run, which is one entry of the index: the
suffix that begins with that run. Suffixes are ordered by fingerprints of what they begin with instead of by byte
values, since only long common beginnings matter.

1. One pass over the text (Arrow batches, numpy, blocks of bounded size) writes the runs.
2. Runs arrive in batches. Each batch becomes a sorted array of suffixes, is merge-scanned (sort-merge join on the
   order) against every level of the index family, and joins it as a new level; two levels of equal size merge into
   one of the next size. A suffix takes part in logarithmically many merges. The scans yield the repeated grams.
3. A run whose whole content occurs again is covered at once. What is left are runs that agree with others in part:
   one representative per distinct content sends its bytes to the group of its gram, where the windows are sorted and
   neighbours compared. Groups with more than ``HOT_RUNS`` members are not gathered: their runs become segments,
   and the windows of segments whose common core occurs again become rows that are counted by an aggregate.
4. Covered spans are merged per document. Text travels twice, and only that of documents that need it (a broadcast of
   at most 2**20 hash values keeps most others out before the shuffle; what it lets through costs time only).

``repeated_words`` asks the same index for passages of more than ``PASSAGE - 1`` words: each word, lower-cased and without
what stands between words, becomes a code of ``CODE`` bytes, which takes the place of a byte.
A passage of that many short words may have fewer than ``LENGTH`` bytes; it is reported, not removed.

Defined results: null text is empty; texts shorter than ``LENGTH`` lose nothing; repeated rows are copies of each
other, so they lose what they share; a null id is kept and written as null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.llm.common import doc_key, from_doc_key, read, stage, text_key
from levelwise.sources.staging import staging_path

LENGTH = 400
GRAM = 64
PASSAGE = 51
CODE = 4
BATCHES = 3
HOT_RUNS = 1000
SEGMENT = 16
BLOCK = 1 << 18
GATHERED = 2 << 20
FILTER_VALUES = 1 << 20
# Everything but letters and digits stands between words; A-Z are lower-cased.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or bytes([c]).isalnum() else 32 for c in range(256))
# Odd 64-bit multipliers for mixing.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

RUNS = "_did long, _tid long, gram long, content long, start long, n int, repeats boolean"
PARTS = "_did long, _tid long, gram long, window long, start long, n int, alone boolean, bytes binary"

WINDOWS = "_did long, _tid long, gram long, window long, start long, alone boolean"
SPANS = "_did long, _tid long, start long, end long"


class Symbols(NamedTuple):
    """What strings are made of: the bytes of a symbol, and a text as symbols end to end. Places and lengths count symbols."""

    unit: int
    coded: Callable[[bytes], bytes]

    @property
    def gram(self) -> int:
        return GRAM // self.unit

    def array(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, f"<u{self.unit}")


def word_codes(text: bytes) -> bytes:
    """The words of a text as codes of ``CODE`` bytes, end to end."""
    return np.array([crc32(word) for word in text.translate(WORDS).split()], "<u4").tobytes()


BYTES, WORD_CODES = Symbols(1, bytes), Symbols(CODE, word_codes)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * M1
    return x ^ (x >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring pieces from the hashes of both."""
    return mix(a * M2 + b)


def gram_hashes(data: np.ndarray, *widths: int) -> list[np.ndarray]:
    """Hashes of all grams of each width, powers of two in ascending order, by doubling."""
    h, width, found = mix(data.astype("uint64") + np.uint64(1)), 1, []
    for wanted in widths:
        while width < wanted:
            h = joined(h[:-width], h[width:])
            width *= 2
        found.append(h)
    return found


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by doubling."""
    least, reach = x, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def half(length: int) -> int:
    """The largest power of two within ``length``: two such grams that overlap make a window."""
    return 1 << length.bit_length() - 1


def window_hashes(data: np.ndarray, length: int, whole: np.ndarray) -> np.ndarray:
    """Hashes of all windows: two overlapping grams of ``half(length)`` bytes."""
    n = len(data) - length + 1
    return joined(whole[:n], whole[length - half(length) : length - half(length) + n])


def runs_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of the texts that lie end to end in ``data``: start, number of windows, gram, content, whether a window
    of the run may equal another of it."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in ("int64", "int64", "int64", "int64", "bool"))
    width = length - gram + 1
    grams, whole = gram_hashes(data, gram, half(length))
    least, windows = least_of(grams, width), window_hashes(data, length, whole)
    n = len(windows)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    valid = np.arange(n) + length <= ends[text]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & valid)
    stop = np.append(np.flatnonzero(new), n)
    stop = stop[np.searchsorted(stop, first, "right")]
    last_valid = ends[text[first]] - length + 1
    stop = np.minimum(stop, last_valid)
    # Runs of periodic text go on for long: cut them, so that first and last window span the whole content.
    cuts = (stop - first - 1) // width + 1
    begin = np.repeat(first, cuts) + width * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    end = np.minimum(begin + width, np.repeat(stop, cuts))
    content = joined(joined(windows[begin], windows[end - 1]), (end - begin).astype("uint64"))
    # A run that goes on behind its gram has the gram twice.
    passed = np.concatenate(([0], np.cumsum(grams[:n] == least)))
    repeats = passed[end - 1] > passed[begin]
    return begin, end - begin, least[begin].view("int64"), content.view("int64"), repeats


def blocks(
    texts: list[bytes], length: int, size: int = BLOCK, symbols: Symbols = BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of bounded size: symbols, ends of pieces, and for each piece its text and where it starts there.

    Pieces of a long text overlap by ``length - 1`` symbols: each window is in one piece.
    """
    held: list[bytes] = []
    rows: list[int] = []
    starts: list[int] = []
    total, unit = 0, symbols.unit
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) // unit - length + 1, 0), size):
            piece = text[at * unit : (at + size + length - 1) * unit]
            held.append(piece)
            rows.append(row)
            starts.append(at)
            total += len(piece) // unit
            if total >= size:
                yield symbols.array(b"".join(held)), np.cumsum([len(p) // unit for p in held]), np.array(rows), np.array(starts)
                held, rows, starts, total = [], [], [], 0
    if held:
        yield symbols.array(b"".join(held)), np.cumsum([len(p) // unit for p in held]), np.array(rows), np.array(starts)


def text_runs(docs: DataFrame, length: int = LENGTH, symbols: Symbols = BYTES) -> DataFrame:
    """Every run of every text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_did", "_tid")]
            texts = [symbols.coded(t.as_py() or b"") for t in batch.column("text").cast(pa.binary())]
            for data, ends, rows, starts in blocks(texts, length, symbols=symbols):
                begin, n, gram, content, repeats = runs_of(data, ends, length, symbols.gram)
                piece = np.searchsorted(ends, begin, "right")
                start = begin - np.append(0, ends)[piece] + starts[piece]
                columns = [*(k[rows[piece]] for k in keys), gram, content, start, n.astype("int32"), repeats]
                yield pa.record_batch([pa.array(c) for c in columns], names=["_did", "_tid", "gram", "content", "start", "n", "repeats"])

    return keyed(docs).mapInArrow(compute, RUNS)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(doc_key().alias("_did"), text_key().alias("_tid"), "text")


class SuffixIndex:
    """Levels of sorted suffixes, ``gram, at, n``: the first place of each gram and how many runs have it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame, str]] = []

    def _write(self, suffixes: DataFrame) -> tuple[DataFrame, str]:
        path = staging_path(self.spark, "suffixes")
        suffixes.sortWithinPartitions("gram").write.parquet(path)
        return self.spark.read.schema(suffixes.schema).parquet(path), path

    def _drop(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    @staticmethod
    def _combined(suffixes: DataFrame) -> DataFrame:
        return suffixes.groupBy("gram").agg(F.min("at").alias("at"), F.sum("n").alias("n"))

    def add(self, runs: DataFrame) -> DataFrame:
        """Index a batch of runs; ``gram`` of those that now have a second place, staged."""
        place = F.struct("_did", "start").alias("at")
        array, path = self._write(self._combined(runs.select("gram", place, F.lit(1).cast("long").alias("n"))))
        found = array.filter("n > 1").select("gram")
        for _, level, _ in self.levels:  # the merge scan
            found = found.union(array.select("gram").join(level.select("gram").hint("merge"), "gram"))
        found = stage(found.distinct(), "matches")
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, level, old = self.levels.pop()
            merged, new = self._write(self._combined(array.union(level)))
            self._drop(path)
            self._drop(old)
            array, path, rank = merged, new, rank + 1
        self.levels.append((rank, array, path))
        return found

    def close(self) -> None:
        for _, _, path in self.levels:
            self._drop(path)


def repeated_grams(runs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``gram`` of every gram with two runs or more, or a run that repeats itself."""
    index = SuffixIndex(runs.sparkSession)
    found = runs.filter("repeats").select("gram")
    batch = F.pmod(F.xxhash64("_did"), F.lit(batches))
    for n in range(batches):
        found = found.union(index.add(runs.filter(batch == n)))
    found = stage(found.distinct(), "repeated")
    index.close()
    return found


def hash_filter(rows: DataFrame, wanted: DataFrame, values: int = FILTER_VALUES) -> DataFrame:
    """Rows whose key's hash value, one of ``values``, also occurs in ``wanted``: a broadcast of bounded size."""
    value = F.pmod(F.xxhash64("_did", "_tid"), F.lit(values)).cast("int")
    present = wanted.select(value.alias("_value")).distinct()
    return rows.withColumn("_value", value).join(F.broadcast(present), "_value", "left_semi").drop("_value")


def segments(data: np.ndarray, value: int, length: int, gram: int) -> list[tuple[int, int, int]]:
    """A run in segments: first window, number of windows, hash of the core that all their windows share.

    A segment holds neighbouring windows by the place of their gram within them, in steps of ``SEGMENT``. Equal windows
    have it at the same place, so they lie in segments of equal cores, and of two different segments.
    """
    core = length - SEGMENT + 1
    grams, whole = gram_hashes(data, gram, half(core))
    places = np.flatnonzero(grams.view("int64") == value)
    window = np.arange(len(data) - length + 1)
    place = places[np.searchsorted(places, window)]
    step = (place - window) // SEGMENT
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (step[1:] != step[:-1])))
    cores = window_hashes(data, core, whole)[place[first] - SEGMENT * step[first]].view("int64")
    return list(zip(first.tolist(), np.diff(np.append(first, len(window))).tolist(), cores.tolist()))


def partial_runs(docs: DataFrame, members: DataFrame, length: int = LENGTH, symbols: Symbols = BYTES) -> DataFrame:
    """``PARTS``: the bytes of runs in ordinary groups; in hot ones those of their segments, ``window`` being the core."""
    wanted = stage(members.groupBy("_did", "_tid").agg(F.collect_list(F.struct("gram", "start", "n", "alone", "hot")).alias("runs")), "wanted")
    names = ["_did", "_tid", "gram", "window", "start", "n", "alone", "bytes"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for did, tid, text, runs in zip(*(batch.column(c) for c in ("_did", "_tid", "text", "runs"))):
                did, tid, text = did.as_py(), tid.as_py(), symbols.coded(text.as_py().encode())
                for run in runs.as_py():
                    part = text[run["start"] * symbols.unit : (run["start"] + run["n"] + length - 1) * symbols.unit]
                    if run["hot"]:
                        for i, n, core in segments(symbols.array(part), run["gram"], length, symbols.gram):
                            cut = part[i * symbols.unit : (i + n + length - 1) * symbols.unit]
                            out.append((did, tid, run["gram"], core, run["start"] + i, n, run["alone"], cut))
                    else:
                        out.append((did, tid, run["gram"], None, run["start"], run["n"], run["alone"], part))
                if len(out) > 20_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    rows = hash_filter(keyed(docs), wanted).dropDuplicates(["_did", "_tid"]).join(wanted, ["_did", "_tid"])
    return rows.mapInArrow(compute, PARTS)


def neighbours(parts: DataFrame, length: int = LENGTH, symbols: Symbols = BYTES) -> DataFrame:
    """Spans of windows that have an equal in their group: windows sorted per gram, neighbours compared."""

    def sort_windows(table: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(table)
        n = rows.column("n").to_numpy().astype("int64")
        data = symbols.array(b"".join(rows.column("bytes").to_pylist()))
        begin = np.cumsum(n + length - 1) - (n + length - 1)
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = window_hashes(data, length, gram_hashes(data, half(length))[0])[begin[row] + within]
        gram = rows.column("gram").to_numpy()[row]
        order = np.lexsort((window, gram))
        same = (window[order][1:] == window[order][:-1]) & (gram[order][1:] == gram[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        twice &= rows.column("alone").to_numpy(zero_copy_only=False).astype(bool)[row]
        # Neighbouring windows of a run make one span.
        at = np.flatnonzero(twice)
        starts = np.ones(len(at), bool)
        starts[1:] = (np.diff(at) != 1) | (np.diff(row[at]) != 0)
        first, final = at[starts], at[np.append(starts[1:], True)] if len(at) else at
        start = rows.column("start").to_numpy()
        columns = [rows.column(c).to_numpy()[row[first]] for c in ("_did", "_tid")]
        columns += [start[row[first]] + within[first], start[row[final]] + within[final] + length]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["_did", "_tid", "start", "end"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) >= GATHERED:
                grams = held[-1].column("gram").to_numpy()
                cut = int(np.argmax(grams == grams[-1]))  # the last group may go on in the next batch
                if cut:
                    yield sort_windows([*held[:-1], held[-1].slice(0, cut)])
                    held = [held[-1].slice(cut)]
        if held:
            yield sort_windows(held)

    columns = ["_did", "_tid", "gram", "start", "n", "alone", "bytes"]
    gathered = parts.filter("window IS NULL").select(columns).repartition("gram").sortWithinPartitions("gram")
    return gathered.mapInArrow(compute, SPANS)


def hot_windows(parts: DataFrame, length: int = LENGTH, symbols: Symbols = BYTES) -> DataFrame:
    """The same for hot groups: only segments whose core occurs again become windows, which an aggregate counts."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                did, tid, gram, start, alone, part = (batch.column(c)[row].as_py() for c in ("_did", "_tid", "gram", "start", "alone", "bytes"))
                data = symbols.array(part)
                hashes = window_hashes(data, length, gram_hashes(data, half(length))[0]).view("int64")
                n = len(hashes)
                yield pa.record_batch(
                    [pa.array([did] * n), pa.array([tid] * n), pa.array([gram] * n), pa.array(hashes), pa.array(start + np.arange(n)), pa.array([alone] * n)],
                    names=["_did", "_tid", "gram", "window", "start", "alone"],
                )

    def twice(rows: DataFrame) -> DataFrame:
        return rows.groupBy("gram", "window").agg(F.count("*").alias("times")).filter("times > 1").drop("times")

    hot = parts.filter("window IS NOT NULL")
    shared = hot.join(twice(hot.select("gram", "window")), ["gram", "window"], "left_semi")
    windows = stage(shared.mapInArrow(compute, WINDOWS), "windows")
    marked = windows.filter("alone").join(twice(windows), ["gram", "window"])
    return marked.select("_did", "_tid", "start", (F.col("start") + length).alias("end"))


def covered_spans(
    docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, hot_runs: int = HOT_RUNS, symbols: Symbols = BYTES
) -> DataFrame:
    """``_did, _tid, spans``: overlapping spans of covered symbols, sorted, per document that has any."""
    runs = stage(text_runs(docs, length, symbols), "runs")
    found = repeated_grams(runs, batches)
    matched = stage(runs.join(found, "gram", "left_semi"), "matched")
    contents = stage(
        matched.groupBy("gram", "content").agg(
            F.count("*").alias("copies"), F.max("repeats").alias("repeats"), F.min(F.struct("_did", "_tid", "start", "n")).alias("first")
        ), "contents",
    )
    copied = contents.filter("copies > 1").select("gram", "content")
    whole = matched.join(copied, ["gram", "content"]).select("_did", "_tid", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    groups = contents.groupBy("gram").agg(F.count("*").alias("members"), F.max("repeats").alias("repeats"))
    groups = groups.filter("members > 1 OR repeats").select("gram", (F.col("members") > hot_runs).alias("hot"))
    members = contents.join(groups, "gram").select("first.*", "gram", (F.col("copies") == 1).alias("alone"), "hot")
    parts = stage(partial_runs(docs, members, length, symbols), "parts")
    spans = whole.union(neighbours(parts, length, symbols)).union(hot_windows(parts, length, symbols))
    return spans.groupBy("_did", "_tid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def merged(spans: str = "spans") -> Column:
    """Of sorted spans: how many symbols they cover in how many maximal runs."""
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("n"))

    def add(so_far: Column, span: Column) -> Column:
        end = F.greatest(so_far["end"], span["end"])
        return F.struct(
            end.alias("end"), (so_far["covered"] + end - F.least(F.greatest(so_far["end"], span["start"]), end)).alias("covered"),
            (so_far["n"] + (span["start"] > so_far["end"]).cast("long")).alias("n"),
        )

    return F.aggregate(spans, start, add)


def repeated_words(docs: DataFrame, words: int = PASSAGE, batches: int = BATCHES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``_did, _tid, n_repeated_words``: how many words lie in passages of ``words`` words or more that occur again, for
    rows that have any. ``words`` is 16 at least, so that a window holds a gram."""
    spans = covered_spans(docs, words, batches, hot_runs, WORD_CODES)
    return spans.select("_did", "_tid", merged()["covered"].alias("n_repeated_words"))


def cut_spans(text: bytes, spans: list[dict]) -> bytes:
    """What is left of a text without its sorted spans."""
    kept, at = [], 0
    for span in spans:
        if span["start"] > at:
            kept.append(text[at : span["start"]])
        at = max(at, span["end"])
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``_did, _tid, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    marks = stage(covered_spans(docs, length, batches, hot_runs).withColumn("sum", merged()), "spans")
    text = F.coalesce("text", F.lit(""))
    sizes = docs.select(doc_key().alias("_did"), text_key().alias("_tid"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    summed = stage(sizes.join(marks.select("_did", "_tid", "sum"), ["_did", "_tid"], "left"), "sums")
    part = summed.filter("sum.covered < n_bytes").select("_did", "_tid").distinct()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("text").cast(pa.binary()), batch.column("spans"))
            found = [hashlib.sha256(cut_spans(t.as_py(), s.as_py())).hexdigest() for t, s in rows]
            yield pa.record_batch([batch.column("_did"), batch.column("_tid"), pa.array(found, pa.string())], names=["_did", "_tid", "kept"])

    chosen = marks.join(part, ["_did", "_tid"], "left_semi").select("_did", "_tid", "spans")
    texts = hash_filter(keyed(docs), part).dropDuplicates(["_did", "_tid"]).join(chosen, ["_did", "_tid"])
    kept = texts.mapInArrow(digest, "_did long, _tid long, kept string")
    sha = F.when(F.col("sum").isNull(), F.col("whole")).otherwise(F.coalesce("kept", F.sha2(F.lit(""), 256)))
    return summed.join(kept, ["_did", "_tid"], "left").select(
        "_did", "_tid", "n_bytes", F.coalesce("sum.covered", F.lit(0)).alias("n_removed"), F.coalesce("sum.n", F.lit(0)).alias("n_spans"), sha.alias("kept_sha256")
    )


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    result = remove_repeats(docs).join(repeated_words(docs), ["_did", "_tid"], "left")
    return result.select(
        from_doc_key("_did").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256",
        F.coalesce("n_repeated_words", F.lit(0)).cast("long").alias("n_repeated_words"),
    )
