"""SimHash near-dedup: fingerprints linked by BK-trees over shards, components by min-label rounds.

1. Every text becomes a 64-bit SimHash of its 3-word shingles (Arrow batches, whole texts, bounded memory).
2. Equal fingerprints collapse to one row, so a group of copies of any size is a single node.
3. Bits fall into ``radius + 4`` blocks. Two fingerprints within the radius agree on at least four of them. Each
   fingerprint goes to the shards named by its choices of four blocks (15 of at least 42 bits for a radius of 2), and
   every linked pair meets in a shard. A shard has at most 2**22 different members for a radius of 2, whatever the
   corpus holds, so no group is unbounded.
4. A shard's members form a BK-tree: a child hangs under its parent by its Hamming distance to it. Trees are not
   broadcast, since together they hold all fingerprints: each is built once, in the task of its shard, where its
   queries meet it. Only edges within the radius of the distance to the parent are followed. Links join a
   disjoint-set in the task: a shard leaves one row per linked member, never all pairs.
5. Components come from rounds of min-label and pointer jumping, each round a written table in the shared folder.

Defined results: null or empty text has no words and fingerprint zero, linked like any other; a null id counts as
the largest id and is written as null; repeated rows are rows of their own with equal results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.llm.common import doc_key, from_doc_key, read, stage, text_key

SHINGLE = 3
SEED = 42
RADIUS = 2
# Blocks that linked fingerprints agree on, and the largest radius: its shards are 495 a fingerprint.
AGREED, WIDEST = 4, 8
# Members of shards that a task holds at a time, cut between shards, and pairs of query and tree node.
MEMBERS = 500_000
PAIRS = 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 text."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, "int64")
    for at in range(0, len(starts), 65_536):
        spans = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), "uint8").reshape(-1, 8)
        counts += np.unpackbits(hashes, axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``_did, _tid, fp`` for every row of ``docs``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), "uint64", len(texts)).view("int64")
            yield pa.record_batch([batch.column("_did"), batch.column("_tid"), pa.array(found)], names=["_did", "_tid", "fp"])

    keyed = docs.select(doc_key().alias("_did"), text_key().alias("_tid"), "text")
    return keyed.mapInArrow(compute, "_did long, _tid long, fp long")


def blocks(radius: int) -> list[tuple[int, int]]:
    """First bit and width of ``radius + 4`` blocks."""
    if not 0 <= radius <= WIDEST:
        raise ValueError(f"radius must be 0 to {WIDEST}, not {radius}")
    n = radius + AGREED
    ends = [64 * i // n for i in range(n + 1)]
    return [(low, high - low) for low, high in zip(ends, ends[1:])]


def shard_keys(radius: int = RADIUS, fp: str = "fp") -> Column:
    """One key for each choice of four blocks."""
    keys = []
    for n, chosen in enumerate(combinations(blocks(radius), AGREED)):
        mask = sum(((1 << width) - 1) << at for at, width in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), F.col(fp).bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


class BkForest:
    """BK-trees of many shards as arrays; ``shard`` is ascending, the first member of a shard is its root."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp = fp = fp.view("uint64")  # signed counts would be those of the absolute value
        self.root = np.searchsorted(shard, shard, "left")
        tables: list[np.ndarray] = [np.zeros((2, 0), "int64")]
        member, below = np.arange(len(fp)), self.root
        while True:
            deeper = below != member
            member, below = member[deeper], below[deeper]
            if not len(member):
                break
            # Members under one node split by distance to it; the first of each part becomes the child.
            edge = below * 65 + np.bitwise_count(fp[member] ^ fp[below])
            order = np.argsort(edge, kind="stable")
            member, edge = member[order], edge[order]
            first = np.searchsorted(edge, edge, "left")
            heads = np.unique(first)
            tables.append(np.stack((edge[heads], member[heads])))
            below = member[first]
        table = np.concatenate(tables, axis=1)
        order = np.argsort(table[0])
        self.edge, self.child = table[0][order], table[1][order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (member, other member) of one shard within ``radius``, in bounded portions."""
        everyone = np.arange(len(self.fp))
        waiting = [(everyone[i : i + PAIRS], self.root[i : i + PAIRS]) for i in range(0, len(everyone), PAIRS)]
        while waiting:
            query, node = waiting.pop()
            distance = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype("int64")
            near = (distance <= radius) & (query != node)
            yield query[near], node[near]
            # Only edges within the radius of the distance can lead to a match.
            low = np.searchsorted(self.edge, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.edge, node * 65 + np.minimum(distance + radius, 64), "right")
            n = high - low
            ends = np.cumsum(n)
            at = 0
            while at < len(n):  # portions of at most PAIRS pairs, one query at least
                stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
                part = n[at:stop]
                if total := int(part.sum()):
                    within = np.arange(total) - np.repeat(np.cumsum(part) - part, part)
                    waiting.append((np.repeat(query[at:stop], part), self.child[np.repeat(low[at:stop], part) + within]))
                at = stop


def join_sets(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Disjoint sets after linking ``a`` with ``b``; a label is the smallest index of its set."""
    while len(a):
        one, two = label[a], label[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(label, shorter := label[label]):
            label = shorter
    return label


def shard_links(shards: Iterator[tuple[np.ndarray, np.ndarray]], radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprint, smaller linked fingerprint) per shard portion; a portion holds whole shards, sorted by key."""
    for key, fp in shards:
        same = key[1:] == key[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        key, fp = key[shared], fp[shared]
        forest, label = BkForest(key, fp), np.arange(len(fp))
        for a, b in forest.links(radius):
            label = join_sets(label, a, b)
        linked = label != np.arange(len(fp))
        yield fp[linked], fp[label[linked]]


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Gather sorted batches into portions that end between shards."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fp")]))
        if sum(x.shape[1] for x in held) >= MEMBERS:
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if cut:
                yield rows[0][:cut], rows[1][:cut]
            held = [rows[:, cut:]]
    if held:
        rows = np.concatenate(held, axis=1)
        yield rows[0], rows[1]


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between different fingerprints that connect what is within ``radius``, with no all-pairs lists."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in shard_links(whole_shards(batches), radius):
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    shards = nodes.select(F.explode(shard_keys(radius)).alias("shard"), "fp").repartition("shard").sortWithinPartitions("shard", "fp")
    return shards.mapInArrow(link, "a long, b long").distinct()


def min_labels(links: DataFrame) -> DataFrame:
    """``v, label``: smallest value connected to each end of ``links``. Every round is a written table."""
    both = stage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels["v"] == heard["a"]).select("v", "label", F.least("label", "heard").alias("lower"))
        jump = labels.select(F.col("v").alias("at"), F.col("label").alias("beyond"))
        moved = lower.join(jump, lower["lower"] == jump["at"], "left").select(
            "v", F.least("lower", "beyond").alias("label"), (F.least("lower", "beyond") != F.col("label")).alias("changed")
        )
        moved = stage(moved, "labels")
        labels = moved.select("v", "label")
        if moved.filter("changed").isEmpty():
            return labels


def near_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``_did, _tid, fp, component`` per row of ``docs``; the component is its smallest ``_did``."""
    found = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(found.groupBy("fp").agg(F.min("_did").alias("first")), "nodes")
    labels = min_labels(fingerprint_links(nodes, radius))
    grouped = nodes.join(labels, nodes["fp"] == labels["v"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component"))
    members = stage(grouped.join(smallest, "label").select("fp", "component"), "components")
    return found.join(members, "fp").select("_did", "_tid", "fp", "component")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the row of the smallest id of each component; identical rows of that id stay once."""
    return smallest_of_each(docs, near_components(docs, radius, shingle))


def smallest_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``groups`` (``_did, _tid, component``) names by their component's id, each once."""
    kept = groups.filter(F.col("_did") == F.col("component")).groupBy("component").agg(F.min(F.struct("_did", "_tid")).alias("k"))
    kept = kept.select("k._did", "k._tid")
    keyed = docs.select(F.struct("*").alias("row"), doc_key().alias("_did"), text_key().alias("_tid"))
    return keyed.join(kept, ["_did", "_tid"], "left_semi").dropDuplicates(["_did", "_tid"]).select("row.*")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_components(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(
        from_doc_key("_did").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        from_doc_key("component").alias("component_id"),
    )
