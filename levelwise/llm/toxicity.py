"""Toxicity: a support vector machine on a gapped subsequence string kernel, with Nyström landmarks.

* The kernel compares units, white-space separated strings (or letters spelt out with blanks). Features are ordered
  triples of letters up to ``REACH`` places apart, damped by ``DECAY`` per skipped place, so that inserted characters,
  dots and dashes weaken a match but do not break it. Case and digits written for letters are folded; a
  string's two ends count as letters. Kernel values are divided by the lengths of the units' feature occurrences.
* Landmarks are beginnings and whole units that labelled toxic documents use and clean ones do not, and units of clean
  documents that look most like them. A unit becomes its kernel values to them, whitened by their own kernel matrix.
* Training examples are sentences of labelled documents outside the held-out part, at most ``SAMPLE`` documents per
  label in hash order: sentences of clean documents, and those of toxic documents that hold a toxic landmark. A
  sentence stands for its most suspicious unit, chosen by the landmarks in the first round and by the machine in the
  next (``ROUNDS``). Spark ML fits the linear machine.
* As all of it is linear in the features, the machine becomes one weight per letter triple. A sentence scores as its
  most suspicious unit and a document as its most suspicious sentence; the cut between labelled documents is 0.5.

Only fitting looks at labels, and what it holds is bounded by ``SAMPLE`` and the number of landmarks. Scoring reads
every document once, without a shuffle.

Defined results: null and empty texts have no unit and score lowest; units longer than ``WINDOW`` bytes are scored in
overlapping windows; labels that are null or belong to no document are ignored, of repeated labels of one document
the largest counts; documents with a null id are scored and never used to learn; without toxic and clean documents to
learn from all scores are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.llm.common import read, stage
from levelwise.llm.quality import remainder, training_rows

FOLDS, HELD_OUT = 5, 0
SAMPLE = 3000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 96, 128
# Strings looked at as toxic landmarks, those of most documents first.
CANDIDATES = 1500
MARKS = b".,;:!?\"'()"
ROUNDS = 2
REG = 1e-4
# The examples are bounded by the sample: few partitions save job latency.
FIT_PARTITIONS = 4
DECAY, REACH = 0.5, 3
WINDOW, STEP = 40, 20
REMEMBERED = 100_000
# Texts whose units are held at a time.
PORTION = 200
LETTERS, EDGE = 64, 27
SHARPNESS = 6.0


def _folded() -> bytes:
    """Letter class of each byte of lower-cased UTF-8, first bytes of longer characters left out; 0 is no letter."""
    table = bytearray(256)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = i + 1
    for digit, letter in zip("0134578@$", "oieastbas"):
        table[ord(digit)] = table[ord(letter)]
    for i in range(64):  # capital and small accented letters are 32 apart
        table[0x80 + i] = EDGE + 1 + i % 32
    return bytes(table)


FOLDED = _folded()
FIRST_BYTES = bytes(range(0xC0, 0x100))
SENTENCE_END = re.compile(rb"[.!?\n]+(?=\s|$)|\n")
STEPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]


def units(text: bytes) -> set[bytes]:
    """The distinct units of a text."""
    words = text.lower().split()
    found = set(words)
    single = [i for i, w in enumerate(words) if len(w) == 1]
    run: list[int] = []
    for i in [*single, -1]:
        if run and i == run[-1] + 1:
            run.append(i)
        else:
            if len(run) > 2:
                found.add(b"".join(words[j] for j in run))
            run = [i]
    return found


def feature_rows(strings: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For strings of similar length: their numbers, and index and weight of every letter triple in each."""
    strings = [s.translate(FOLDED, FIRST_BYTES) for s in strings]
    sizes = np.fromiter(map(len, strings), "int64", len(strings))
    for low, high in ((0, 8), (8, 12), (12, 20), (20, WINDOW)):
        chosen = np.flatnonzero((sizes > low) & (sizes <= high) | ((sizes == 0) & (low == 0)))
        for part in np.array_split(chosen, max(1, len(chosen) // 4096)):
            if not len(part):
                continue
            width = high + 2
            text = b"".join(strings[i].ljust(high, b"\0") for i in part)
            c = np.zeros((len(part), width + 2 * REACH), "int32")
            c[:, 1 : high + 1] = np.frombuffer(text, "uint8").reshape(len(part), high)
            c[:, 0] = EDGE
            c[np.arange(len(part)), sizes[part] + 1] = EDGE
            index, weight = [], []
            for a, b, w in STEPS:
                x, y, z = c[:, :width], c[:, a : a + width], c[:, a + b : a + b + width]
                valid = (x > 0) & (y > 0) & (z > 0)
                index.append(np.where(valid, (x * LETTERS + y) * LETTERS + z, 0))
                weight.append(np.where(valid, np.float32(w), np.float32(0)))
            yield part, np.concatenate(index, axis=1), np.concatenate(weight, axis=1)


def cut_windows(unit: bytes) -> list[bytes]:
    return [unit] if len(unit) <= WINDOW else [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW + STEP, STEP)]


class Kernel:
    """Landmarks, their whitening and, once fitted, one weight per letter triple. Triples of no landmark are place 0."""

    def __init__(self, landmarks: list[tuple[bytes, bool]]):
        """``landmarks``: string and whether it is a beginning only."""
        rows = []
        for text, beginning in landmarks:
            _, index, weight = next(feature_rows([text[:WINDOW]]))
            if beginning:  # the end of a beginning is not an end
                weight = np.where(index % LETTERS == EDGE, np.float32(0), weight)
            rows.append((index[0], weight[0] / max(float(np.sqrt((weight**2).sum())), 1e-6)))
        used = np.unique(np.concatenate([index for index, _ in rows]))
        used = used[used > 0]
        self.place = np.zeros(LETTERS**3, "int32")
        self.place[used] = np.arange(1, len(used) + 1)
        phi = np.zeros((len(rows), len(used) + 1))
        for row, (index, weight) in enumerate(rows):
            np.add.at(phi[row], self.place[index], weight)
        phi[:, 0] = 0
        values, vectors = np.linalg.eigh(phi @ phi.T)
        sound = values > 1e-3 * max(float(values.max(initial=0)), 1e-9)
        # Nyström features of a unit are its features times this matrix.
        self.map = (phi.T @ (vectors[:, sound] / np.sqrt(values[sound]))).astype("float32")
        self.weights = np.zeros(len(used) + 1, "float32")

    def decide_by(self, direction: np.ndarray) -> None:
        """Weigh triples so that a decision is a unit's Nyström features times ``direction``."""
        self.weights = (self.map @ direction).astype("float32")

    def decisions(self, strings: list[bytes]) -> np.ndarray:
        out = np.zeros(len(strings), "float32")
        for part, index, weight in feature_rows(strings):
            norm = np.sqrt((weight * weight).sum(axis=1))
            out[part] = (self.weights[self.place[index]] * weight).sum(axis=1) / np.maximum(norm, 1e-6)
        return out

    def features(self, strings: list[bytes]) -> np.ndarray:
        out = np.zeros((len(strings), self.map.shape[1]))
        for part, index, weight in feature_rows(strings):
            norm = np.maximum(np.sqrt((weight * weight).sum(axis=1)), 1e-6)
            for i, row in enumerate(part):
                out[row] = weight[i] @ self.map[self.place[index[i]]] / norm[i]
        return out


class Scorer:
    """Largest decision of a text's units; decisions are remembered per worker."""

    def __init__(self, kernel: Kernel):
        self.kernel, self.known = kernel, {}

    def unit_scores(self, wanted: Iterable[bytes]) -> dict[bytes, float]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [u for u in wanted if u not in known]
        windows = [(n, w) for n, u in enumerate(new) for w in cut_windows(u)]
        best = np.full(len(new), -np.inf)
        if windows:
            np.maximum.at(best, np.array([n for n, _ in windows]), self.kernel.decisions([w for _, w in windows]))
        known.update(zip(new, best.tolist()))
        return known

    def texts(self, texts: list[bytes] | pa.Array) -> np.ndarray:
        """One value per text, -inf without units. Texts are taken in portions, which bounds what is held."""
        out = np.full(len(texts), -np.inf)
        for at in range(0, len(texts), PORTION):
            sets = [units((t if isinstance(t, bytes) else t.as_py()) or b"") for t in texts[at : at + PORTION]]
            known = self.unit_scores(set().union(*sets))
            for i, found in enumerate(sets):
                if found:
                    out[at + i] = max(map(known.__getitem__, found))
        return out

    def suspects(self, sentences: list[bytes]) -> list[bytes]:
        """The most suspicious unit of each sentence."""
        sets = [sorted(units(s)) for s in sentences]
        known = self.unit_scores(set().union(*map(set, sets)) if sets else ())
        return [max(found, key=known.__getitem__, default=b"") for found in sets]

    def worst_window(self, unit: bytes) -> bytes:
        """The unit, or the most suspicious of its windows if it is long."""
        windows = cut_windows(unit)
        if len(windows) == 1:
            return unit
        known = self.unit_scores(set(windows))
        return max(windows, key=known.__getitem__)


def beginnings(rows: DataFrame) -> DataFrame:
    """``doc, label, unit, beginning``: units of each document, and their beginnings of 4 to 7 bytes, once per document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, label in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("label").to_pylist()):
                whole = {w for u in units(text.as_py() or b"") for w in cut_windows(u.strip(MARKS))} - {b""}
                starts = {u[:n] for u in whole for n in range(4, 8) if len(u) > n}
                both = [(u, False) for u in whole] + [(u, True) for u in starts]
                columns = ([doc] * len(both), [label] * len(both), [u for u, _ in both], [b for _, b in both])
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.bool_()))], names=["doc", "label", "unit", "beginning"])

    numbered = rows.select(F.xxhash64("text").alias("doc"), "text", "label").dropDuplicates(["doc", "label"])
    return numbered.mapInArrow(compute, "doc long, label int, unit binary, beginning boolean")


def toxic_landmarks(rows: DataFrame, most: int = TOXIC_LANDMARKS) -> list[tuple[bytes, bool]]:
    """Strings that tell toxic documents, and whether they are beginnings.

    A candidate must occur in more toxic documents than chance gives any of all strings, and hardly in clean ones.
    Of the candidates those are taken, one after the other, that explain most documents; a document counts less for
    each time it is explained already.
    """
    used = stage(
        beginnings(rows).groupBy("unit", "beginning").agg(
            F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"),
            F.collect_list(F.when(F.col("label") == 1, F.col("doc"))).alias("docs"),
        ), "units",
    )
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    share = size.get(1, 0) / max(sum(size.values()), 1)
    if not 0 < share < 1:
        return []
    least = max(3, int(np.ceil(np.log(100 * max(used.count(), 1)) / -np.log(share))))
    wanted = used.filter((F.col("toxic") >= least) & (F.col("toxic") > 20 * F.col("clean")))
    candidates = [
        (bytes(r["unit"]), r["beginning"], frozenset(r["docs"]))
        for r in wanted.orderBy(F.desc("toxic"), "beginning", "unit").limit(CANDIDATES).collect()
    ]
    chosen: list[tuple[bytes, bool]] = []
    explained: Counter[int] = Counter()
    while len(chosen) < most:
        open_ = [(unit, beginning, docs) for unit, beginning, docs in candidates if (unit, beginning) not in chosen]
        gains = [(sum(0.3 ** explained[d] for d in docs) * (1.0 if beginning else 1.1), unit, beginning, docs) for unit, beginning, docs in open_]
        gain, unit, beginning, docs = max(gains, key=lambda g: g[0], default=(0, b"", False, frozenset()))
        if gain < least / 2:
            break
        chosen.append((unit, beginning))
        explained.update(docs)
        if beginning:  # whole units that begin so
            chosen += [(u, False) for u, b, _ in candidates if not b and u.startswith(unit) and (u, False) not in chosen][:3]
    return chosen[:most]


def sentences_of(rows: DataFrame, landmarks: list[tuple[bytes, bool]]) -> DataFrame:
    """``sentence, label``: all sentences of clean documents, and those of toxic ones that hold a toxic landmark."""
    pattern = re.compile(b"|".join(rb"(?<!\S)" + re.escape(t) + (b"" if b else rb"(?![^\s.,;:!?\"'()])") for t, b in landmarks))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, float]] = []
            for text, label in zip(batch.column("text").cast(pa.binary()), batch.column("label").to_pylist()):
                parts = {s for s in SENTENCE_END.split((text.as_py() or b"").lower()) if s.strip()}
                out += [(s, float(label)) for s in sorted(parts) if not label or pattern.search(s)]
            yield pa.record_batch([pa.array([s for s, _ in out], pa.binary()), pa.array([y for _, y in out], pa.float64())], names=["sentence", "label"])

    return rows.select("text", "label").mapInArrow(compute, "sentence binary, label double")


def suspects_of(sentences: DataFrame, kernel: Kernel) -> DataFrame:
    """``unit, label, times``: the most suspicious unit of each sentence, equal ones once."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(kernel)
        for batch in batches:
            column = batch.column("sentence")
            parts = (column.slice(at, 10 * PORTION).to_pylist() for at in range(0, len(column), 10 * PORTION))
            found = [scorer.worst_window(unit) for part in parts for unit in scorer.suspects(part)]
            yield pa.record_batch([pa.array(found, pa.binary()), batch.column("label")], names=["unit", "label"])

    picked = sentences.mapInArrow(pick, "unit binary, label double")
    return picked.groupBy("unit", "label").agg(F.count("*").cast("double").alias("times"))


def embedded(units: DataFrame, kernel: Kernel) -> DataFrame:
    """``f, label, times``: Nyström features of units."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = kernel.features([u.as_py() for u in batch.column("unit")])
            yield pa.record_batch([pa.array(list(f), pa.list_(pa.float64())), batch.column("label"), batch.column("times")], names=["f", "label", "times"])

    return units.mapInArrow(embed, "f array<double>, label double, times double")


class Model:
    def __init__(self, kernel: Kernel | None = None, cut: float = 0.0, scale: float = 1.0):
        self.kernel, self.cut, self.scale = kernel, cut, scale

    def scores(self, texts: list[bytes] | pa.Array, scorer: Scorer | None = None) -> np.ndarray:
        if self.kernel is None:
            return np.zeros(len(texts))
        raw = (scorer or Scorer(self.kernel)).texts(texts)
        return 1 / (1 + np.exp(-np.clip(SHARPNESS * (raw - self.cut) / self.scale, -500, 500)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, sample: int = SAMPLE) -> Model:
    rows = stage(training_rows(docs, labels, "toxic", folds, held_out, sample).select("text", "label"), "toxic-sample")
    toxic = toxic_landmarks(rows)
    if not toxic:
        return Model()
    sentences = stage(sentences_of(rows, toxic).repartition(F.xxhash64("sentence")), "sentences")
    kernel = Kernel(toxic)
    kernel.decide_by(kernel.features([t for t, _ in toxic]).sum(axis=0))
    clean: list[tuple[bytes, bool]] = []
    for _ in range(ROUNDS):
        seen = stage(suspects_of(sentences, kernel), "suspects")
        hard = seen.filter("label = 0").orderBy(F.desc("times"), "unit").limit(CLEAN_LANDMARKS).collect()
        clean += [(u, False) for u in (bytes(r["unit"]) for r in hard) if (u, False) not in clean]
        if not clean:
            return Model()
        kernel = Kernel(toxic + clean)
        totals = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.sum("times").alias("n")).collect()}
        balance = F.when(F.col("label") == 1, 1000.0 / totals.get(1.0, 1.0)).otherwise(1000.0 / totals.get(0.0, 1.0))
        data = embedded(seen, kernel).select(array_to_vector("f").alias("features"), "label", (F.col("times") * balance).alias("weight"))
        machine = LinearSVC(weightCol="weight", regParam=REG, maxIter=30, standardization=False).fit(stage(data.coalesce(FIT_PARTITIONS), "examples"))
        kernel.decide_by(machine.coefficients.toArray())
    cut, scale = best_cut(rows, kernel)
    return Model(kernel, cut, scale)


def best_cut(rows: DataFrame, kernel: Kernel) -> tuple[float, float]:
    """Cut with the fewest errors among the labelled documents, in the middle of its gap, and a scale for the scores."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(kernel)
        for batch in batches:
            raw = scorer.texts(batch.column("text").cast(pa.binary()))
            yield pa.record_batch([pa.array(np.maximum(raw, -1e6)), batch.column("label")], names=["raw", "label"])

    found = rows.mapInArrow(compute, "raw double, label int").collect()  # at most twice the sample
    raw, label = np.array([r["raw"] for r in found]), np.array([r["label"] for r in found])
    order = np.argsort(raw)
    raw, label = raw[order], label[order]
    share = label.mean()
    # Weighted so that both kinds of error count alike.
    cost = np.where(label == 1, 1 - share, share)
    errors = np.concatenate(([0.0], np.cumsum(np.where(label == 1, cost, 0)))) + np.concatenate((np.cumsum(np.where(label == 0, cost, 0)[::-1])[::-1], [0.0]))
    at = int(np.clip(np.argmin(errors), 1, len(raw) - 1))
    low, high = raw[at - 1], raw[at]
    return float((low + high) / 2), float(max(np.median(raw[label == 1]) - np.median(raw[label == 0]), 1e-6))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``row, score``: every row of ``docs`` as a struct, and its score."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    schema = rows.select("row").schema.add("score", "double")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.kernel) if model.kernel else None
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            yield pa.record_batch([batch.column("row"), pa.array(model.scores(texts, scorer))], names=["row", "score"])

    return rows.mapInArrow(compute, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "row.doc_id", (remainder(FOLDS, "row.doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
