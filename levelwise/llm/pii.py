"""Personal data by a semi-Markov conditional random field on top of fixed patterns.

1. One pass over the texts finds the base spans (patterns with checks) and cuts out regions: maximal runs of
   white-space separated chunks that hold a digit or an ``@``. Everything else cannot hold an entity.
2. Regions are cut into tokens (runs of digits, runs of ASCII letters, white space, single characters). A candidate
   segment is a run of at most ``MAX_TOKENS`` tokens; the features look at the whole segment: its shape, lengths of
   its digit groups, separators, check digit, octets, neighbours. The field scores a region's segmentation as the sum
   of its segments' weights by kind and of transitions between neighbouring segments; single tokens may stay outside.
3. Weights are learned by maximum likelihood (forward-backward over all segmentations) from regions where the base
   spans are beyond doubt: at most ``SAMPLE`` different regions per kind and as many without any, in hash order.
   Equal lattices of features are learned once with their count.
4. Every region is decoded by dynamic programming over segments of bounded length, which chooses boundaries and kinds
   together. Base spans are fixed segments there; what the field finds besides is added. So a card number is found
   that a pattern lost because it swallowed the digits beside it.

One row per document throughout; nothing is shuffled but the regions of the sample.

Defined results: null and empty texts have no spans; every row, null ids and repeated rows included, is answered from
its own text; places are code points; patterns work in linear time on any text, and regions of any length are decoded
with memory in proportion to the region; ties of scores go to fewer and earlier segments; without base spans to learn
from nothing is added; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.llm.common import read, stage

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 400
MAX_TOKENS, MAX_CHARS, TRAIN_TOKENS = 24, 320, 48
STEPS, RATE, PENALTY = 80, 0.15, 0.0005
OUTSIDE = 0

SPANS = "array<struct<kind:string,start:int,end:int>>"
SCANNED = f"doc_id long, base {SPANS}, regions array<struct<start:int,text:string,left:string,right:string,base:{SPANS},sure:boolean>>"

TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.DOTALL)
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+")
TRIGGER, BLANK = re.compile(r"[0-9@]"), re.compile(r"\s")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Walks from one ``@`` to the next, so that long runs of name characters are read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        name = at - len(text[free:at]) + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if name < at else None
        if found:
            yield name, found.end(), True
        free = found.end() if found else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four numbers of a dotted chain at a time."""
    for chain in CHAIN.finditer(text):
        parts, start = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            yield start, end, all(map(octet, four))
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for found in DIGITS.finditer(text):
        if found.end() - found.start() >= 13:
            digits = only_digits(found.group())
            yield found.start(), found.end(), 13 <= len(digits) <= 19 and luhn(digits)


def phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for found in PLUS.finditer(text):
        number = found.group().rstrip(" ().-")
        if len(number) >= 4:
            yield found.start(), found.start() + len(number), 9 <= len(only_digits(number)) <= 15


def pattern_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans by kind and place, and the places of matches of several parts that failed their check.

    Such a match may have swallowed its neighbours. One without a separator that fails is no entity.
    """
    base, failed = [], []
    if TRIGGER.search(text):
        for kind, find in zip(KINDS, (emails, addresses, cards, phones)):
            for start, end, sound in find(text):
                if sound:
                    base.append((kind, start, end))
                elif re.search(r"[ ()-]", text[start:end]):
                    failed.append((start, end))
    return base, failed


def region_bounds(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of neighbouring chunks with a digit or an ``@``; each character is looked at a bounded number of times."""
    hit, start, end = TRIGGER.search(text), -1, -1
    while hit:
        low = max(end, 0)
        chunk = low + len(text[low : hit.start()]) - len(re.split(r"\s", text[low : hit.start()])[-1])
        stop = BLANK.search(text, hit.end())
        stop = stop.start() if stop else len(text)
        if start >= 0 and not text[end:chunk].strip():
            end = stop
        else:
            if start >= 0:
                yield start, end
            start, end = chunk, stop
        hit = TRIGGER.search(text, end)
    if start >= 0:
        yield start, end


def regions_of(text: str, base: list[Span], failed: list[tuple[int, int]]) -> Iterator[dict]:
    """Regions with their neighbours and base spans; ``sure`` if those can be learned from."""
    spans, at, lost = sorted(base, key=lambda s: (s[1], s[2])), 0, 0
    failed = sorted(failed)
    for start, end in region_bounds(text):
        own = []
        while at < len(spans) and spans[at][1] < end:
            own.append(spans[at])
            at += 1
        doubt = False
        while lost < len(failed) and failed[lost][0] < end:
            doubt, lost = True, lost + 1
        inside = all(start <= s and e <= end for _, s, e in own) and all(a[2] <= b[1] for a, b in zip(own, own[1:]))
        yield {
            "start": start, "text": text[start:end], "left": text[max(start - 1, 0) : start], "right": text[end : end + 1],
            "base": [{"kind": k, "start": s - start, "end": e - start} for k, s, e in own], "sure": inside and not doubt,
        }


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, base, regions`` of every document, in one pass over the texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            # A few rows at a time: texts may be long.
            for low in range(0, batch.num_rows, 64):
                base, regions = [], []
                for value in texts[low : low + 64]:
                    text = value.as_py() or ""
                    spans, failed = pattern_spans(text)
                    base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                    regions.append(list(regions_of(text, spans, failed)))
                types = scanned.schema
                yield pa.record_batch([ids[low : low + 64], pa.array(base, types[1].type), pa.array(regions, types[2].type)], schema=types)

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    region = pa.struct([("start", pa.int32()), ("text", pa.string()), ("left", pa.string()), ("right", pa.string()), ("base", span), ("sure", pa.bool_())])
    scanned = pa.schema([("doc_id", pa.int64()), ("base", span), ("regions", pa.list_(region))]).empty_table()
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCANNED)


def neighbour(char: str) -> str:
    if not char:
        return "^"
    if char.isspace():
        return "_"
    if char.isascii():
        return "9" if char.isdigit() else "a" if char.isalpha() else char
    return "u"


class Lattice:
    """Tokens of a region and its candidate segments ``(first, last, features)``, by their end."""

    def __init__(self, text: str, left: str, right: str, fixed: list[Span] = ()):
        found = list(TOKEN.finditer(text))
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.tokens = [m.group() for m in found]
        self.kinds = [neighbour(t[0]) for t in self.tokens]
        self.text, self.left, self.right, self.length = text, left, right, len(found)
        self.covered = bytearray(self.length)
        first, last = {s: i for i, s in enumerate(self.starts)}, {e: i for i, e in enumerate(self.ends)}
        # Base spans as (first token, last token, kind); one that another overlaps is kept out of the lattice.
        self.fixed = {}
        for kind, start, end in fixed:
            if start in first and end in last and not any(self.covered[first[start] : last[end] + 1]):
                i, j = first[start], last[end]
                self.covered[i : j + 1] = b"\1" * (j + 1 - i)
                self.fixed[i, j] = KINDS.index(kind) + 1

    def ending_at(self, j: int) -> Iterator[tuple[int, list[str]]]:
        """Candidates whose last token is ``j``; no candidate starts or ends within a word of ASCII letters and digits."""
        if self.kinds[j] not in "9a" or self._after(j) in "9a":
            return
        trigger, digit_end = False, self.kinds[j] == "9"
        at = 0
        for i in range(j, max(j - MAX_TOKENS, -1), -1):
            if self.covered[i] or self.ends[j] - self.starts[i] > MAX_CHARS:
                return
            kind = self.kinds[i]
            at += kind == "@"
            trigger = trigger or kind in "9@"
            if kind in "9a" and self._before(i) in "9a":
                continue
            if at:
                if kind in "9a" or kind in "+_%.-":
                    yield i, self.features(i, j)
            elif trigger and digit_end and kind in "9+":
                yield i, self.features(i, j)

    def _before(self, i: int) -> str:
        return self.kinds[i - 1] if i else neighbour(self.left)

    def _after(self, j: int) -> str:
        return self.kinds[j + 1] if j + 1 < self.length else neighbour(self.right)

    def features(self, i: int, j: int) -> list[str]:
        tokens, kinds = self.tokens[i : j + 1], self.kinds[i : j + 1]
        groups = [t for t, k in zip(tokens, kinds) if k == "9"]
        digits = "".join(groups)
        separators = "".join(k for k in kinds if k not in "9a")
        lengths = ",".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many"
        left, right = self._before(i), self._after(j)
        at = separators.count("@")
        out = [
            "bias", f"digits={min(len(digits), 24)}", f"shape={''.join(kinds)}" if len(kinds) <= 14 else "shape=long",
            f"separators={separators if len(separators) <= 10 else 'long'}", f"left={left}", f"right={right}",
            f"ends={kinds[0]}{kinds[-1]}", f"tokens={len(kinds)}", f"at={min(at, 2)}",
        ]
        if not at:
            out.append(f"groups={lengths}")
        if 13 <= len(digits) <= 19 and not separators.strip("_-"):
            out.append(f"luhn={luhn(digits)}")
        if separators == "..." and len(groups) == 4 and len(kinds) == 7:
            out.append(f"octets={all(map(octet, groups))}")
        if at == 1:
            host = kinds[kinds.index("@") + 1 :]
            out.append(f"host={'.' in host and all(k in '9a.-' for k in host)}")
        return out

    def segments(self) -> list[tuple[int, int, list[str]]]:
        return [(i, j, names) for j in range(self.length) for i, names in self.ending_at(j)]


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - top).sum(axis=axis)) + top.squeeze(axis)


def expectations(length: int, ends: list[list[tuple[int, int]]], scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the sum over all segmentations, and how much of it every (segment, kind) and every transition has.

    ``ends[j]`` lists (first token, number) of the segments that end with token j; ``scores`` holds (lattice, segment,
    kind) for lattices of equal form. A state is the kind of the last segment, 0 outside; before the first token it is 0.
    """
    k, many = len(moves), len(scores)
    before = np.full((length + 1, many, k), -np.inf)
    before[0, :, OUTSIDE] = 0
    enter = np.empty((length + 1, many, k))
    for j in range(length + 1):
        if j:
            before[j, :, OUTSIDE] = enter[j - 1, :, OUTSIDE]
            if ends[j - 1]:
                i, n = map(list, zip(*ends[j - 1]))
                before[j, :, 1:] = log_sum(enter[i, :, 1:] + scores[:, n].transpose(1, 0, 2), 0)
        enter[j] = log_sum(before[j][:, :, None] + moves, 1)
    total = log_sum(before[length], 1)
    after = np.full((length + 1, many, k), -np.inf)
    after[length] = 0
    by_start: list[list[tuple[int, int]]] = [[] for _ in range(length)]
    for j, own in enumerate(ends):
        for i, n in own:
            by_start[i].append((j + 1, n))
    share, moved = np.zeros_like(scores), np.zeros((many, k, k))
    for i in range(length - 1, -1, -1):
        leave = np.full((many, k), -np.inf)
        leave[:, OUTSIDE] = after[i + 1, :, OUTSIDE]
        if by_start[i]:
            j, n = map(list, zip(*by_start[i]))
            ways = scores[:, n].transpose(1, 0, 2) + after[j, :, 1:]
            leave[:, 1:] = log_sum(ways, 0)
            share[:, n] = np.exp(enter[i, :, 1:] + ways - total[:, None]).transpose(1, 0, 2)
        steps = moves + leave[:, None, :]
        moved += np.exp(before[i][:, :, None] + steps - total[:, None, None])
        after[i] = log_sum(steps, 2)
    return total, share, moved


@dataclass
class Field:
    """Weights by feature and kind, and of transitions between the kinds of neighbouring segments (0: outside)."""

    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(KINDS))))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((len(KINDS) + 1, len(KINDS) + 1)))

    def score(self, names: list[str]) -> np.ndarray:
        """A segment with a feature that was never seen gets nothing for it."""
        at = [self.names[n] for n in names if n in self.names]
        return self.weights[at].sum(axis=0)

    def decode(self, lattice: Lattice) -> list[Span]:
        """The best segmentation's entities; base spans of the lattice are among them."""
        t, k = lattice.length, len(self.moves)
        best = np.full((t + 1, k), -np.inf)
        best[0, OUTSIDE] = 0
        enter, source = np.full((t + 1, k), -np.inf), np.zeros((t + 1, k), int)
        came: list[list[int]] = [[0] * k for _ in range(t + 1)]
        fixed_at = {j: (i, kind) for (i, j), kind in lattice.fixed.items()}
        for j in range(t + 1):
            if j:
                if j - 1 in fixed_at:
                    i, kind = fixed_at[j - 1]
                    best[j, kind], came[j][kind] = enter[i, kind], i
                elif not lattice.covered[j - 1]:
                    best[j, OUTSIDE], came[j][OUTSIDE] = enter[j - 1, OUTSIDE], j - 1
                    for i, names in lattice.ending_at(j - 1):
                        way = enter[i, 1:] + self.score(names)
                        for kind in np.flatnonzero(way > best[j, 1:]) + 1:
                            best[j, kind], came[j][kind] = way[kind - 1], i
            steps = best[j][:, None] + self.moves
            source[j], enter[j] = steps.argmax(axis=0), steps.max(axis=0)
        spans, j, kind = [], t, int(best[t].argmax())
        while j > 0:
            i = came[j][kind]
            if kind != OUTSIDE:
                spans.append((KINDS[kind - 1], lattice.starts[i], lattice.ends[j - 1]))
            j, kind = i, int(source[i, kind])
        return spans[::-1]


def learn(examples: list[tuple[str, str, str, list[Span]]], steps: int = STEPS) -> Field:
    """Maximum likelihood with a quadratic penalty over regions (text, left, right, spans), by resilient steps."""
    model = Field()
    lattices: Counter = Counter()
    for text, left, right, spans in examples:
        lattice = Lattice(text, left, right)
        first, last = {s: i for i, s in enumerate(lattice.starts)}, {e: i for i, e in enumerate(lattice.ends)}
        truth = {(first[s], last[e]): KINDS.index(kind) for kind, s, e in spans if s in first and e in last}
        if len(truth) < len(spans) or lattice.length > TRAIN_TOKENS:
            continue
        segments = tuple((i, j, tuple(names), truth.get((i, j), -1)) for i, j, names in lattice.segments())
        if sum(kind >= 0 for *_, kind in segments) == len(spans):
            lattices[lattice.length, segments] += 1
    if not lattices:
        return model
    for (_, segments), _ in lattices.items():
        for _, _, names, _ in segments:
            for name in names:
                model.names.setdefault(name, len(model.names))
    k, width = len(KINDS), 14
    forms: dict[tuple, list[tuple]] = {}
    for (length, segments), count in lattices.items():
        forms.setdefault((length, tuple((i, j) for i, j, *_ in segments)), []).append((segments, count))
    # Per form: place of its segments, ends, counts. Feature numbers are padded with one that has no weight.
    parts, numbers, kept, moves_kept = [], [], [], np.zeros((k + 1, k + 1))
    for (length, places), members in forms.items():
        ends: list[list[tuple[int, int]]] = [[] for _ in range(length)]
        for n, (i, j) in enumerate(places):
            ends[j].append((i, n))
        counts = np.array([count for _, count in members], "float64")
        parts.append((len(numbers), len(numbers) + len(places) * len(members), length, ends, counts))
        for segments, count in members:
            chosen = {}
            for i, j, names, kind in segments:
                own = [model.names[n] for n in names]
                numbers.append(own + [len(model.names)] * (width - len(own)))
                kept.append([count * (kind == c) for c in range(k)])
                if kind >= 0:
                    chosen[i] = (j, kind + 1)
            place, state = 0, OUTSIDE
            while place < length:
                j, following = chosen.get(place, (place, OUTSIDE))
                moves_kept[state, following] += count
                place, state = j + 1, following
    table, kept = np.array(numbers, int).reshape(-1, width), np.array(kept, "float64").reshape(-1, k)
    weights, moves = np.zeros((len(model.names) + 1, k)), np.zeros((k + 1, k + 1))
    n_examples = sum(lattices.values())
    steps_w, steps_m = np.full(weights.shape, RATE), np.full(moves.shape, RATE)
    last_w, last_m = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(steps):
        scores = weights[table].sum(axis=1)
        share, moved = np.zeros_like(scores), np.zeros_like(moves)
        for low, high, length, ends, counts in parts:
            own_scores = scores[low:high].reshape(len(counts), -1, k)
            _, own, taken = expectations(length, ends, own_scores, moves)
            share[low:high] = (own * counts[:, None, None]).reshape(-1, k)
            moved += (taken * counts[:, None, None]).sum(axis=0)
        slope = np.zeros_like(weights)
        np.add.at(slope, table.ravel(), np.repeat(kept - share, width, axis=0))
        slope = slope / n_examples - PENALTY * weights
        slope[-1] = 0
        slope_m = (moves_kept - moved) / n_examples - PENALTY * moves
        # Resilient steps: as long as a slope keeps its sign its step grows, otherwise it shrinks.
        for value, s, last, size in ((weights, slope, last_w, steps_w), (moves, slope_m, last_m, steps_m)):
            size *= np.where(s * last > 0, 1.2, np.where(s * last < 0, 0.5, 1.0))
            np.clip(size, 1e-4, 1.0, out=size)
            value += np.sign(s) * size
            last[...] = s
    model.weights, model.moves = weights[:-1], moves
    return model


def sample(scanned: DataFrame, per_kind: int = SAMPLE) -> list[tuple[str, str, str, list[Span]]]:
    """Different regions to learn from, per kind and without any, in hash order."""
    regions = scanned.select(F.explode("regions").alias("r")).select("r.text", "r.left", "r.right", "r.base", "r.sure")
    short = regions.filter(F.col("sure") & (F.length("text") <= MAX_CHARS)).drop("sure").distinct()
    order = (F.xxhash64("text", "left", "right"), "text", "left", "right")
    of_kind = lambda kind: F.exists("base", lambda s: s["kind"] == kind)
    parts = [short.filter(F.size("base") == 0)] + [short.filter(of_kind(kind)) for kind in KINDS]
    chosen = reduce(DataFrame.union, (part.orderBy(*order).limit(per_kind) for part in parts)).distinct()
    return [(r["text"], r["left"], r["right"], [(s["kind"], s["start"], s["end"]) for s in r["base"]]) for r in chosen.orderBy(*order).collect()]


def find_spans(scanned: DataFrame, model: Field) -> DataFrame:
    """``doc_id, base, spans``: base spans and those the field adds, by kind and place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, regions in zip(batch.column("base"), batch.column("regions")):
                spans = {(s["kind"], s["start"], s["end"]) for s in base.as_py()}
                for region in regions:
                    r = region.as_py()
                    fixed = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
                    at = r["start"]
                    spans |= {(kind, at + s, at + e) for kind, s, e in model.decode(Lattice(r["text"], r["left"], r["right"], fixed))}
                order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                out.append([{"kind": k, "start": s, "end": e} for k, s, e in order])
            base = batch.column("base")
            yield pa.record_batch([batch.column("doc_id"), base, pa.array(out, base.type)], names=["doc_id", "base", "spans"])

    return scanned.select("doc_id", "base", "regions").mapInArrow(rows, f"doc_id long, base {SPANS}, spans {SPANS}")


def personal_data(documents: DataFrame, per_kind: int = SAMPLE) -> DataFrame:
    """``doc_id, base, spans`` per document, with a field learned from these documents."""
    scanned = stage(scan(documents), "regions")
    return find_spans(scanned, learn(sample(scanned, per_kind)))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
