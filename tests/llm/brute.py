"""Plain versions of the operators, row by row and all against all, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = b" \t\n\x0b\x0c\r"
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(texts: list[bytes], length: int) -> list[tuple]:
    """(bytes, removed, spans, digest of the rest) per text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def kept_lines(rows: list[tuple[int, str | None]], least: int = 10) -> dict[tuple, tuple]:
    """(id, text) -> (lines, dropped, kept text)."""
    key = lambda line: line.encode().strip(SPACE).decode().translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i, text] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def words(text: str | None) -> list[str]:
    return [w for w in BETWEEN.split((text or "").translate(LOWER)) if w]


def hits(text: str | None, benchmark: list[tuple[int, str | None]], width: int = 10) -> tuple[int, int, list[str]]:
    """(words, words hit, ids of items found as sorted strings)."""
    own, gone, found = words(text), set(), set()
    for item, passage in benchmark:
        w = words(passage)
        for s in range(max(len(w) - width, 0) + 1 if w else 0):
            window = w[s : s + width]
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    gone.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(own), len(gone), sorted(found)


def repeated_words(texts: list[str], width: int) -> list[int]:
    """Per text: words in any ``width`` neighbouring ones that occur again."""
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in all_words for i in range(len(w) - width + 1))
    return [
        len({j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}) for w in all_words
    ]


def fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows: list[tuple[int, int]], radius: int = 2) -> dict[int, int]:
    """id -> smallest id reachable over fingerprints within the radius."""
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def maximal(turns: list[tuple]) -> set:
    """Ids of conversations that are no prefix of a longer one, the smallest of equal ones."""
    order = lambda t: tuple((x is not None, x if x is not None else 0) for x in t[1:])
    talks = defaultdict(list)
    for t in sorted(turns, key=order):
        talks[t[0]].append(t[2:])
    rank = lambda c: (c is not None, c or 0)
    return {
        c for c, own in talks.items()
        if not any(len(o) > len(own) and o[: len(own)] == own or o == own and rank(d) < rank(c) for d, o in talks.items())
    }
