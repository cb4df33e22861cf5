"""Subword encoding: words are cut into the longest known pieces from left to right.

The pieces and their ids come from a given vocabulary (a tokenizer's file, or any table); none is learned here. They
are held as tries, so that a word is read once. Three ways of marking pieces are known: none (a piece may stand
anywhere), a prefix of pieces that continue a word (``##``) and a suffix of pieces that end one (``</w>``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelwise.functions.text import words
from levelwise.operators.encode import END, MAX_LENGTH, MAX_VOCABULARY, PAD, SPECIAL_IDS, START, UNKNOWN
from levelwise.operators.encoder import per_worker

# Different words whose pieces a worker remembers at a time.
REMEMBERED = 200_000


def read_pieces(spark: SparkSession, path: str, shift: int = SPECIAL_IDS) -> DataFrame:
    """``(token, token_id)`` of a tokenizer's JSON file; ids are moved past the special ones."""
    vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    return spark.createDataFrame([(piece, number + shift) for piece, number in vocabulary.items()], "token string, token_id int")


def piece_tries(pieces: dict[str, int], continuing: str = "", ending: str = "") -> tuple[dict, dict, dict | None]:
    """Tries of the pieces that may start a word, of those that may go on, and of those that must end one.

    A trie maps a character to the trie below it and ``""`` to the id of the piece that ends there.
    """
    first, inner, last = {}, {}, {}

    def put(trie: dict, piece: str, number: int) -> None:
        for char in piece:
            trie = trie.setdefault(char, {})
        trie[""] = number

    for piece, number in pieces.items():
        if ending:
            if piece.endswith(ending) and piece != ending:
                put(last, piece[: -len(ending)], number)
            elif piece != ending:
                put(first, piece, number)
        elif continuing:
            inside = piece.startswith(continuing) and piece != continuing
            put(inner if inside else first, piece[len(continuing) :] if inside else piece, number)
        elif piece:
            put(first, piece, number)
    return first, (inner if continuing else first), (last if ending else None)


def cut_word(word: str, first: dict, inner: dict, last: dict | None, unknown: int = UNKNOWN) -> list[int]:
    """Ids of the longest pieces from left to right; a word with a place where no piece fits is one unknown id."""
    out, at = [], 0
    while at < len(word):
        best, end = None, at
        for trie, to_end in ((inner if at else first, False), (last, True)):
            node, i = trie, at
            while node is not None and i < len(word):
                node = node.get(word[i])
                i += 1
                if node is None:
                    break
                # A piece that must end the word fits there only; one that need not fits short of it if such exist.
                fits = i == len(word) if to_end else last is None or i < len(word)
                if "" in node and fits and i > end:
                    best, end = node[""], i
        if best is None:
            return [unknown]
        out.append(best)
        at = end
    return out


def encode_pieces(
    df: DataFrame, pieces: DataFrame, id_col: str = "id", text: str = "text", max_length: int = MAX_LENGTH, continuing: str = "", ending: str = "",
) -> DataFrame:
    """``id, input_ids, attention_mask`` with fixed-length arrays of piece ids.

    Words are cut to the ``max_length - 2`` that could fit before they leave the JVM; a word that occurs often is cut
    into pieces once per worker. Row-wise: repeated and null ids keep rows of their own, null text has no pieces.
    """
    if max_length < 3:
        raise ValueError("max_length must leave room for start, end and one piece")
    table = pieces.select("token", "token_id").limit(MAX_VOCABULARY + 1).collect()
    if len(table) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of pieces holds at most {MAX_VOCABULARY} of them")
    known = {r["token"]: r["token_id"] for r in table}
    # Pieces travel once per executor, not with every task.
    sent = df.sparkSession.sparkContext.broadcast(known)
    key = f"pieces_{uuid.uuid4().hex}"

    def load() -> tuple[tuple, dict]:
        return piece_tries(sent.value, continuing, ending), {}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, seen = per_worker(key, load)
        for batch in batches:
            lists = batch.column(1)
            offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            tokens = lists.flatten().to_pylist()
            ids = np.full((batch.num_rows, max_length), PAD, "int32")
            mask = np.zeros((batch.num_rows, max_length), "int32")
            for row in range(batch.num_rows):
                own = [START]
                for word in tokens[offsets[row] : offsets[row + 1]]:
                    found = seen.get(word)
                    if found is None:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        found = seen[word] = cut_word(word, *tries)
                    own += found
                    if len(own) >= max_length:
                        break
                own = [*own[: max_length - 1], END]
                ids[row, : len(own)] = own
                mask[row, : len(own)] = 1
            ends = pa.array(np.arange(batch.num_rows + 1, dtype="int32") * max_length)
            arrays = [pa.ListArray.from_arrays(ends, pa.array(a.ravel())) for a in (ids, mask)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, "input_ids", "attention_mask"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, F.slice(words(text), 1, max_length - 2).alias("_words"))
    return rows.mapInArrow(encode, f"`{id_col}` {kind}, input_ids array<int>, attention_mask array<int>")
