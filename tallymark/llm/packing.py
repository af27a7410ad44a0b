"""Packing: documents into sequences of a fixed number of tokens by non-negative least squares.

Every document's ids, with an end id, are cut into pieces that fill a window and one rest. The lengths of the rests form a
histogram of fewer than ``window`` bars. Shallow combinations of lengths that fill a window are enumerated, their repeat
counts are solved against the histogram by non-negative least squares and rounded down, and what is left is packed greedily.
The plan is a function of the histogram alone, so its size does not depend on the number of documents; pieces find their place
in it by their rank among the pieces of the same length, which is counted in salted groups.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm.common import stage

WINDOW = 2048
END_ID = 1
#: Groups that the pieces of one length are ranked in; of full windows, most pieces of long texts, as many as this many pieces need.
SALTS = 64
SALTED_PIECES = 100_000
#: Lengths in one combination at most; more only where the greedy step packs what is left.
DEPTH = 4
#: Second lengths tried for each longest length.
TRIES = 12
#: Words whose ids a task remembers: so many lately used ones, and as many used before those.
MEMORY = 300_000

PIECES = "row long, start long, length long, ids_crc32 long, doc_tokens long"


# ---- ids -----------------------------------------------------------------------------------------

#: Texts that hold one of these are encoded whole: special strings, separators that Python and the pattern see differently.
_WHOLE = re.compile("<\\||[\x1c-\x1f᠎​﻿]")
#: Words beyond these letters are encoded by the tokenizer's own normaliser.
_FAR = re.compile("[^\x00-ɏ]")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for characters from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def encoder(definition: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts by a tokenizer's JSON definition, the same as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Where the definition is a byte-level BPE over lower-cased words that drops white space, each distinct word goes through the
    model once and is remembered, until the function is called without texts; any other definition encodes whole texts.
    """
    import json

    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    parts = json.loads(definition)
    split = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    by_word = (
        [n.get("type") for n in (parts.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and [s.get("type") for s in split] == ["Split", "ByteLevel"] and split[0].get("invert") and split[0].get("behavior") == "Removed"
        and not split[1].get("add_prefix_space") and not split[1].get("use_regex")
        and r"\s" in split[0]["pattern"].get("Regex", "") and not parts.get("post_processor")
    )

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    if not by_word:
        return lambda texts: [whole(t) for t in texts]
    pieces = regex.compile(split[0]["pattern"]["Regex"]).findall
    letters, model = _byte_letters(), tokenizer.model
    packed = struct.Struct

    def as_bytes(ids) -> bytes:
        return packed(f"<{len(ids)}I").pack(*ids)

    class Memory(dict):
        """Ids by word. When MEMORY words are in, they become the older half, and words used again come back from there."""

        def __init__(self, make) -> None:
            super().__init__()
            self.make, self.older = make, {}

        def forget(self) -> None:
            self.clear()
            self.older = {}

        def __missing__(self, text: str) -> bytes:
            found = self.older.get(text)
            if found is None:
                found = self.make(text)
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[text] = found
            return found

    def stem(text: str) -> bytes:
        name = text if text.isascii() and text.isalnum() else "".join([letters[b] for b in text.encode()])
        return as_bytes([t.id for t in model.tokenize(name)])

    def word(text: str) -> bytes:
        if not text.isascii() and (_FAR.search(text) or not unicodedata.is_normalized("NFC", text)):
            return as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)
        return stems[text] if text.isalpha() else b"".join([stems[part] for part in pieces(text)])

    stems, words = Memory(stem), Memory(word)

    def encode(text: str) -> np.ndarray:
        if _WHOLE.search(text) or "Σ" in text:
            return whole(text)
        return np.frombuffer(b"".join(map(words.__getitem__, text.lower().split())), "<u4")

    def encode_all(texts: list[str]) -> list[np.ndarray]:
        if not texts:  # the task is over
            words.forget()
            stems.forget()
        return [encode(t) for t in texts]

    return encode_all


def pieces_of(docs: DataFrame, text: str, row: str, definition: str, end_id: int, window: int) -> DataFrame:
    """Cut every text's ids, with the end id after them, into pieces of a window and one rest."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(shared.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out: tuple[list, ...] = ([], [], [], [], [])
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                for key, ids in zip(part.column(0).to_pylist(), encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start:start + window]
                        for column, value in zip(out, (key, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["row", "start", "length", "ids_crc32", "doc_tokens"])
        encode([])

    return docs.select(F.col(row).cast("long").alias("row"), F.col(text).cast("string").alias("text")).mapInArrow(cut, PIECES)


# ---- plan ----------------------------------------------------------------------------------------


def combinations(lengths: np.ndarray, window: int, depth: int = DEPTH, tries: int = TRIES) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` present lengths, longest first, each filled up with the longest that fit."""
    present = np.sort(lengths)
    found: set[tuple[int, ...]] = set()

    def fill(chosen: list[int]) -> None:
        room = window - sum(chosen)
        while len(chosen) < depth:
            at = int(np.searchsorted(present, min(room, chosen[-1]), "right")) - 1
            if at < 0:
                break
            chosen.append(int(present[at]))
            room -= chosen[-1]
        found.add(tuple(chosen))

    for longest in present[::-1].tolist():
        fill([longest])
        high = int(np.searchsorted(present, min(longest, window - longest), "right"))
        for second in present[np.unique(np.linspace(0, high - 1, tries).astype(int))].tolist() if high else ():
            fill([longest, second])
    return sorted(found, reverse=True)


def least_squares(rows: np.ndarray, columns: np.ndarray, wanted: np.ndarray, count: int, rounds: int = 400) -> np.ndarray:
    """Non-negative x that brings A x close to ``wanted``; A has a one for each (row, column), twice the pair counts two.

    Projected gradient steps with momentum, started again whenever the momentum points uphill.
    """
    x = np.zeros(count)
    # The largest singular value by power iteration gives the step.
    probe = np.ones(count)
    norm = 1.0
    for _ in range(30):
        image = np.bincount(rows, probe[columns], len(wanted))
        probe = np.bincount(columns, image[rows], count)
        norm = max(np.linalg.norm(probe), 1e-12)
        probe /= norm
    ahead, pace = x.copy(), 1.0
    for _ in range(rounds):
        residual = np.bincount(rows, ahead[columns], len(wanted)) - wanted
        gradient = np.bincount(columns, residual[rows], count)
        following = np.maximum(0, ahead - gradient / (norm * 1.01))
        if np.dot(ahead - following, following - x) > 0:
            pace = 1.0
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = following + (pace - 1) / next_pace * (following - x)
        x, pace = following, next_pace
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with how often each is used; together they take every piece of the histogram exactly once."""
    left = {int(k): int(v) for k, v in histogram.items() if v}
    chosen: list[tuple[tuple[int, ...], int]] = []
    if left.get(window):
        chosen.append(((window,), left.pop(window)))
    if not left:
        return chosen
    lengths = np.array(sorted(left))
    place = {int(length): k for k, length in enumerate(lengths)}
    tried = combinations(lengths, window)
    # A combination that leaves room costs as much as the pieces it lacks: it is solved for last by weighing it down.
    full = [c for c in tried if sum(c) >= window - window // 64] or tried
    rows = np.array([place[length] for c in full for length in c])
    columns = np.repeat(np.arange(len(full)), [len(c) for c in full])
    wanted = np.array([left[int(length)] for length in lengths], float)
    solved = np.floor(least_squares(rows, columns, wanted, len(full)) + 1e-9).astype(np.int64)
    for k in sorted(range(len(full)), key=lambda k: (-sum(full[k]), -solved[k], full[k])):
        used = min([int(solved[k])] + [left[length] // full[k].count(length) for length in full[k]])
        if used > 0:
            chosen.append((full[k], used))
            for length in full[k]:
                left[length] -= used
    # Greedy: the longest piece left, then always the longest that still fits; repeated as long as the pieces last.
    present = sorted(k for k, v in left.items() if v)
    while present:
        counts: dict[int, int] = {}
        room, top = window, len(present)
        while top > 0:
            top = int(np.searchsorted(present[:top], room, "right"))
            if top == 0:
                break
            length = present[top - 1]
            fits = min(room // length, left[length])
            counts[length] = fits
            room -= fits * length
            top -= 1
        used = min(left[length] // n for length, n in counts.items())
        chosen.append((tuple(length for length, n in counts.items() for _ in range(n)), used))
        for length, n in counts.items():
            left[length] -= used * n
        present = [k for k in present if left[k]]
    return chosen


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan as runs: pieces of one length with ranks from ``rank`` on lie at ``offset`` of the sequences from ``first`` on.

    The runs of a length are sorted by rank; ``key`` is length * 2 ** 44 + rank, so one search finds a piece's run.
    """
    runs, ranks, sequence = [], {}, 0
    for combination, used in planned:
        offset = 0
        for length in combination:
            rank = ranks.get(length, 0)
            runs.append((length * (1 << 44) + rank, rank, sequence, offset))
            ranks[length] = rank + used
            offset += length
        sequence += used
    columns = np.array(sorted(runs), np.int64).reshape(-1, 4).T
    return dict(zip(("key", "rank", "first", "offset"), columns))


def pack(docs: DataFrame, text: str, row: str, definition: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece: row, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``definition`` is a tokenizer's JSON; ``row`` names a whole-number column. Null and empty texts are one end id; rows that
    share a number are packed as rows of their own; null numbers stay null; an empty table gives no pieces. Only ``row`` and
    ``text`` are read, so other columns may have any names.
    """
    pieces = stage(pieces_of(docs, text, row, definition, end_id, window), "pieces")
    full = F.col("length") == window
    salts_of_full = max(SALTS, pieces.where(full).count() // SALTED_PIECES)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "start", "ids_crc32"), F.when(full, salts_of_full).otherwise(SALTS)).cast("int"))
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).orderBy("length", "salt").toArrow()
    lengths, salts, counts = (counted[c].to_numpy() for c in ("length", "salt", "n"))
    histogram = {int(length): int(counts[lengths == length].sum()) for length in np.unique(lengths)}
    # A row of counts for each length; the one of full windows is as long as it has groups.
    starts = np.arange(window + 1) * SALTS
    before = np.zeros(window * SALTS + salts_of_full, np.int64)
    before[starts[lengths] + salts] = counts
    for length in range(window + 1):
        own = slice(starts[length], starts[length] + (salts_of_full if length == window else SALTS))
        before[own] = np.cumsum(before[own]) - before[own]
    runs = places(plan(histogram, window))
    shared = docs.sparkSession.sparkContext.broadcast((before, runs))
    names = ["row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs = shared.value
        for batch in batches:
            length, salt, at = (batch.column(c).to_numpy() for c in ("length", "salt", "at"))
            rank = at - 1 + before[length * SALTS + salt]
            run = np.searchsorted(runs["key"], length * (1 << 44) + rank, "right") - 1
            sequence = runs["first"][run] + rank - runs["rank"][run]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names[:5]] + [pa.array(sequence), pa.array(runs["offset"][run])], names)

    ranked = salted.withColumn("at", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("row", "start", "ids_crc32")).cast("long"))
    return ranked.mapInArrow(put, PIECES + ", sequence_id long, offset long")


def tokenizer_definition(path: str) -> str:
    """A tokenizer's JSON from the driver's disk; it is broadcast, so executors need no copy."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def default_tokenizer() -> str:
    import public_tokenizers

    return tokenizer_definition(public_tokenizers.path("word_bpe_49k.json"))


def packed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``pack`` over doc_id and text with the public tokenizer."""
    return pack(docs, "text", "doc_id", default_tokenizer()).withColumnRenamed("row", "doc_id")
