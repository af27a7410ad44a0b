"""Document fingerprints by a randomised edit embedding.

All texts are walked by one shared sequence of random functions: at step j the walk notes the character it stands on and moves
on by one if function j says so for that character. Texts that differ by a few edits fall back into step after each, so their
edit distance becomes a Hamming distance of the notes. A fingerprint samples the notes at shared random steps; a text of twice
the length is sampled half as densely, on a subset of the steps, so that every pair of fingerprints has steps in common.
Fingerprints that agree on a band of samples are candidates, and candidates are verified on all their samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import give_back, mixed

#: Samples of a fingerprint lie about between this and twice this number; texts of fewer than SAMPLES / 2 characters have fewer.
SAMPLES = 128
#: Characters of text that are walked side by side.
BUCKET_CHARS = 12_000_000
#: Characters whose values are worked out at once.
CHUNK_CHARS = 1 << 18
#: Samples in a band.
BAND = 8
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _steps(first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For steps from ``first`` on: an odd multiplier, and the sparsest level that samples the step (its trailing zeros)."""
    noise = mixed(np.arange(first, first + count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567))
    multipliers = (noise >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    low = noise & np.uint64(0xFFFFFFF) | np.uint64(1 << 28)
    return multipliers, np.log2((low & (~low + np.uint64(1))).astype(float)).astype(np.int8)


def level_of(n_chars: np.ndarray) -> np.ndarray:
    """Steps with that many trailing zeros are sampled; a text of n characters is walked in about 2 n steps."""
    return np.maximum(0, np.floor(np.log2(np.maximum(1, 2 * n_chars) / SAMPLES))).astype(np.int64)


def _values(texts: list[str], count: int) -> np.ndarray:
    """An odd number for every character of the texts, each of which is followed by one more character; some texts at a time."""
    values, done, some, held = np.empty(count, np.uint32), 0, [], 0
    for k, text in enumerate(texts):
        some.append(text)
        held += len(text)
        if held >= CHUNK_CHARS or k + 1 == len(texts):
            codes = np.frombuffer(("\0".join(some) + "\0").encode("utf-32-le"), np.uint32)
            for at in range(0, len(codes), CHUNK_CHARS):
                part = codes[at:at + CHUNK_CHARS]
                values[done:done + len(part)] = (mixed(part.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                done += len(part)
            some, held = [], 0
    return values


def fingerprints(texts: list[str]) -> list[str]:
    """``LL:hhhh...``: the level in decimal, then a hex digit (four bits of a hash of the character) per sampled step."""
    n_chars = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-n_chars, kind="stable")
    begins = np.concatenate([[0], np.cumsum(n_chars + 1)])[:-1]
    values = _values(texts, int(n_chars.sum()) + len(texts))
    values[begins + n_chars] = 0  # the end of a text: every function stays there
    levels = level_of(n_chars)
    lanes, at = order, begins[order]
    own = levels[lanes]
    noted_lanes, noted = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    step, block = 0, 64
    while True:
        going = values[at] != 0
        if not going.all():
            lanes, at, own = lanes[going], at[going], own[going]
        if not len(lanes):
            break
        multipliers, zeros = _steps(step, block)
        # Lanes are sorted by length, so those that sample a step are the last ones.
        since = np.searchsorted(-own, -zeros.astype(np.int64), "left")
        here, moves, count = np.empty(len(at), np.uint32), np.empty(len(at), np.uint32), len(at)
        for k in range(block):
            np.take(values, at, out=here, mode="clip")
            if since[k] < count:
                noted_lanes.append(lanes[since[k]:])
                noted.append(here[since[k]:].copy())
            np.multiply(here, multipliers[k], out=moves)
            np.right_shift(moves, 31, out=moves)
            np.add(at, moves, out=at, casting="unsafe")
        step += block
    of, symbols = np.concatenate(noted_lanes), np.concatenate(noted)
    inside = symbols != 0
    of, symbols = of[inside], symbols[inside]
    sorted_by = np.argsort(of, kind="stable")
    digits = HEX[(symbols[sorted_by] >> np.uint32(16)) & np.uint32(15)].tobytes().decode()
    ends = np.cumsum(np.bincount(of, minlength=len(texts)))
    starts = np.concatenate([[0], ends[:-1]])
    return [f"{level:02d}:{digits[a:b]}" for level, a, b in zip(levels.tolist(), starts.tolist(), ends.tolist())]


_places: dict[tuple[int, int], np.ndarray] = {}


def _kept(level: int, coarser: int, count: int) -> np.ndarray:
    """Which of the first ``count`` samples of a level the coarser level has too."""
    known = _places.get((level, coarser), np.zeros(0, bool))
    steps = 1 << 12
    while len(known) < count:
        zeros = _steps(0, steps)[1]
        known = _places[level, coarser] = zeros[zeros >= level] >= coarser
        steps *= 4
    return known[:count]


def likeness(one: str, other: str) -> float:
    """Share of the common sampled steps on which two fingerprints agree; 1 for equal ones, steps past one's end differ."""
    if one == other:
        return 1.0
    sides = []
    coarser = max(int(one[:2]), int(other[:2]))
    for print_ in (one, other):
        digits = np.frombuffer(print_[3:].encode(), np.uint8)
        level = int(print_[:2])
        sides.append(digits if level == coarser else digits[_kept(level, coarser, len(digits))])
    short, long = sorted((len(s) for s in sides))
    return float(np.count_nonzero(sides[0][:short] == sides[1][:short]) / long) if long else 0.0


def bands(print_: str, width: int = BAND) -> list[str]:
    """Keys of the whole bands of a fingerprint, on its own level and on the next coarser one."""
    level, digits = int(print_[:2]), np.frombuffer(print_[3:].encode(), np.uint8)
    found = []
    for at in (level, level + 1):
        kept = digits if at == level else digits[_kept(level, at, len(digits))]
        text = kept.tobytes().decode()
        found += [f"{at}:{k}:{text[k:k + width]}" for k in range(0, len(text) - width + 1, width)]
    return found or [print_]


def _bucketed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, text, bucket, tail: documents in buckets of neighbouring ids, descending; a bucket's tail is what follows it."""
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-chars // BUCKET_CHARS))
    shares = [k / count for k in range(1, count)]
    # Quantiles come as fractions; which whole numbers they are rounded to doesn't matter, as long as every row is held against the same.
    bounds = np.array(sorted({int(q) for q in rows.approxQuantile("doc", shares, 0.1 / count)}) if shares else [], np.int64)

    def bucket_of(ids: pa.Array) -> np.ndarray:
        """Buckets by descending id; null ids are in the last one."""
        found = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
        found[ids.is_null().to_numpy(zero_copy_only=False)] = len(bounds)
        return found.astype(np.int32)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bucket_of(batch.column(0)))], ["doc", "bucket"])

    # Ids that stand first in their bucket are also wanted by the bucket before.
    first_ids = rows.select("doc").mapInArrow(numbered, "doc long, bucket int").groupBy("bucket").agg(F.max("doc").alias("doc"))
    firsts = {r.bucket: r.doc for r in first_ids.toLocalIterator()}
    present = sorted(firsts)
    wanted: dict[int | None, int] = {firsts[b]: present[k - 1] for k, b in enumerate(present)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "text", "bucket", "tail"]
        for batch in batches:
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(bucket_of(ids)), pa.array(np.zeros(len(ids), bool))], names)
            known = ids.to_pylist()
            also = [k for k, i in enumerate(known) if i in wanted]
            if also:
                some = pa.array(also)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(some), batch.column(1).take(some), pa.array([wanted[known[k]] for k in also], pa.int32()), pa.array([True] * len(also))], names)

    return rows.mapInArrow(placed, "doc long, text string, bucket int, tail boolean")


def document_prints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the next document's, by
    descending id; after the last comes the first. Null texts are empty; null ids come last; rows that share an id are ordered by
    their text, and repeated rows follow each other. One document alone is its own next. Only id and text are read.
    """

    def walk(group: pa.Table) -> pa.Table:
        rows = sorted(
            zip(group["tail"].to_pylist(), group["doc"].to_pylist(), group["text"].to_pylist()),
            key=lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2]))
        own = [r for r in rows if not r[0]]
        after = next((r for r in rows if r[0]), own[0] if own else None)
        out: dict[str, list] = {n: [] for n in (doc, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        texts = [r[2] for r in own]
        following = texts[1:] + [after[2]] if own else []
        edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, following)]
        prints = fingerprints(texts + edited + following[-1:]) if own else []
        count = len(texts)
        for k in range(count):
            mine, changed = prints[k], prints[count + k]
            beside = prints[k + 1] if k + 1 < count else prints[-1]
            values = (own[k][1], len(texts[k]), hashlib.sha256(edited[k].encode()).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, beside))
            for column, value in zip(out.values(), values):
                column.append(value)
        del rows, own, texts, following, edited, prints
        give_back()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array(v, kind) for (n, v), kind in zip(out.items(), kinds)})

    return _bucketed(docs, doc, text).groupBy("bucket").applyInArrow(
        walk, f"`{doc}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_documents(prints: DataFrame, doc: str = "doc_id", fingerprint: str = "fingerprint", least: float = 0.8) -> DataFrame:
    """Verified links ``doc, leader, likeness``: documents whose fingerprints share a band with a document of smaller id.

    The leader of a band is its smallest id, found by aggregation, so a band shared by a third of the documents gives one link
    for each of them; links under ``least`` are dropped. Null ids are left out.
    """
    rows = prints.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(fingerprint).alias("print"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = [], []
            for d, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = bands(p)
                docs += [d] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.string())], ["doc", "key"])

    keys = rows.mapInArrow(keyed, "doc long, key string").select("doc", F.xxhash64("key").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).where("leader < last").drop("last")
    links = keys.join(leaders, "key").where("doc > leader").select("doc", "leader").distinct()
    paired = links.join(rows, "doc").join(rows.toDF("leader", "leader_print"), "leader")

    @F.pandas_udf("double")
    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([likeness(a, b) for a, b in zip(one, other)], dtype="float64")

    return paired.select("doc", "leader", alike("print", "leader_print").alias("likeness")).where(F.col("likeness") >= least)
