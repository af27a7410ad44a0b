"""What several operators share: staged tables, word hashes, bounded bitmaps, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import scratch_dir

#: Bytes of text hashed at once; a longer single text is hashed alone.
CHUNK_BYTES = 1 << 19
#: A bitmap never has more than 2 ** 26 bits (8 MB), however many hashes it holds.
MOST_BITS_LOG2 = 26

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write the rows to the shared folder and read them again: the lineage ends there."""
    return stage_in(df, purpose)[0]


def stage_in(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """The staged rows, and the folder they lie in."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write under the shared folder; one is named here only where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoints"))


def give_back() -> None:
    """Return freed memory to the system: workers of Python stay for later stages, and what they once needed would stay with them."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Rows go to Python in batches of so many, for jobs that run inside: whole texts and long lists make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more: it does when the driver collects its garbage, which may be late."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """The name, or the name with underscores after it, that no column of the frame has in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


# ---- words and hashes, many texts at a time ------------------------------------------------------


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = values.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < size:
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(max(size, CHUNK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        if size > CHUNK_BYTES + 1:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def byte_rules(separator: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it ends words, and its value in a hash (A-Z as a-z if ``lower``)."""
    ends = np.zeros(256, bool)
    ends[list(separator)] = True
    values = _BYTE_VALUES.copy()
    if lower:
        values[65:91] = values[97:123]
    return ends, values


#: Words are what lies between ASCII white space; A-Z count as a-z.
PLAIN_WORDS = byte_rules(b" \t\n\v\f\r", lower=True)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about CHUNK_BYTES: first index, index after the last, bytes, where each text begins (and the end)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, len(texts))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte after its last; no word goes beyond its text."""
    inside = ~ends[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = begins[:-1][begins[:-1] < begins[1:]]
    opens[firsts] = inside[firsts]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    lasts = firsts[1:] - 1
    closes[lasts] = inside[lasts]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of stretches of bytes, all from one running sum."""
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[:len(data)], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * inverses[starts])


def word_hashes(data: np.ndarray, begins: np.ndarray, rules=PLAIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each text's words begin (and the end)."""
    ends, values = rules
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(begins), np.int64)
    starts, stops = word_spans(data, begins, ends)
    return span_hashes(data, starts, stops, values), np.searchsorted(starts, begins)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` values; runs over the end of a text must be left out by the caller."""
    count = max(0, len(hashes) - size + 1)
    total = np.zeros(count, np.uint64)
    for place in range(size):
        total += hashes[place:place + count] * _PLACE_VALUES[place]
    return mixed(total)


def shingle_sets(texts: pa.Array, size: int, rules=PLAIN_WORDS) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``size`` words as sorted hashes.

    A text with fewer words has its whole sequence as one shingle; a null text or one without words has none.
    """
    for first, last, data, begins in text_chunks(texts):
        hashes, at = word_hashes(data, begins, rules)
        runs = windows(hashes, size)
        for k in range(last - first):
            a, b = int(at[k]), int(at[k + 1])
            if b - a >= size:
                yield np.unique(runs[a:b - size + 1])
            elif b > a:
                yield windows(hashes[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)


# ---- bitmaps of bounded size ---------------------------------------------------------------------


def bitmap(df: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """The hashes of a column as bits of a table with at most 2 ** MOST_BITS_LOG2 bits, and the log of its size.

    A full table lets more rows through, it never hides one: what it admits has to be joined exactly.
    """
    rows = df.select(F.col(column).cast("long").alias("h"))
    count = rows.count()
    log2 = int(min(MOST_BITS_LOG2, max(16, np.ceil(np.log2(max(1, count) * 64)))))
    words = (
        rows.select(F.expr(f"shiftrightunsigned(h, {64 - log2})").alias("place"))
        .select(F.expr("shiftright(place, 6)").alias("w"), F.expr("shiftleft(1L, cast(place & 63 AS int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    bits = np.zeros(1 << (log2 - 6), np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return bits, log2


def in_bitmap(table: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    bits, log2 = table
    place = hashes >> np.uint64(64 - log2)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def split_by_texts(docs: DataFrame, text: str, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose text's hash is in the bitmap of ``h1`` of ``named``, and all others.

    Columns are called c0, c1 and so on; the first frame has ``h1`` and ``h2`` too, see ``text_hashes``, to be compared exactly.
    So only rows that are named, and few others, need a shuffle.
    """
    spark, at = docs.sparkSession, len(docs.columns)
    table = spark.sparkContext.broadcast(bitmap(named, "h1"))
    names = [f"c{k}" for k in range(at)]
    h1, h2 = text_hashes(text)
    hashed = docs.select("*", h1.alias("_h1"), h2.alias("_h2")).toDF(*names, "h1", "h2")

    def those(inside: bool):
        def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(table.value, batch.column(at).to_numpy().view(np.uint64)) == inside))
        return hashed.mapInArrow(admit, hashed.schema)

    return those(True), those(False).select(*names)


def without_texts(docs: DataFrame, text: str, gone: DataFrame) -> DataFrame:
    """The rows, as they are, whose text is none of those hashed in ``gone`` (h1 and h2, see ``text_hashes``)."""
    those, others = split_by_texts(docs, text, gone)
    kept = those.join(gone.select("h1", "h2"), ["h1", "h2"], "left_anti")
    return others.unionByName(kept.select(*others.columns)).toDF(*docs.columns)


def text_hashes(text: str) -> tuple[Column, Column]:
    """128 bits that stand for a text; a null text counts as one of its own."""
    return F.xxhash64(F.lit(1), F.col(text)), F.xxhash64(F.lit(2), F.col(text), F.length(text))


# ---- connected components ------------------------------------------------------------------------


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root`` for every node of the links; the root is the smallest node that can be reached.

    Alternates large-star and small-star steps, each a grouped minimum and a join, so that the neighbours of a hot node are
    never gathered in one place. Every step ends in a checkpoint in the shared folder.
    """
    spark = links.sparkSession
    ensure_checkpoints(spark)
    pairs = (
        links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u is not null and v is not null and u <> v")
        .distinct().checkpoint()
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
