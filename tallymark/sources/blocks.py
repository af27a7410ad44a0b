"""State that runs through a file which is read in blocks: what stands before a block, from what every block alone adds up to.

A file that is split among tasks can still be read as one stream of marks. Each block says how it changes the state; a sum over the blocks
before, a few rows a file, says in which state a block begins. Blocks are those of the scan, so there are as many tasks as it has splits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = ("file", "block")


def pieces(spark: SparkSession, path: str | Sequence[str], mark: str) -> DataFrame:
    """file, block, at (the order within a block) and value: the text up to each ``mark``, which may be any character.

    A piece belongs to the block it begins in, wherever its mark is; of one block all pieces are read by one task, in order.
    """
    return spark.read.option("lineSep", mark).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def before_blocks(sums: DataFrame, *names: str) -> DataFrame:
    """The same rows, one a block, with each figure summed over the blocks before instead."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*BLOCK, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names))


def within_blocks(value: Column) -> Column:
    """A running sum from the beginning of the block up to the row before."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


# ---- records that tasks put together from pieces, and those that reach over the end of a block --------------

#: A record that lies in its block, the rest of one begun earlier, the beginning of one that goes on, a block that is all inside one.
WHOLE, REST, BEGUN, MIDDLE = range(4)
_FIELDS = (("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("first", pa.bool_()), ("record", pa.string()))


def assembled(cut: DataFrame, reader: Callable[[str, int], Callable[[str], str | None]], glue: str) -> DataFrame:
    """file, first (of its file) and record, from the pieces of every block.

    ``reader(file, block)`` gives a function for one block, with an attribute ``inside`` that says whether it begins within a record; it takes
    one piece after the other, and returns a record's last piece or None where the record goes on. Records whose pieces lie in one
    block are put together by the task that reads it; of the others only the pieces travel, to be joined by ``glue``.
    """

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], []
        take, rest, first = None, False, False

        def give(kind: int) -> None:
            nonlocal first
            record = glue.join(held)
            if kind in (REST, MIDDLE) or record.strip():
                found.append((*at, kind, first, record))
                first = False
            held.clear()

        for batch in batches:
            for file, block, piece in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if at != (file, block):
                    if held:
                        give(MIDDLE if rest else BEGUN)
                    at, take = (file, block), reader(file, block)
                    rest, first = take.inside, block == 0
                last = take(piece)
                held.append(piece if last is None else last)
                if last is not None:
                    give(REST if rest else WHOLE)
                    rest = False
            yield rows(found)
            found.clear()
        if held:
            give(MIDDLE if rest else BEGUN)
            yield rows(found)

    made = cut.select("file", "block", "value").mapInArrow(read, "file string, block long, kind int, first boolean, record string")
    # In a block the rest of an earlier record comes before one that it leaves open.
    number = F.sum(F.when(F.col("kind") == BEGUN, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", F.col("kind") == BEGUN))
    joined = made.where(F.col("kind") != WHOLE).withColumn("number", number).groupBy("file", "number").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == BEGUN).alias("begins"), "record"))).alias("parts"))
    return made.where(F.col("kind") == WHOLE).select("file", "first", "record").unionByName(
        joined.select("file", "first", F.array_join("parts.record", glue).alias("record")))


# ---- delimited text with line breaks in quotes -----------------------------------------------------------------


class _QuotedLines:
    """Lines up to the one at whose end no quote is open."""

    def __init__(self, inside: bool) -> None:
        self.inside = self.open = inside

    def __call__(self, line: str) -> str | None:
        self.open ^= bool(line.count('"') & 1)
        return None if self.open else line


def quoted_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The records of delimited text: lines joined until their quotes are closed. Blank ones are left out."""
    lines = pieces(spark, paths, "\n")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    sums = lines.groupBy(*BLOCK).agg(F.sum(quotes).alias("quotes"))
    # One entry for each block that begins inside quotes: no more than the scan has splits, whatever the number of lines.
    inside = spark.sparkContext.broadcast({(r.file, r.block) for r in before_blocks(sums, "quotes").where("quotes % 2 = 1").toLocalIterator()})
    found = assembled(lines, lambda file, block: _QuotedLines((file, block) in inside.value), "\n")
    return found.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_quoted(spark: SparkSession, paths: Sequence[str], sep: str, schema: T.StructType) -> DataFrame:
    """The files' rows by ``schema``, whose names are the header; a header that differs is an error."""
    records = quoted_records(spark, paths)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}

    def cells(kinds: Sequence[str]) -> Column:
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` {kind}" for f, kind in zip(schema.fields, kinds))
        return F.from_csv("record", ddl, options).alias("cells")

    names = [f.name for f in schema.fields]
    for row in records.where("first").select(cells(["string"] * len(names))).distinct().toLocalIterator():
        if [str(n).casefold() for n in row.cells] != [n.casefold() for n in names]:
            raise ValueError(f"a file has the header {list(row.cells)}, another {names}")
    return records.where("not first").select(cells([f.dataType.simpleString() for f in schema.fields])).select("cells.*")


# ---- arrays of JSON objects --------------------------------------------------------------------------------------

_ESCAPED = re.compile(r"\\.")


def _outside(piece: str, quoted: bool) -> tuple[list[str], bool]:
    """The parts of a piece that are in no string, and whether a string is open at its end."""
    parts = _ESCAPED.sub("", piece).split('"')
    return parts[1 if quoted else 0::2], quoted ^ bool((len(parts) - 1) & 1)


def _steps(parts: list[str]) -> int:
    """By how much brackets change the depth."""
    return sum(p.count("[") + p.count("{") - p.count("]") - p.count("}") for p in parts)


class _Objects:
    """Pieces up to the brace that closes an element of the outer array."""

    def __init__(self, quoted: bool, depth: int) -> None:
        self.quoted, self.depth, self.inside = quoted, depth, quoted or depth > 1

    def __call__(self, piece: str) -> str | None:
        if not self.quoted and self.depth <= 1 and "{" not in piece and "]" in piece:
            self.depth = 0
            return ""  # what comes after the last element
        parts, self.quoted = _outside(piece, self.quoted)
        self.depth += _steps(parts)
        if self.quoted:
            return None
        self.depth -= 1
        return piece + "}" if self.depth == 1 else None


def array_records(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    """The elements of files that hold one array each, as texts on one line (column ``value``), and the files that hold something else.

    Every block is counted for both cases, that it begins inside a string and that it doesn't; which one holds, and how deep it begins, follows from
    the blocks before. The driver gets a row for each block.
    """
    cut = pieces(spark, paths, "}").select(*BLOCK, "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for file, block, piece in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, block) not in sums:
                    sums[file, block] = [[False, 0], [True, 0], piece.lstrip()[:1]]
                for case in sums[file, block][:2]:
                    parts, case[0] = _outside(piece, case[0])
                    case[1] += _steps(parts) - (not case[0])
        found = [(*at, int(plain[0]), plain[1], quoted[1], opens) for at, (plain, quoted, opens) in sums.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["file", "block", "quotes", "plain", "quoted", "opens"])

    sums = cut.mapInArrow(count, "file string, block long, quotes long, plain long, quoted long, opens string")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("begins", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    depth = F.coalesce(F.sum(F.when(F.col("begins"), F.col("quoted")).otherwise(F.col("plain"))).over(earlier), F.lit(0))
    rows = known.select(*BLOCK, "begins", depth.alias("depth"), "opens").collect()
    other = {r.file for r in rows if r.block == 0 and r.opens != "["}
    arrays = sorted({r.file for r in rows} - other)
    if not arrays:
        return None, [unquote(f) for f in other]
    starts = spark.sparkContext.broadcast({(r.file, r.block): (r.begins, r.depth) for r in rows})
    if other:
        cut = pieces(spark, [unquote(f) for f in arrays], "}").select(*BLOCK, "value")
    found = assembled(cut, lambda file, block: _Objects(*starts.value[file, block]), "}")
    flat = F.regexp_replace(F.translate("record", "\n\r", "  "), "^[\\[,\\s]+", "")
    return found.select(flat.alias("value")).where("value <> ''"), [unquote(f) for f in other]
