"""XML documents as tables: which element is a record, and how its fields become columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.columns import c
from tallymark.operators.sides import stack
from tallymark.sources.blocks import BLOCK, before_blocks, pieces, within_blocks

TEXT = "_VALUE"
COUNTS = "path string, root string, tag string, children long, strays long"


def local_name(tag: str) -> str:
    return tag.rsplit(":", 1)[-1]


# ---- tags, from blocks of a file -----------------------------------------------------------------------

NAME = "[^\\s/>!?<=][^\\s/<>]*"


def tags(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, name, step (1 opens, -1 closes, 0 both), odd: a row for each piece of text up to a ``>``.

    ``odd`` marks what a piece alone can't tell: a ``>`` inside a comment, a CDATA section, an instruction, a document type or an
    attribute's value. Files without such a place are read in blocks, by SQL functions alone.
    """
    cut = pieces(spark, path, ">").withColumn("tag", F.regexp_extract("value", "<([^<]*)$", 1))
    name = F.regexp_extract("tag", f"^/?({NAME})", 1)
    open_quote = F.regexp_replace("tag", "\"[^\"]*\"|'[^']*'", "").rlike("[\"']")
    special = F.when(F.col("value").contains("<!--"), ~F.endswith("value", F.lit("--"))).when(
        F.col("value").contains("<![CDATA["), ~F.endswith("value", F.lit("]]"))).when(
        F.startswith("tag", F.lit("?")), ~F.endswith("value", F.lit("?"))).when(F.col("value").contains("<!DOCTYPE"), F.col("value").contains("["))
    plain = (name != "") & F.col("value").contains("<")
    step = F.when(~plain, 0).when(F.startswith("tag", F.lit("/")), -1).when(F.endswith("tag", F.lit("/")), 0).otherwise(1)
    return cut.select(
        *BLOCK, "at", F.when(plain, F.regexp_extract(name, "([^:]*)$", 1)).alias("name"), step.cast("long").alias("step"),
        (plain & F.startswith("tag", F.lit("/"))).alias("closes"),
        F.coalesce(special, plain & open_quote, F.lit(False)).alias("odd"), (F.trim("value") != "").alias("text"))


def counted_in_blocks(found: DataFrame) -> DataFrame:
    """path, root, tag, children, strays of the files, as ``COUNTS`` has them, from the tags of their blocks.

    Depth is a sum over the tags before. What a deeper tag stands in is the last child of the root opened before it, in its own block
    or else in the last block before that has one.
    """
    steps = found.groupBy(*BLOCK).agg(F.sum("step").alias("depth"))
    opened = found.where("name is not null")
    placed = opened.join(before_blocks(steps, "depth"), list(BLOCK)).withColumn("depth", F.col("depth") + within_blocks(F.col("step"))).where("not closes")
    own = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    child = F.when(F.col("depth") == 1, F.col("name"))
    seen = placed.withColumn("inside", F.last(child, ignorenulls=True).over(own))
    lasts = seen.groupBy(*BLOCK).agg(F.max_by("inside", F.when(F.col("inside").isNotNull(), F.col("at"))).alias("carried"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*BLOCK, F.last("carried", ignorenulls=True).over(earlier).alias("carried"))
    known = seen.join(carried, list(BLOCK)).withColumn("inside", F.coalesce("inside", "carried"))
    roots = known.where("depth = 0").groupBy("file").agg(F.min_by("name", F.struct("block", "at")).alias("root"))
    counted = known.where("depth > 0").groupBy("file", F.col("name").alias("tag")).agg(
        F.count_if(F.col("depth") == 1).alias("children"), F.count_if((F.col("depth") > 1) & (F.col("inside") != F.col("name"))).alias("strays"))
    header = roots.select("file", F.lit("").alias("tag"), F.lit(0).cast("long").alias("children"), F.lit(0).cast("long").alias("strays"))
    return counted.unionByName(header).join(roots, "file").select(F.col("file").alias("path"), "root", "tag", "children", "strays")


# ---- tags, from whole files ----------------------------------------------------------------------------


def count_children(content: bytes) -> tuple[str, Counter, Counter]:
    """(root, names directly under it, names deeper down outside a record of that name)."""
    path: list[str] = []
    direct: Counter = Counter()
    deeper: Counter = Counter()
    root = ""

    def opened(name: str, _: object) -> None:
        nonlocal root
        tag = local_name(name)
        if not path:
            root = tag
        elif len(path) == 1:
            direct[tag] += 1
        elif path[1] != tag:
            deeper[tag] += 1
        path.append(tag)

    parser = expat.ParserCreate()
    parser.StartElementHandler = opened
    parser.EndElementHandler = lambda tag: path.pop()
    parser.Parse(content, True)
    return root, direct, deeper


def _count_files(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            root, direct, deeper = count_children(bytes(content))
            rows.append((path, root, "", 0, 0))
            rows += [(path, root, tag, n, 0) for tag, n in direct.items()]
            rows += [(path, root, tag, 0, n) for tag, n in deeper.items()]
        yield pd.DataFrame(rows, columns=["path", "root", "tag", "children", "strays"])


@dataclass(frozen=True)
class Layout:
    """What the documents hold: candidates in falling frequency, the choice, and its shape."""

    root: str
    candidates: tuple[str, ...]
    chosen: str | None
    strays: bool = False


def find_layouts(spark: SparkSession, path: str, record_element: str | None = None) -> list[tuple[Layout, list[str] | None]]:
    """A layout for each root element that the documents have, with the files of that root (None: all files).

    Only counts per root and tag reach the driver, and file names where there are several roots.
    """
    counts = count_tags(spark, path)
    counted = counts.groupBy("root", "tag").agg(
        F.sum("children").alias("children"), F.max("children").alias("most"), F.sum("strays").alias("strays"),
    ).collect()
    roots = sorted({r.root for r in counted})
    if record_element is not None and not any(r.tag == record_element and r.children for r in counted):
        known = sorted({r.tag for r in counted if r.tag and r.children})
        raise ValueError(f"<{record_element}> is no child of a root; the children are {', '.join(known)}")
    files: dict[str, list[str]] = {}
    if len(roots) > 1:
        for row in counts.where("tag = ''").select("root", "path").toLocalIterator():
            files.setdefault(row.root, []).append(unquote(row.path))
    return [(_layout(root, [r for r in counted if r.root == root], record_element), files.get(root)) for root in roots]


def count_tags(spark: SparkSession, path: str) -> DataFrame:
    """``COUNTS`` of every file: by blocks, but for files with a ``>`` where a block can't tell what it means. Those are parsed whole."""
    found = tags(spark, path)
    odd = [unquote(r.file) for r in found.groupBy("file").agg(F.max("odd").alias("odd"), F.sum("step").alias("open")).where("odd or open <> 0").select("file").toLocalIterator()]
    if not odd:
        return counted_in_blocks(found)
    whole = spark.read.format("binaryFile").load(odd).select("path", "content").mapInPandas(_count_files, COUNTS)
    every = [unquote(r.file) for r in found.select("file").distinct().toLocalIterator()]
    rest = [f for f in every if f not in set(odd)]
    return counted_in_blocks(tags(spark, rest)).unionByName(whole) if rest else whole


def _layout(root: str, counted: list, record_element: str | None) -> Layout:
    tags = {r.tag: r for r in counted if r.tag and r.children}
    names = tuple(sorted(tags, key=lambda t: -tags[t].children))
    if not names or (record_element is not None and record_element not in names):
        return Layout(root, (), None)
    if record_element is None and len(names) > 1 and all(tags[t].most == 1 for t in names):
        return Layout(root, names, None)
    chosen = record_element or names[0]
    return Layout(root, names, chosen, strays=any(r.strays for r in counted if r.tag == chosen))


def _reader(spark: SparkSession, path: str | list[str], tag: str) -> DataFrame:
    return spark.read.format("xml").options(
        rowTag=tag, attributePrefix="@", valueTag=TEXT, inferSchema="false", ignoreNamespace="true", mode="FAILFAST",
        nullValue="", ignoreSurroundingSpaces="true",
    ).load(path)


def _is_attribute(name: str) -> bool:
    return name.startswith("@")


def _declares_namespace(name: str) -> bool:
    return name == "@xmlns" or name.startswith("@xmlns:")


def _cells(col: Column, name: str, dtype: T.DataType) -> Iterator[tuple[str, Column]]:
    """(column name, expression) pairs for one field of a record."""
    if isinstance(dtype, T.StructType):
        children = [f for f in dtype.fields if f.name != TEXT and not _is_attribute(f.name)]
        for field in dtype.fields:
            if field.name == TEXT:
                if not children:
                    yield name, F.trim(col.getField(TEXT).cast("string"))
            elif not _declares_namespace(field.name):
                yield from _cells(col.getField(field.name), f"{name}.{field.name}", field.dataType)
    elif isinstance(dtype, T.ArrayType):
        single = F.when(F.size(col) == 1, F.get(col, F.lit(0)))
        listed = F.when(F.size(col) > 1, F.to_json(col))
        if isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
            yield name, listed
            yield from _cells(single, name, dtype.elementType)
        else:
            yield name, F.coalesce(F.trim(single.cast("string")), listed)
    else:
        yield name, F.trim(col.cast("string"))


def _record_columns(df: DataFrame, element: str) -> list[Column]:
    attributes = [f for f in df.schema.fields if _is_attribute(f.name) and not _declares_namespace(f.name)]
    children = [f for f in df.schema.fields if f.name != TEXT and not _is_attribute(f.name)]
    cells: dict[str, list[Column]] = {}
    for f in df.schema.fields:
        if f.name == TEXT:
            if not children and not attributes:
                cells.setdefault(element, []).append(F.trim(c(TEXT).cast("string")))
        elif not _declares_namespace(f.name):
            for name, col in _cells(c(f.name), f.name, f.dataType):
                cells.setdefault(name, []).append(col)
    return [F.coalesce(*cols).alias(name) for name, cols in cells.items()]


def read_xml(spark: SparkSession, path: str, record_element: str | None = None) -> DataFrame:
    """The records as flat text columns; attributes are ``@name``, repeated children JSON text.

    The most frequent child of the root is a record. A root without children has no records
    and a root with several different children, each there once, is itself one record. When
    the record's name also turns up elsewhere in the document, records are taken from the
    root, which reads each file in one task. Documents with different roots are read root by root,
    and a column that one kind of record lacks is NULL there.
    """
    parts = [
        _records(spark, files or path, layout) for layout, files in find_layouts(spark, path, record_element) if layout.candidates
    ]
    if not parts:
        return spark.createDataFrame([], "value string")
    return stack(parts, fill=True)


def _records(spark: SparkSession, path: str | list[str], layout: Layout) -> DataFrame:
    if layout.chosen is None:
        records, element = _reader(spark, path, layout.root), layout.root
    elif layout.strays:
        element = layout.chosen
        whole = _reader(spark, path, layout.root)
        dtype = whole.schema[element].dataType
        listed = c(element) if isinstance(dtype, T.ArrayType) else F.array(c(element))
        rows = whole.select(F.explode(listed).alias("r"))
        inner = rows.schema["r"].dataType
        records = rows.select("r.*") if isinstance(inner, T.StructType) else rows.select(F.col("r").alias(TEXT))
    else:
        records, element = _reader(spark, path, layout.chosen), layout.chosen
    return records.select(*_record_columns(records, element))
