"""Line dedup: lines that stand on many sites are boilerplate and go, all but the first of each.

Every line's sites are counted by a HyperLogLog sketch that merges by aggregation, so a line on a third of all pages costs one
sketch per task. Only lines whose estimate is within a factor of two of the threshold get exact distinct counts; beyond that
factor the sketch's error (about 3 %) cannot change the decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import free_name, stage

MIN_SITES = 10
#: Base-two logarithm of the sketch's buckets.
SKETCH_LOG2 = 10
#: Estimates within this factor of the threshold are counted exactly.
NEAR = 2.0


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed_lines(docs: DataFrame, doc: str, text: str, site: str) -> DataFrame:
    """One row per line that is not blank: doc, whole (a hash of the text), site, pos, and the line's hashes h1 and h2.

    Lines count as equal without white space at their ends; 96 bits stand for a line.
    """
    rows = docs.select(
        F.col(doc).alias("doc"), F.xxhash64(text).alias("whole"), F.col(site).cast("string").alias("site"),
        F.posexplode(split_lines(F.col(text).cast("string"))).alias("pos", "line"),
    )
    line = F.expr("trim(BOTH ' \t\r' FROM line)")
    return rows.withColumn("line", line).where("line <> ''").select(
        "doc", "whole", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least ``min_sites`` distinct sites: h1, h2, sites (an estimate far above the threshold), first (doc and pos)."""
    spread = stage(
        lines.groupBy("h1", "h2").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_LOG2))).alias("sites"),
            F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "pos"))).alias("first"),
        ).where(F.col("sites") >= min_sites / NEAR),
        "spread",
    )
    near = spread.where(F.col("sites") <= min_sites * NEAR)
    exact = (
        lines.where("site is not null").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    certain = spread.where(F.col("sites") > min_sites * NEAR)
    return stage(certain.unionByName(exact.join(near.drop("sites"), ["h1", "h2"]).select("h1", "h2", "sites", "first")), "boilerplate")


def remove_boilerplate(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
) -> DataFrame:
    """The documents without their boilerplate lines, with ``lines`` and ``removed_lines`` (counts) after their columns.

    Of each boilerplate line the first occurrence stays: the first position in the document with the smallest id. Blank lines
    are never counted or removed. Lines of a null site count for no site. Null texts stay null and have no lines; documents
    with a null id keep no first occurrence; rows that share id and text are treated alike. Columns already called ``lines`` or
    ``removed_lines`` are kept, the new ones then get an underscore.
    """
    lines = keyed_lines(docs, doc, text, site)
    known = boilerplate(lines, min_sites)
    first = F.col("first.doc").eqNullSafe(F.col("doc")) & F.col("first.pos").eqNullSafe(F.col("pos"))
    hits = (
        lines.drop("site").join(known.select("h1", "h2", "first"), ["h1", "h2"]).where(~first)
        .groupBy("doc", "whole").agg(F.collect_set("pos").alias("gone"))
    )
    names = [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_at, text_at = (names[docs.columns.index(c)] for c in (doc, text))
    left = plain.withColumn("whole", F.xxhash64(text_at))
    joined = left.join(hits, left[doc_at].eqNullSafe(hits["doc"]) & (left["whole"] == hits["whole"]), "left")
    parts = split_lines(F.col(text_at).cast("string"))
    # Bound to a variable, the text is split once; the places left over are found by hashing, however many lines there are and go.
    kept = F.transform(F.array(parts), lambda own: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "gone"), lambda at: F.get(own, at)), "\n"))[0]
    cleaned = F.when(F.col("gone").isNull(), F.col(text_at)).otherwise(kept)
    return joined.select(
        *[(cleaned if n == text_at else F.col(n)).alias(c) for n, c in zip(names, docs.columns)],
        F.coalesce(F.when(F.col(text_at).isNotNull(), F.size(parts)), F.lit(0)).cast("long").alias(free_name(docs, "lines")),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(free_name(docs, "removed_lines")),
    )
