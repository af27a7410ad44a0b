"""Rows of text into an existing table, cast to the table's own types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.columns import c
from tallymark.sources.files import read_delimited_text
from tallymark.operators.synth import non_empty


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded CSV as text, blank lines dropped, a missing cell as empty text."""
    return non_empty(read_delimited_text(spark, path, ",").fillna(""))


def cast_to(staged: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns that are staged, cast; ``_bad`` counts cells that would not cast.

    Columns the target lacks are left out, and an empty cell is NULL unless the target is text.
    """
    fields = [f for f in target.fields if f.name in staged.columns]
    cast, bad = [], F.lit(0)
    for f in fields:
        given = c(f.name) if isinstance(f.dataType, T.StringType) else F.nullif(F.trim(c(f.name)), F.lit(""))
        made = given.try_cast(f.dataType)
        cast.append(made.alias(f.name))
        bad = bad + F.when(given.isNotNull() & made.isNull(), F.lit(1)).otherwise(F.lit(0))
    return staged.select(*cast, bad.alias("_bad"))


def split_rejected(staged: DataFrame, target: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows to append, staged rows with a cell that fits no target type)."""
    fields = [f for f in target.fields if f.name in staged.columns]
    marked = cast_to(staged, target)
    good = marked.filter("_bad = 0").drop("_bad")
    wrong = F.lit(False)
    for f in fields:
        given = c(f.name) if isinstance(f.dataType, T.StringType) else F.nullif(F.trim(c(f.name)), F.lit(""))
        wrong = wrong | (given.isNotNull() & given.try_cast(f.dataType).isNull())
    return good, staged.filter(wrong)


def append_rows(spark: SparkSession, staged: DataFrame, path: str) -> dict:
    """Append the staged rows to the Parquet table at ``path``; nothing is written if a cell will not cast."""
    target = spark.read.parquet(path).schema
    marked = cast_to(staged, target)
    seen = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_bad") > 0).alias("rejected")).first()
    if seen.rejected:
        return {"appended": 0, "rejected": seen.rejected}
    marked.drop("_bad").write.mode("append").parquet(path)
    return {"appended": seen.n, "rejected": 0}


def write_rows(df: DataFrame, path: str) -> None:
    """Rows as CSV files with a header and quoted cells where needed."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
