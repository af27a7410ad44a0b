"""One-row verdict frames and how one-row frames are put next to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.text import q, text
from tallymark.operators.sides import FLOATS, INTEGERS, stack

PASS, FAIL, ERROR = "PASS", "FAIL", "ERROR"
NUMBERS = (*INTEGERS, *FLOATS, T.DecimalType)
VERDICT_COLUMNS = ("status", "details", "violations", "total_rows")


def together(**frames: DataFrame) -> DataFrame:
    """One row out of several one-row frames, each as a struct; NULL where one is empty."""
    packed = [df.select(F.struct("*").alias(name)) for name, df in frames.items()]
    return stack(packed, fill=True).agg(*(F.first(name, ignorenulls=True).alias(name) for name in frames))


def verdict(passed: Column, violations: Column, total_rows: Column, details: Column) -> list[Column]:
    """The four columns every check ends in."""
    return [
        F.when(passed, F.lit(PASS)).otherwise(F.lit(FAIL)).alias("status"),
        details.alias("details"),
        violations.cast("double").alias("violations"),
        total_rows.cast("bigint").alias("total_rows"),
    ]


def same_value(a: str, a_type: T.DataType, b: str, b_type: T.DataType) -> str:
    """Equality of two figures whose types may differ, in SQL; unlike families never match."""
    if a_type == b_type or (isinstance(a_type, NUMBERS) and isinstance(b_type, NUMBERS)):
        return f"({a} <=> {b})"
    pair = {type(a_type), type(b_type)}
    if T.BooleanType in pair and any(issubclass(t, NUMBERS) for t in pair):
        return f"(cast({a} as double) <=> cast({b} as double))"
    if pair == {T.TimestampType, T.TimestampNTZType}:
        return f"(cast({a} as timestamp) <=> cast({b} as timestamp))"
    return f"({a} is null and {b} is null)"


def shown(x: str, dtype: T.DataType) -> str:
    """A figure as it stands in details, in SQL."""
    if isinstance(dtype, T.NullType):
        return "'None'"
    if isinstance(dtype, T.BooleanType):
        return f"case when {x} is null then 'None' when {x} then 'True' else 'False' end"
    return f"coalesce({text(x, dtype)}, 'None')"


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the columns, each with its name, so that unlike rows never read alike."""
    packed = F.to_json(F.struct(*(F.col(q(n)) for n in columns)), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(packed, 256))


def grouped_digits(value: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(value, 0)
