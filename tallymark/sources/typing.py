"""Types for columns that arrive as text: one aggregate over all of them, then a cast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.columns import c

# Date layouts in the order they are tried.
DATE_LAYOUTS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    ("yyyy/MM/dd", r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    ("dd-MM-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    ("dd/MM/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
    ("MM-dd-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"),
    ("MM/dd/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    ("yy-MM-dd", r"^\d{2}-\d{1,2}-\d{1,2}$", "y-M-d"),
    ("dd-MM-yy", r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-y"),
    ("dd/MM/yy", r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/y"),
)
WHOLE = r"^[+-]?\d{1,19}$"
FRACTION = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"
YEAR_PIVOT = 69


def _layout_date(value: Column, layout: tuple[str, str, str]) -> Column:
    _, pattern, order = layout
    parts = F.split(value, "[-/]")
    where = {part: F.get(parts, F.lit(i)) for i, part in enumerate(order.replace("/", "-").split("-"))}
    year = where["y"]
    if not layout[0].count("yyyy"):
        short = year.try_cast("int")
        year = (short + F.when(short >= YEAR_PIVOT, 1900).otherwise(2000)).cast("string")
    made = F.concat_ws("-", year, where["M"], where["d"]).try_cast("date")
    return F.when(F.regexp_like(value, F.lit(pattern)), made)


def _readings(value: Column) -> list[tuple[str, Column]]:
    """Each type a text column may turn out to have, narrowest first, with its cast."""
    return [
        ("boolean", F.when(F.lower(value).isin("true", "false"), F.lower(value) == "true")),
        ("bigint", F.when(F.regexp_like(value, F.lit(WHOLE)), value.try_cast("bigint"))),
        ("double", F.when(F.regexp_like(value, F.lit(FRACTION)), value.try_cast("double"))),
        *((layout[0], _layout_date(value, layout)) for layout in DATE_LAYOUTS),
        ("timestamp_ntz", F.when(F.regexp_like(value, F.lit(MOMENT)), value.try_cast("timestamp_ntz"))),
    ]


def _settle(df: DataFrame, names: Sequence[str], kinds: Sequence[str] | None) -> DataFrame:
    readings = {}
    aggregates = []
    for i, name in enumerate(names):
        value = F.nullif(F.trim(c(name)), F.lit(""))
        readings[name] = [r for r in _readings(value) if kinds is None or r[0] in kinds]
        aggregates.append(F.count(value).alias(f"n{i}"))
        aggregates += [F.count(cast).alias(f"n{i}_{j}") for j, (_, cast) in enumerate(readings[name])]
    if not aggregates:
        return df
    seen = df.agg(*aggregates).first()
    chosen = {}
    for i, name in enumerate(names):
        fits = [cast for j, (_, cast) in enumerate(readings[name]) if seen[f"n{i}"] and seen[f"n{i}_{j}"] == seen[f"n{i}"]]
        chosen[name] = fits[0] if fits else F.nullif(c(name), F.lit(""))
    return df.select(*(chosen.get(n, c(n)).alias(n) for n in df.columns))


def settle_types(df: DataFrame) -> DataFrame:
    """Text columns whose every value fits a type take it; blanks are NULL.

    One aggregate looks at all rows of all columns; only its counts reach the driver.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return _settle(df, names, None)


def settle_dates(df: DataFrame) -> DataFrame:
    """Text columns that hold only dates or only timestamps take that type."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return _settle(df, names, [layout[0] for layout in DATE_LAYOUTS] + ["timestamp_ntz"])


def widen(df: DataFrame) -> DataFrame:
    """Small whole numbers as bigint and floats as double, as every reader gives them."""
    targets = {T.ByteType: "bigint", T.ShortType: "bigint", T.IntegerType: "bigint", T.FloatType: "double"}
    return df.select(*(
        c(f.name).cast(targets[type(f.dataType)]).alias(f.name) if type(f.dataType) in targets else c(f.name)
        for f in df.schema.fields
    ))
