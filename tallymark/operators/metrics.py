"""Column metrics of one side: per table and over the whole side.

Every table is reduced by its own global aggregate over one column, so a text
minimum never needs a sort by table and an empty table still gives a row. The side's
total is merged from those rows, except for distinct values, which do not add up
and take one shuffle on the value.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import model
from tallymark.functions.columns import missing_columns
from tallymark.functions.text import java_pattern, literal, text
from tallymark.model import CheckError
from tallymark.operators.sides import as_type, column_type, stack

ALL_TABLES = "__all__"
TABLE_BITS = 62

Measure = Callable[[str, T.DataType, str | None], str]


@dataclass(frozen=True)
class Metric:
    """What is reported, how a column is reduced to it (in SQL) and how the figures of tables merge."""

    kind: str
    said: str
    parts: dict[str, Measure]
    merge: dict[str, str]


def _matches(val: str, dtype: T.DataType, pattern: str | None) -> str:
    return f"{text(val, dtype)} rlike {literal(java_pattern(str(pattern)))}"


METRICS: dict[str, Metric] = {
    model.NULLS: Metric(
        "count", "empty",
        {"metric": lambda val, dtype, pattern: f"sum(if({val} is null, 1, 0))"}, {"metric": "sum"},
    ),
    model.UNIQUENESS: Metric("count", "different", {}, {}),
    model.RANGE: Metric(
        "range", "from to",
        {"low": lambda val, dtype, pattern: f"min({val})", "high": lambda val, dtype, pattern: f"max({val})"},
        {"low": "min", "high": "max"},
    ),
    model.VOLUME: Metric(
        "count2", "rows",
        {"metric": lambda val, dtype, pattern: "count(1)", "non_null": lambda val, dtype, pattern: f"count({val})"},
        {"metric": "sum", "non_null": "sum"},
    ),
    model.LENGTH: Metric(
        "range", "characters",
        {
            "low": lambda val, dtype, pattern: f"bigint(min(length({text(val, dtype)})))",
            "high": lambda val, dtype, pattern: f"bigint(max(length({text(val, dtype)})))",
        },
        {"low": "min", "high": "max"},
    ),
    model.REGEX: Metric(
        "count", "matching",
        {"metric": lambda val, dtype, pattern: f"sum(if({_matches(val, dtype, pattern)}, 1, 0))"}, {"metric": "sum"},
    ),
    model.FRESHNESS: Metric(
        "scalar", "newest",
        {"metric": lambda val, dtype, pattern: f"max({val})"}, {"metric": "max"},
    ),
}


@dataclass(frozen=True)
class Wanted:
    """One metric of one column; ``columns`` names that column in every table."""

    metric: str
    columns: dict[str, str]
    pattern: str | None = None


def measure(frames: Mapping[str, DataFrame], wanted: Sequence[Wanted]) -> DataFrame:
    """One row for the side: every wanted metric from a single scan per table.

    Columns ``m0, m1, ...`` are structs ``{total, tables}``; ``total`` holds the metric
    over the whole side and ``tables`` the figures of each table that has rows.
    """
    types = [column_type(frames, w.columns) for w in wanted]
    arms = []
    for table, df in frames.items():
        aggregates = ["count(1) as rows"]
        for i, (w, dtype) in enumerate(zip(wanted, types)):
            val = as_type(df, w.columns[table], dtype)
            aggregates += [
                f"{part(val, dtype, w.pattern)} as m{i}_{name}" for name, part in METRICS[w.metric].parts.items()
            ]
        arms.append(df.selectExpr(*aggregates).withColumn("src_table", F.lit(table)))
    return _merge(stack(arms), wanted, types)


def _merge(per_table: DataFrame, wanted: Sequence[Wanted], types: Sequence[T.DataType]) -> DataFrame:
    aggregates = []
    for i, (w, dtype) in enumerate(zip(wanted, types)):

        def shown(value: str, metric: str = w.metric, dtype: T.DataType = dtype) -> str:
            return text(value, dtype) if metric == model.FRESHNESS else value

        merge = METRICS[w.metric].merge
        totals = ", ".join(f"'{name}', {shown(f'{how}(m{i}_{name})')}" for name, how in merge.items())
        figures = ", ".join(f"'{name}', {shown(f'm{i}_{name}')}" for name in merge)
        aggregates.append(f"""named_struct(
            'total', named_struct('rows', sum(rows), {totals}),
            'tables', collect_list(if(rows > 0, named_struct('src_table', src_table, 'rows', rows, {figures}), null))
        ) as m{i}""")
    return per_table.selectExpr(*aggregates)


def measure_distinct(frames: Mapping[str, DataFrame], columns: Mapping[str, str]) -> DataFrame:
    """Distinct values per table and over the side, from one shuffle on the value.

    Each value keeps a bit per table that holds it, so a hot value shrinks to one row per
    map task before the shuffle.
    """
    dtype = column_type(frames, columns)
    names = list(frames)
    words = range(0, len(names), TABLE_BITS)

    def bits(position: int) -> list[Column]:
        return [
            F.lit(1 << (position - start) if start <= position < start + TABLE_BITS else 0)
            .cast("bigint").alias(f"w{start}")
            for start in words
        ]

    tagged = stack([
        df.select(F.expr(as_type(df, columns[table], dtype)).alias("val"), *bits(i))
        for i, (table, df) in enumerate(frames.items())
    ])
    per_value = tagged.groupBy("val").agg(
        F.count(F.lit(1)).alias("n"), *(F.bit_or(f"w{start}").alias(f"w{start}") for start in words)
    )

    def held(position: int) -> Column:
        start = position - position % TABLE_BITS
        return F.col(f"w{start}").bitwiseAND(F.lit(1 << (position - start)).cast("bigint")) != 0

    counted = per_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("val").alias("metric"),
        *(F.count_if(held(i) & F.col("val").isNotNull()).alias(f"t{i}") for i in range(len(names))),
        *(F.max(held(i)).alias(f"has{i}") for i in range(len(names))),
    )
    tables = F.filter(
        F.array(*(
            F.when(F.col(f"has{i}"), F.struct(F.lit(name).alias("src_table"), F.col(f"t{i}").alias("metric")))
            for i, name in enumerate(names)
        )),
        lambda entry: entry.isNotNull(),
    )
    return counted.select(
        F.struct(F.struct("rows", "metric").alias("total"), tables.alias("tables")).alias("m0")
    )


#: Registers of a sketch, as a base-two logarithm: one standard error is 0.8 percent.
SKETCH_LOG2 = 14
#: Bounds lie this many standard errors from the estimate: missed about three times in a thousand.
ERRORS = 3


def distinct_sketches(frames: Mapping[str, DataFrame], columns: Mapping[str, str], log2: int = SKETCH_LOG2) -> DataFrame:
    """``src_table, rows, sketch``: one row a table, from one scan each and without a shuffle of values.

    Sketches of tables and of runs can be stored and merged later, with :func:`merged_distinct`. Equal values give equal
    sketches whatever the tables' types, because values are sketched in the type that all of them share.
    """
    dtype = column_type(frames, columns)
    return stack([
        df.selectExpr("count(1) as rows", f"hll_sketch_agg(concat('=', {text(as_type(df, columns[table], dtype), dtype)}), {log2}) as sketch")
        .select(F.lit(table).alias("src_table"), "rows", "sketch")
        for table, df in frames.items()
    ])


def merged_distinct(sketches: DataFrame, *by: str, log2: int = SKETCH_LOG2) -> DataFrame:
    """``rows, estimate, low, high`` of the values behind any number of stored sketches, over all of them or per ``by``."""
    share = ERRORS * 1.04 / (1 << log2) ** 0.5
    merged = sketches.groupBy(*by).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.expr("hll_sketch_estimate(hll_union_agg(sketch, true))"), F.lit(0)).alias("estimate"))
    error = F.ceil(F.col("estimate") * share)
    return merged.select(*by, "rows", "estimate", F.greatest(F.col("estimate") - error, F.lit(0)).alias("low"), (F.col("estimate") + error).alias("high"))


def metric_table(frames: Mapping[str, DataFrame], wanted: Wanted) -> DataFrame:
    """The metric as rows: one per table with rows, and one for the whole side."""
    if wanted.metric == model.UNIQUENESS:
        side, names = measure_distinct(frames, wanted.columns), ["metric"]
    else:
        side, names = measure(frames, [wanted]), list(METRICS[wanted.metric].merge)
    entry = F.explode(F.concat(
        F.array(F.struct(F.lit(ALL_TABLES).alias("src_table"), *(F.col(f"m0.total.{n}").alias(n) for n in names))),
        F.transform("m0.tables", lambda t: F.struct(t["src_table"].alias("src_table"), *(t[n].alias(n) for n in names))),
    ))
    return side.select(entry.alias("e")).select("e.*")


def require(frames: Mapping[str, DataFrame], wanted: Wanted) -> None:
    gaps = missing_columns(frames, wanted.columns)
    if gaps:
        raise CheckError(f"no such column: {', '.join(gaps)}")
