"""Proposing rules from a profile, and dropping those that already exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import model
from tallymark.functions.columns import c
from tallymark.functions.text import literal, q, text
from tallymark.model import RuleCheck
from tallymark.operators.rules import expression, unique
from tallymark.operators.verdicts import NUMBERS

DUPLICATE = "Duplicate of an existing rule"
FEW_VALUES = 20
# 2^14 registers: distinct counts within one percent or so.
SKETCH_BITS = 14

MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _family(dtype: T.DataType) -> str:
    return "number" if isinstance(dtype, NUMBERS) else "moment" if isinstance(dtype, MOMENTS) else "text"


def _hashable(x: str, dtype: T.DataType) -> str:
    return x if isinstance(dtype, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else f"cast({x} as string)"


def profile(df: DataFrame) -> DataFrame:
    """One row per column from one scan: nulls, distinct estimate, bounds and lengths."""
    usable = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    aggregates, entries = ["count(1) as rows"], []
    for i, f in enumerate(usable):
        x = q(f.name)
        length = f"length({text(x, f.dataType)})"
        aggregates += [
            f"count_if({x} is null) as nulls{i}",
            f"hll_sketch_estimate(hll_sketch_agg({_hashable(x, f.dataType)}, {SKETCH_BITS})) as distinct{i}",
            f"min({x}) as low{i}", f"max({x}) as high{i}", f"min({length}) as short{i}", f"max({length}) as long{i}",
        ]
        entries.append(f"""named_struct('position', {i}, 'column_name', {literal(f.name)}, 'family', '{_family(f.dataType)}',
            'rows', rows, 'nulls', nulls{i}, 'distinct_estimate', distinct{i}, 'low', {text(f'low{i}', f.dataType)},
            'high', {text(f'high{i}', f.dataType)}, 'min_length', short{i}, 'max_length', long{i})""")
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")


def common_values(df: DataFrame, columns: Sequence[str], n: int = FEW_VALUES) -> DataFrame:
    """The n most frequent values of each column: ``column_name, value, rows``.

    Values are counted before they are ranked and each task keeps n per column, so no
    column's values meet in one place.
    """
    pairs = F.array(*(
        F.struct(F.lit(name).alias("column_name"), F.expr(text(q(name), df.schema[name].dataType)).alias("value"))
        for name in columns
    ))
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(
        Window.partitionBy("column_name").orderBy(F.col("rows").desc(), F.col("value").asc_nulls_last())
    )
    return counts.withColumn("place", place).filter(F.col("place") <= n).drop("place")


CANDIDATE_SCHEMA = "position int, name string, table_name string, column_name string, validation_type string, condition string"


def repeated(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """For each column whether any of its values occurs twice, from one exact grouping of digests."""
    if not columns:
        return {}
    pairs = F.array(*(
        F.struct(F.lit(i).alias("i"), F.xxhash64(c(name)).alias("h"), F.unhex(F.md5(F.expr(text(q(name), df.schema[name].dataType)))).alias("v"))
        for i, name in enumerate(columns)
    ))
    copies = df.select(F.explode(pairs).alias("p")).groupBy("p.i", "p.h", "p.v").agg(F.count(F.lit(1)).alias("n"))
    most = {r.i: r.n for r in copies.groupBy("i").agg(F.max("n").alias("n")).collect()}
    return {name: most.get(i, 0) > 1 for i, name in enumerate(columns)}


def few_values(df: DataFrame, column: str, n: int = FEW_VALUES) -> list[str] | None:
    """The column's values in order as SQL literals, None when there are more than n."""
    dtype = df.schema[column].dataType
    rows = df.where(c(column).isNotNull()).groupBy(F.expr(text(q(column), dtype)).alias("v")).agg(F.lit(1)).orderBy("v").limit(n + 1).collect()
    return None if len(rows) > n else [literal(r.v) for r in rows]


def candidate_rules(df: DataFrame, table: str) -> DataFrame:
    """Rules that hold on every row: ``position, name, table_name, column_name, validation_type, condition``.

    The profile says what is worth a closer look; that a column is unique, or holds few values, is then
    confirmed exactly. A condition is one for rows, except of uniqueness, which is one for the table.
    """
    profiled = profile(df).collect()
    near = [r.column_name for r in profiled if r.rows and not r.nulls and r.distinct_estimate >= r.rows * 0.9]
    twice = repeated(df, near)
    found = []
    for r in profiled:
        name, at = q(r.column_name), df.schema[r.column_name].dataType
        if not r.rows:
            continue
        made: list[tuple[int, str, str, str]] = []
        if not r.nulls:
            made.append((0, "is filled", model.NULLS, f"{name} is not null"))
        if twice.get(r.column_name) is False:
            made.append((1, "is unique", model.UNIQUENESS, f"count(distinct {name}) = count(*)"))
        if r.family in ("number", "moment") and r.low is not None:
            low, high = (v if r.family == "number" else f"cast({literal(v)} as {at.simpleString()})" for v in (r.low, r.high))
            made.append((2, "in range", model.RANGE, f"{name} between {low} and {high}"))
        if r.family == "text" and r.distinct_estimate:
            allowed = few_values(df, r.column_name) if r.distinct_estimate <= FEW_VALUES * 1.5 else None
            if allowed:
                made.append((4, "allowed", model.CATEGORICAL, f"{name} in ({', '.join(allowed)})"))
            else:
                made.append((3, "length", model.LENGTH, f"length({name}) between {r.min_length} and {r.max_length}"))
        found += [(r.position * 10 + i, f"{r.column_name} {said}", table, r.column_name, kind, condition) for i, said, kind, condition in made]
    return df.sparkSession.createDataFrame(found, CANDIDATE_SCHEMA)


def as_check(candidate: Row, side: str = "source", null_passes: bool = True) -> RuleCheck:
    """A candidate rule as a check; rows whose condition is unknown pass, as they did when it was proposed."""
    table, column, condition = candidate.table_name, candidate.column_name, candidate.condition
    if candidate.validation_type == model.UNIQUENESS:
        rule = lambda rows: unique(rows, [column])
    else:
        rule = expression(f"coalesce({condition}, true)" if null_passes else condition, candidate.name)
    return RuleCheck(name=candidate.name, validation_type=candidate.validation_type, origin="proposed", rule=rule, side=side, table=table)


def candidate_pairs(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Column checks worth proposing for two tables: ``name, source_column, destination_column, validation_type``.

    Columns pair up when their names are equal but for case and both are numbers, moments or texts.
    """
    theirs = {f.name.casefold(): f for f in destination.schema.fields}
    kinds = {
        "number": (model.NULLS, model.RANGE, model.UNIQUENESS), "moment": (model.NULLS, model.RANGE, model.FRESHNESS),
        "text": (model.NULLS, model.LENGTH, model.CATEGORICAL),
    }
    found = []
    for f in source.schema.fields:
        other = theirs.get(f.name.casefold())
        if other is not None and _family(f.dataType) == _family(other.dataType):
            found += [(f"{f.name}: {kind}", f.name, other.name, kind) for kind in kinds[_family(f.dataType)]]
    return source.sparkSession.createDataFrame(found, "name string, source_column string, destination_column string, validation_type string")


def candidate_keys(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Columns that could be the key of key parity: paired, and filled and without a repeat in the source.

    ``source_column, destination_column, destination_unique``.
    """
    pairs = {(r.source_column, r.destination_column) for r in candidate_pairs(source, destination).collect()}

    def unique_of(df: DataFrame, names: set[str]) -> set[str]:
        near = [r.column_name for r in profile(df).collect() if r.column_name in names and r.rows and not r.nulls and r.distinct_estimate >= r.rows * 0.9]
        return {name for name, twice in repeated(df, near).items() if not twice}

    ours = unique_of(source, {s for s, _ in pairs})
    theirs = unique_of(destination, {d for s, d in pairs if s in ours})
    rows = [(s, d, d in theirs) for s, d in sorted(pairs) if s in ours]
    return source.sparkSession.createDataFrame(rows, "source_column string, destination_column string, destination_unique boolean")


def name_signature(name: Column) -> Column:
    """One-sided rules are the same rule when their names are, case and blanks aside."""
    return F.lower(F.trim(name))


def tables_signature(tables: Column) -> Column:
    """A set of tables in one order."""
    return F.array_join(F.array_sort(tables), "\u0001")


def sort_out_duplicates(proposed: DataFrame, existing: DataFrame, signature: Sequence[str], order: str) -> DataFrame:
    """Proposals with ``reason`` NULL for those to create and saying why for the rest.

    The first of equal proposals is kept unless the rule exists. Equal proposals shrink to one
    row per task before the shuffle.
    """
    keys = [F.coalesce(c(name).cast("string"), F.lit("\u0000")).alias(f"__{name}") for name in signature]
    names = [f"__{name}" for name in signature]
    marked = proposed.select("*", *keys)
    first = marked.groupBy(*names).agg(F.min(order).alias("__first")).unionByName(
        existing.select(*keys).distinct().select(*names, F.lit(None).cast(proposed.schema[order].dataType).alias("__first")),
    ).groupBy(*names).agg(F.min("__first").alias("__first"), F.count_if(F.col("__first").isNull()).alias("__known"))
    kept = first.filter("__known = 0").select(F.col("__first").alias(order), F.lit(True).alias("__new"))
    return proposed.join(kept, order, "left").withColumn(
        "reason", F.when(F.col("__new").isNull(), F.lit(DUPLICATE))
    ).drop("__new")


def owned_everywhere(proposed: DataFrame, columns: Sequence[str], column: str = "column_name") -> DataFrame:
    """Proposals about a column that every selected table owns."""
    return proposed.filter(F.col(column).isin(list(columns)))
