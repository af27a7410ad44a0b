"""Which columns belong together, judged by their values: likely partners of two tables, and inclusions between many.

Sketches say which columns may be partners, from one scan a table and without a shuffle of values. What is reported is exact: values of
all columns in question meet in one grouping, each with the bits of the columns that hold it, so a hot value leaves every task as
one row and pairs of columns are never joined.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.columns import c
from tallymark.functions.text import NESTED, literal, q, text
from tallymark.operators.sides import stack
from tallymark.operators.verdicts import together

#: Base-two logarithm of the smallest hashes that a sketch keeps: shares within two percent or so.
SKETCH_LOG2 = 12
#: Estimates may be off by this much without a pair being passed over.
SLACK = 0.2
#: Bits in one whole number.
WORD = 62

Column = tuple[str, str]


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns that hold one value each; lists, maps and structs are no partners."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (*NESTED, T.NullType))]


def value_text(df: DataFrame, name: str) -> str:
    """A value under which equal values of any two columns meet; of long texts a digest."""
    own = text(q(name), df.schema[name].dataType)
    return f"if(length({own}) <= 32, {own}, concat('#', sha2({own}, 256)))"


def column_sketches(df: DataFrame) -> DataFrame:
    """One row: ``columns``, an array of column_name, distinct_estimate and sketch (of the values' smallest hashes), from one scan."""
    entries = ", ".join(
        f"named_struct('column_name', {literal(n)}, 'sketch', theta_sketch_agg({value_text(df, n)}, {SKETCH_LOG2}))" for n in scalar_columns(df))
    made = df.selectExpr(f"array({entries}) as sketches")
    return made.select(F.transform("sketches", lambda e: F.struct(
        e["column_name"].alias("column_name"), F.theta_sketch_estimate(e["sketch"]).alias("distinct_estimate"), e["sketch"].alias("sketch"))).alias("columns"))


def estimated_pairs(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Every pair of columns of two tables: source_column, destination_column, in_destination and in_source.

    The two figures are estimated shares of one column's distinct values that the other has too. Only sketches are read for them, one
    row a table; there are as many rows as pairs of columns.
    """
    both = together(s=column_sketches(source), d=column_sketches(destination))
    pairs = both.select(F.explode("s.columns").alias("s"), "d.columns").select("s", F.explode("columns").alias("d"))
    shared = F.theta_sketch_estimate(F.theta_intersection("s.sketch", "d.sketch"))
    return pairs.select(
        F.col("s.column_name").alias("source_column"), F.col("d.column_name").alias("destination_column"),
        F.try_divide(shared, F.col("s.distinct_estimate")).alias("in_destination"),
        F.try_divide(shared, F.col("d.distinct_estimate")).alias("in_source"))


def value_columns(tables: Mapping[str, DataFrame], columns: Sequence[Column]) -> tuple[DataFrame, list[int]]:
    """One row per distinct value: value and, in words w0, w62, ..., a bit for every column (by its place in ``columns``) that holds it.

    A table is read once, whatever the number of its columns; nulls are no value.
    """
    words = list(range(0, max(1, len(columns)), WORD))
    arms = []
    for table, df in tables.items():
        own = [(i, name) for i, (of, name) in enumerate(columns) if of == table]
        if own:
            entries = ", ".join(
                f"named_struct('value', {value_text(df, name)}, 'at', {i})" for i, name in own)
            cells = df.selectExpr(f"inline(array({entries}))").where("value is not null")
            arms.append(cells.selectExpr("value", *(
                f"if(at between {first} and {first + WORD - 1}, shiftleft(1L, at - {first}), 0L) as w{first}" for first in words)))
    return stack(arms).groupBy("value").agg(*(F.bit_or(f"w{first}").alias(f"w{first}") for first in words)), words


def _held(position: int) -> F.Column:
    first = position - position % WORD
    return F.col(f"w{first}").bitwiseAND(F.lit(1 << (position - first)).cast("bigint")) != 0


PAIRS = "source_column string, destination_column string, source_values bigint, destination_values bigint, shared_values bigint, overlap double"


def content_pairs(source: DataFrame, destination: DataFrame, least: float = 0.5) -> DataFrame:
    """Columns of two tables that hold the same values, whatever their names: ``source_column, destination_column, source_values,
    destination_values, shared_values, overlap``.

    A pair is reported when both columns have at least ``least`` of their distinct values in the other; overlap is the smaller of the
    two shares. Sketches rule out most pairs; of the others the values are counted exactly, all in one shuffle. Tables without
    rows pair with nothing; null is no value.
    """
    worth = estimated_pairs(source, destination).where(
        (F.col("in_destination") >= least - SLACK) & (F.col("in_source") >= least - SLACK)).select("source_column", "destination_column").collect()
    spark = source.sparkSession
    if not worth:
        return spark.createDataFrame([], PAIRS)
    columns = [("s", n) for n in sorted({r.source_column for r in worth})] + [("d", n) for n in sorted({r.destination_column for r in worth})]
    place = {column: i for i, column in enumerate(columns)}
    values, _ = value_columns({"s": source, "d": destination}, columns)
    counted = values.agg(
        *(F.count_if(_held(i)).alias(f"n{i}") for i in range(len(columns))),
        *(F.count_if(_held(place["s", r.source_column]) & _held(place["d", r.destination_column])).alias(f"p{k}") for k, r in enumerate(worth)))
    rows = F.array(*(F.struct(
        F.lit(r.source_column).alias("source_column"), F.lit(r.destination_column).alias("destination_column"),
        F.col(f"n{place['s', r.source_column]}").alias("source_values"), F.col(f"n{place['d', r.destination_column]}").alias("destination_values"),
        F.col(f"p{k}").alias("shared_values")) for k, r in enumerate(worth)))
    found = counted.select(F.inline(rows)).withColumn(
        "overlap", F.least(F.try_divide("shared_values", "source_values"), F.try_divide("shared_values", "destination_values")))
    return found.where(F.col("overlap") >= least)


def _inclusions(tables: Mapping[str, DataFrame], columns: Sequence[Column]) -> list[tuple[Column, Column, int, int]]:
    """(child, parent, child's values, parent's values) for columns all of whose values another column has too."""
    values, words = value_columns(tables, columns)
    names = [f"w{first}" for first in words]
    sets = values.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    # A column's parents are the columns that all of its values have in common.
    holders = F.filter(F.array(*(F.when(_held(i), F.lit(i)) for i in range(len(columns)))), lambda i: i.isNotNull())
    common = sets.select("n", *names, F.explode(holders).alias("at")).groupBy("at").agg(
        F.sum("n").alias("n"), *(F.bit_and(w).alias(w) for w in names))
    rows = {r["at"]: r for r in common.collect()}
    count = {i: r["n"] for i, r in rows.items()}
    return [
        (columns[i], columns[j], count[i], count[j]) for i, r in sorted(rows.items()) for j in range(len(columns))
        if i != j and r[f"w{j - j % WORD}"] >> (j % WORD) & 1]


def inclusions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns whose values all are in another column: ``child_table, child_column, parent_table, parent_column, child_values, parent_values``.

    All columns of all tables are compared by one grouping of their values. Columns without a value are in none and hold none.
    """
    columns = [(t, n) for t, df in tables.items() for n in scalar_columns(df)]
    found = [(*child, *parent, few, many) for child, parent, few, many in _inclusions(tables, columns)]
    return next(iter(tables.values())).sparkSession.createDataFrame(
        found, "child_table string, child_column string, parent_table string, parent_column string, child_values bigint, parent_values bigint")


def stems(names: Sequence[str]) -> dict[str, str]:
    """Names without what all of them begin with up to an underscore, in lower case: ``o_custkey`` is ``custkey`` among ``o_...``."""
    shared = {re.match("[^_]*_|", n).group() for n in names}
    drop = len(shared.pop()) if len(shared) == 1 and len(names) > 1 else 0
    return {n: n[drop:].lower() for n in names}


def foreign_keys(tables: Mapping[str, DataFrame], least: float = 0.0) -> DataFrame:
    """Likely foreign keys: the inclusions whose parent is a key of another table (filled, no repeats) and whose names agree but for their
    tables' prefixes, with ``coverage``, the share of the parent's values that the child has.

    Of several parents the one with the highest coverage is reported, of two keys with equal values only the first of the tables is a parent. Pairs
    under ``least`` coverage are left out. Rows and filled cells of the tables are counted in one scan each.
    """
    stem = {(t, n): s for t, df in tables.items() for n, s in stems(df.columns).items()}
    of_stem: dict[str, list[Column]] = {}
    for (t, n), s in stem.items():
        if n in scalar_columns(tables[t]):
            of_stem.setdefault(s, []).append((t, n))
    columns = [column for group in of_stem.values() if len({t for t, _ in group}) > 1 for column in group]
    schema = "child_table string, child_column string, parent_table string, parent_column string, child_values bigint, parent_values bigint, coverage double"
    spark = next(iter(tables.values())).sparkSession
    if not columns:
        return spark.createDataFrame([], schema)
    wanted = {t: df.select(*(c(n) for of, n in columns if of == t)) for t, df in tables.items() if any(of == t for of, _ in columns)}
    filled = stack([
        df.agg(F.count(F.lit(1)).alias("rows"), *(F.count(c(n)).alias(f"f{i}") for i, n in enumerate(df.columns))).select(
            F.lit(t).alias("t"), F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col("rows"), F.col(f"f{i}").alias("filled")) for i, n in enumerate(df.columns)))).alias("e")
        ).select("t", "e.*") for t, df in wanted.items()]).collect()
    rows = {(r.t, r.n): r.rows if r.rows == r.filled else None for r in filled}
    order = list(tables)
    best: dict[Column, tuple] = {}
    for child, parent, few, many in _inclusions(wanted, columns):
        key = rows[parent] == many
        mirrored = few == many and rows[child] == few and order.index(child[0]) < order.index(parent[0])
        if key and not mirrored and child[0] != parent[0] and stem[child] == stem[parent] and few / many >= least:
            made = (*child, *parent, few, many, few / many)
            if child not in best or made[-1] > best[child][-1]:
                best[child] = made
    return spark.createDataFrame(list(best.values()), schema)
