"""Putting the tables of one side together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.columns import columns_on_every_table, missing_columns, rename_to_common
from tallymark.functions.text import normalise_columns, plain_cell, q, text
from tallymark.model import CheckError

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
MOMENTS = (T.TimestampType, T.TimestampNTZType)


def stack(frames: Sequence[DataFrame], fill: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def _decimal_digits(dtype: T.DataType) -> tuple[int, int]:
    if isinstance(dtype, T.DecimalType):
        return dtype.precision - dtype.scale, dtype.scale
    return {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10}.get(type(dtype), 19), 0


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """The type a column takes when several tables carry it under different types."""
    first = types[0]
    if all(t == first for t in types):
        return T.LongType() if isinstance(first, INTEGERS) else first
    if all(isinstance(t, INTEGERS) for t in types):
        return T.LongType()
    if all(isinstance(t, (*INTEGERS, T.DecimalType)) for t in types):
        whole = max(_decimal_digits(t)[0] for t in types)
        scale = max(_decimal_digits(t)[1] for t in types)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if all(isinstance(t, (*INTEGERS, *FLOATS, T.DecimalType)) for t in types):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, *MOMENTS)) for t in types):
        zoned = any(isinstance(t, T.TimestampType) for t in types)
        return T.TimestampType() if zoned else T.TimestampNTZType()
    return T.StringType()


def column_type(frames: Mapping[str, DataFrame], columns: Mapping[str, str]) -> T.DataType:
    gaps = missing_columns(frames, columns)
    if gaps:
        raise CheckError(f"no such column: {', '.join(gaps)}")
    return common_type([frames[t].schema[columns[t]].dataType for t in frames])


def as_type(df: DataFrame, column: str, dtype: T.DataType) -> str:
    """The column as ``dtype``, in SQL; text goes through the library's own text form."""
    own = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        return text(q(column), own)
    return q(column) if own == dtype else f"cast({q(column)} as {dtype.simpleString()})"


def tagged_union(frames: Mapping[str, DataFrame], columns: Mapping[str, str]) -> DataFrame:
    """``src_table, val`` over every table: one column scanned per table."""
    dtype = column_type(frames, columns)
    return stack([
        df.select(F.lit(table).alias("src_table"), F.expr(as_type(df, columns[table], dtype)).alias("val"))
        for table, df in frames.items()
    ])


def side_rows(frames: Mapping[str, DataFrame], column_map: Sequence[Mapping] = (), side: str = "source") -> DataFrame:
    """The rows of all tables of a side, under common names, with the columns that every table owns.

    One table alone keeps its own names and types. A column that some table lacks is not there, so a
    rule that asks for it cannot be run and no table's rows are passed over.
    """
    if len(frames) == 1:
        return next(iter(frames.values()))
    named = {t: rename_to_common(df, column_map, side, t) for t, df in frames.items()}
    kept = columns_on_every_table(named)
    if not kept:
        raise CheckError(f"no column is on every one of the tables {', '.join(frames)}")
    types = {n: common_type([df.schema[n].dataType for df in named.values()]) for n in kept}
    return stack([df.selectExpr(*(f"{as_type(df, n, types[n])} as {q(n)}" for n in kept)) for df in named.values()])


def lacking(frames: Mapping[str, DataFrame], column_map: Sequence[Mapping], side: str) -> dict[str, list[str]]:
    """Columns that some but not all tables own, with the tables that lack them."""
    owned = {t: set(rename_to_common(df, column_map, side, t).columns) for t, df in frames.items()}
    every = set().union(*owned.values())
    return {n: [t for t in frames if n not in owned[t]] for n in sorted(every) if any(n not in o for o in owned.values())}


def comparable_rows(
    source: Mapping[str, DataFrame], destination: Mapping[str, DataFrame], columns: Sequence[str]
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Both sides' tables cut to the shared columns, cells in one comparable form.

    A column typed alike everywhere is compared by value. Text, and columns whose
    types differ, go through the cell normalisation.
    """
    every = [*source.values(), *destination.values()]
    forms: dict[str, T.DataType | None] = {}
    for name in columns:
        dtype = common_type([df.schema[name].dataType for df in every if name in df.columns])
        held = [df.schema[name].dataType for df in every if name in df.columns]
        mixed = any(isinstance(t, FLOATS) for t in held) and any(isinstance(t, INTEGERS) for t in held)
        moments = len({type(t) for t in held}) > 1 and isinstance(dtype, MOMENTS)
        nested = isinstance(dtype, (T.StringType, T.StructType, T.ArrayType, T.MapType))
        forms[name] = None if nested or mixed or moments else dtype

    def cell(df: DataFrame, name: str) -> str:
        dtype = forms[name]
        if name not in df.columns:
            return "''" if dtype is None else f"cast(null as {dtype.simpleString()})"
        own = df.schema[name].dataType
        if dtype is None:
            return plain_cell(q(name), own) or text(q(name), own)
        return as_type(df, name, dtype)

    def cut(df: DataFrame) -> DataFrame:
        texts = [
            n for n in columns
            if forms[n] is None and n in df.columns and not plain_cell(q(n), df.schema[n].dataType)
        ]
        return normalise_columns(df.selectExpr(*(f"{cell(df, n)} as {q(n)}" for n in columns)), texts)

    return [cut(df) for df in source.values()], [cut(df) for df in destination.values()]
