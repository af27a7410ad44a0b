"""Nested columns to flat ones with dotted names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions.columns import c


def _flat(col: Column, name: str, dtype: T.DataType) -> Iterator[Column]:
    if isinstance(dtype, T.StructType) and dtype.fields:
        for field in dtype.fields:
            yield from _flat(col.getField(field.name), f"{name}.{field.name}", field.dataType)
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        yield F.to_json(col).alias(name)
    else:
        yield col.alias(name)


def flatten(df: DataFrame) -> DataFrame:
    """Structs become dotted columns; lists and maps become JSON text, so rows never multiply."""
    if not any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in df.schema.fields):
        return df
    return df.select(*(col for f in df.schema.fields for col in _flat(c(f.name), f.name, f.dataType)))
