"""Checks written by the user: one SELECT or one callable, graded by what it returns."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


from tallymark.functions.text import literal, q
from tallymark.model import CheckError
from tallymark.operators.verdicts import NUMBERS, same_value, shown, together, verdict
from tallymark.session import quoted_identifiers

# The columns a script's row may carry, and what counts as yes.
CHECK_COLUMNS = ("passed", "details", "violations", "total_rows")
VALUE_COLUMNS = ("value", "details")
YES = ("1", "true", "yes")
# Words that are refused in a script.
REFUSED = (
    "insert", "update", "delete", "drop", "alter", "truncate", "merge", "exec", "execute", "grant", "revoke",
)

TEXT_OR_COMMENT = re.compile(r"('(?:''|[^'])*(?:'|\Z))|--[^\n]*|/\*.*?(?:\*/|\Z)", re.DOTALL)
REFUSED_WORD = re.compile(rf"\b({'|'.join(REFUSED)})\b", re.IGNORECASE)

NO_ROWS = "nothing to grade: the script gave no row"
ANALYSIS = threading.Lock()

MEASURED = "no passed column, so the figures are noted and not judged"


def select_only(sql: str) -> str:
    """The statement without its closing semicolon, if it is one plain SELECT.

    What stands in text literals and comments is data and never refused.
    """
    code = TEXT_OR_COMMENT.sub(lambda found: "''" if found.group(1) else " ", sql).strip()
    end = len(code) - len(code.rstrip("; \t\r\n"))
    code = code[:len(code) - end]
    if ";" in code:
        raise CheckError("a script is one statement; a second one follows its semicolon")
    if code[:6].lower() != "select" or code[6:7].isidentifier():
        raise CheckError("a script is a SELECT statement")
    found = REFUSED_WORD.search(code)
    if found:
        raise CheckError(f"a script may not use the word {found.group(1).lower()!r}")
    return sql.strip().rstrip("; \t\r\n")


@contextmanager
def _as_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> Iterator[None]:
    """The tables as views by name, for as long as a statement is analysed."""
    covered = {}
    for name, df in tables.items():
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
            covered[name] = spark.table(name)
        df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in tables:
            if name in covered:
                covered[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def user_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The user's SELECT over the given tables, analysed but not run.

    Views and the quoting setting belong to the session, so one statement is analysed at a
    time; running what comes out needs neither.
    """
    statement = select_only(sql)
    with ANALYSIS, _as_views(spark, tables or {}), quoted_identifiers(spark):
        return spark.sql(statement)


def bind(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None) -> tuple[bool, str | None]:
    """Does the statement parse and do its names resolve? Nothing is run."""
    try:
        user_sql(spark, sql, tables).schema
    except Exception as problem:  # whatever analysis reports is the answer
        return False, str(problem).strip()
    return True, None


def first_row(df: DataFrame) -> DataFrame:
    return df.limit(1)


def _names(df: DataFrame) -> dict[str, str]:
    return {name.lower(): name for name in df.columns}


def _extras(row: str, schema: T.StructType, reserved: Sequence[str]) -> Column | None:
    parts = [
        f"concat({literal(f.name + ' = ')}, {shown(f'{row}.{q(f.name)}', f.dataType)})"
        for f in schema.fields if f.name.lower() not in reserved
    ]
    return F.expr(f"concat_ws(', ', {', '.join(parts)})") if parts else None


def _passed(value: Column, dtype: T.DataType) -> Column:
    """True or False, NULL when the value says neither."""
    if isinstance(dtype, T.BooleanType):
        return value
    if isinstance(dtype, NUMBERS):
        return value != 0
    if isinstance(dtype, T.StringType):
        return F.lower(F.trim(value)).isin(*YES)
    return F.lit(None).cast("boolean")


def grade(df: DataFrame, measured_note: str = MEASURED) -> DataFrame:
    """The verdict of a one-row result: optional passed, details, violations, total_rows."""
    names = _names(df)
    schema = df.schema
    row = F.col("row")
    out = together(row=first_row(df))
    read = {n: row[names[n]] for n in CHECK_COLUMNS if n in names}
    extras = _extras("row", schema, CHECK_COLUMNS)
    details = F.concat_ws(
        " | ",
        F.nullif(read["details"].cast("string"), F.lit("")) if "details" in read else F.lit(None),
        extras if extras is not None else F.lit(None),
    )
    if "passed" in read:
        passed = _passed(read["passed"], schema[names["passed"]].dataType)
        unread = F.concat(
            F.lit("passed says neither yes nor no: "),
            F.expr(shown(f"row.{q(names['passed'])}", schema[names["passed"]].dataType)),
        )
        details = F.when(passed.isNull(), F.concat_ws(" | ", unread, extras if extras is not None else F.lit(None))).otherwise(details)
    else:
        passed = row.isNotNull()
        details = F.when(details == "", F.lit(measured_note)).otherwise(F.concat(F.lit(f"{measured_note}: "), details))
    none = F.lit(None)
    return out.select(*verdict(
        F.coalesce(passed & row.isNotNull(), F.lit(False)),
        read.get("violations", none).try_cast("double"), read.get("total_rows", none).try_cast("bigint"),
        F.when(row.isNull(), F.lit(NO_ROWS)).otherwise(F.nullif(details, F.lit(""))),
    ))


def sql_check(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    return grade(user_sql(spark, sql, tables))


Reader = Callable[[str], DataFrame]
Callback = Callable[[SparkSession, Reader], Any]


def reader(tables: Mapping[str, DataFrame]) -> Reader:
    """``read_table(name)`` for callables: ``"schema"."table"`` quoting is optional."""

    def read(name: str) -> DataFrame:
        plain = name.replace('"', "")
        if name in tables or plain in tables:
            return tables.get(name, tables.get(plain))
        raise CheckError(f"no such table: {name}")

    return read


def call(spark: SparkSession, callback: Callback, tables: Mapping[str, DataFrame]) -> DataFrame:
    """What the callable returns, as a one-row frame."""
    answer = callback(spark, reader(tables))
    if isinstance(answer, DataFrame):
        return answer
    if not isinstance(answer, Mapping):
        raise CheckError(f"the script's result is neither a dict nor a DataFrame: {answer!r}")
    if not answer:
        return spark.range(1).select()
    return spark.range(1).select(*(
        F.lit(value).alias(str(key)) for key, value in answer.items()
    ))


def callable_check(spark: SparkSession, callback: Callback, tables: Mapping[str, DataFrame]) -> DataFrame:
    note = "no passed key, so the figures are noted and not judged"
    return grade(call(spark, callback, tables), note)


def _value_column(df: DataFrame, side: str) -> str:
    names = _names(df)
    if "value" in names:
        return names["value"]
    if len(df.columns) == 1:
        return df.columns[0]
    raise CheckError(
        f"which of {', '.join(df.columns)} is the {side}'s value? call one of them value, or give one column only"
    )


def dual_value(source: DataFrame, destination: DataFrame) -> DataFrame:
    """One value per side, compared; a numeric gap is the violation count."""
    used = {"source": _value_column(source, "source"), "destination": _value_column(destination, "destination")}
    schemas = {"source": source.schema, "destination": destination.schema}
    pair = together(source=first_row(source), destination=first_row(destination))
    types = {side: schemas[side][used[side]].dataType for side in used}
    at = {side: f"{side}.{q(name)}" for side, name in used.items()}
    s, d = F.expr(at["source"]), F.expr(at["destination"])
    equal = F.expr(same_value(at["source"], types["source"], at["destination"], types["destination"]))
    both_numbers = all(isinstance(t, NUMBERS) for t in types.values())
    flag = F.when(equal, F.lit(0)).otherwise(F.lit(1))
    violations = F.coalesce(F.abs(s - d).cast("double"), flag.cast("double")) if both_numbers else flag
    notes = []
    for side, schema in schemas.items():
        row = F.col(side)
        held = {f.name.lower(): f.name for f in schema.fields}
        parts = [F.nullif(row[held["details"]].cast("string"), F.lit(""))] if "details" in held else []
        extras = _extras(side, schema, (*VALUE_COLUMNS, used[side].lower()))
        parts += [extras] if extras is not None else []
        if parts:
            said = F.concat_ws(", ", *parts)
            notes.append(F.when(said != "", F.concat(F.lit(f"{side}: "), said)))
    details = F.concat(
        F.lit("source has "), F.expr(shown(at["source"], types["source"])),
        F.lit(", destination has "), F.expr(shown(at["destination"], types["destination"])),
    )
    if notes:
        said = F.concat_ws("; ", *notes)
        details = F.concat(details, F.when(said != "", F.concat(F.lit(" ("), said, F.lit(")"))).otherwise(F.lit("")))
    empty = F.when(F.col("source").isNull(), F.lit("source")).when(F.col("destination").isNull(), F.lit("destination"))
    problem = F.when(empty.isNotNull(), F.concat(F.lit("no value: the script of the "), empty, F.lit(" gave no row")))
    return pair.select(
        *verdict(equal, violations, F.lit(None), details), problem.alias("error_message")
    ).select(
        F.when(F.col("error_message").isNotNull(), F.lit("ERROR")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("error_message").isNull(), F.col("details")).alias("details"),
        F.when(F.col("error_message").isNull(), F.col("violations")).alias("violations"),
        "total_rows", "error_message",
    )


def dual_frames(
    spark: SparkSession, source: str | Callback, source_tables: Mapping[str, DataFrame],
    destination: str | Callback, destination_tables: Mapping[str, DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Both sides' results; two callables run at the same time, each on its own thread."""

    def one(script: str | Callback, tables: Mapping[str, DataFrame]) -> DataFrame:
        if callable(script):
            return call(spark, script, tables)
        return user_sql(spark, script, tables)

    if callable(source) and callable(destination):
        with ThreadPoolExecutor(max_workers=2) as pool:
            left = pool.submit(one, source, source_tables)
            right = pool.submit(one, destination, destination_tables)
            return left.result(), right.result()
    return one(source, source_tables), one(destination, destination_tables)
