"""Compare registered queries with their SQL: ``python tests/oracle.py FOLDER [NAME ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (round(value, 6) + 0.0)
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def keyed(rows):
    return sorted((tuple((type(v).__name__, str(v)) for v in row) for row in rows))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    from workload.registry import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def expected(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(row[i]) for i in order) for row in result.fetchall()]
    return sorted(names), rows


def actual(df):
    order = sorted(df.columns)
    rows = [tuple(plain(row[name]) for name in order) for row in df.collect()]
    return order, rows


def differences(spark, con, folder: str, name: str, fn, sql: str | None) -> str | None:
    """None when the query and its SQL agree, else what differs."""
    columns, rows = actual(fn(spark, folder))
    if sql is None:
        return None
    want_columns, want = expected(con, sql)
    if columns != want_columns:
        return f"columns {columns} instead of {want_columns}"
    if len(rows) != len(want):
        return f"{len(rows)} rows instead of {len(want)}"
    got, should = keyed(rows), keyed(want)
    if got != should:
        pairs = [(g, s) for g, s in zip(got, should) if g != s]
        return f"{len(pairs)} rows differ, first: {pairs[0][0]} instead of {pairs[0][1]}"
    return None


def main() -> int:
    from tallymark.session import build_session

    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            problem = differences(spark, con, folder, name, fn, sqls.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - began:.1f}s {'' if sqls.get(name) else '(no sql) '}{problem or ''}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
