from concurrent.futures import ThreadPoolExecutor

import pytest

from tallymark.model import CheckError
from tallymark.operators import scripts
from workload import parity_queries, registry


def graded(spark, sql, **tables):
    row = scripts.sql_check(spark, sql, tables).first()
    return row.status, row.details, row.violations, row.total_rows


@pytest.mark.parametrize("value, status", [
    ("1", "PASS"), ("0", "FAIL"), ("true", "PASS"), ("false", "FAIL"), ("' YES '", "PASS"), ("'banana'", "FAIL"), ("2.5", "PASS"),
    ("'1'", "PASS"),
])
def test_what_counts_as_passed(spark, value, status):
    assert graded(spark, f"SELECT {value} AS passed") == (status, None, None, None)


def test_one_row_contract(spark):
    assert graded(spark, "SELECT null AS passed")[:2] == ("FAIL", "passed says neither yes nor no: None")
    assert graded(spark, "SELECT 1 AS passed WHERE 1 = 0")[:2] == ("FAIL", scripts.NO_ROWS)
    assert graded(spark, "SELECT 1 AS n WHERE 1 = 0")[:2] == ("FAIL", scripts.NO_ROWS)
    assert graded(spark, "SELECT 7 AS n, 'x' AS t")[:2] == ("PASS", f"{scripts.MEASURED}: n = 7, t = x")
    assert graded(spark, "SELECT 'fine' AS details") == ("PASS", f"{scripts.MEASURED}: fine", None, None)
    got = graded(spark, "SELECT 0 AS passed, 'bad' AS details, 3 AS violations, 9 AS total_rows, 140 AS male_count")
    assert got == ("FAIL", "bad | male_count = 140", 3.0, 9)


def test_quoted_names_are_columns(spark):
    df = spark.createDataFrame([(1,)], "`Order ID` int")
    assert graded(spark, 'SELECT max("Order ID") AS n FROM t', t=df)[1].endswith("n = 1")


def test_views_and_settings_are_put_back(spark):
    spark.range(9).createOrReplaceTempView("mine")
    with ThreadPoolExecutor(4) as pool:
        frames = list(pool.map(lambda n: scripts.user_sql(spark, 'SELECT count("id") AS n FROM mine', {"mine": spark.range(n)}), range(8)))
    assert [f.first().n for f in frames] == list(range(8))
    assert spark.table("mine").count() == 9 and spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"
    scripts.user_sql(spark, "SELECT 1 FROM passing", {"passing": spark.range(1)})
    assert not spark.catalog.tableExists("passing")


@pytest.mark.parametrize("sql", [
    "SELECT 1; SELECT 2", "DELETE FROM t", "WITH x AS (SELECT 1) SELECT * FROM x", "-- only a comment", "SELECT 1 /* ; */; DROP TABLE t",
    "SELECT merge FROM t", "/* SELECT */ INSERT INTO t VALUES (1)",
])
def test_refused_statements(sql):
    with pytest.raises(CheckError):
        scripts.select_only(sql)


@pytest.mark.parametrize("sql", [
    "SELECT 1;", "-- drop everything\nSELECT 1", "/* delete; */ select 'a--b', 'it''s' /* x", "  SELECT updated FROM t  ",
])
def test_accepted_statements(sql):
    assert scripts.select_only(sql) == sql.strip().rstrip(";")


def test_binding_reports_without_running(spark):
    assert scripts.bind(spark, "SELECT id FROM t", {"t": spark.range(1)}) == (True, None)
    ok, why = scripts.bind(spark, "SELECT nope FROM t", {"t": spark.range(1)})
    assert not ok and "nope" in why
    assert scripts.bind(spark, "DROP TABLE t")[0] is False


def compared(spark, left, right):
    row = scripts.dual_value(spark.sql(left), spark.sql(right)).first()
    return row.status, row.details, row.violations, row.error_message


def test_dual_values(spark):
    assert compared(spark, "SELECT 1000", "SELECT 592 AS value, 'why' AS details, 5 AS n") == (
        "FAIL", "source has 1000, destination has 592 (destination: why, n = 5)", 408.0, None)
    assert compared(spark, "SELECT 5", "SELECT 5.0D")[0] == "PASS"
    assert compared(spark, "SELECT 'a'", "SELECT 'b'")[::2] == ("FAIL", 1.0)
    assert compared(spark, "SELECT 5", "SELECT '5'")[0] == "FAIL"
    assert compared(spark, "SELECT cast(null AS int)", "SELECT cast(null AS string)")[0] == "PASS"
    assert compared(spark, "SELECT true", "SELECT 1")[::2] == ("PASS", 0.0)
    assert compared(spark, "SELECT 1 WHERE 1 = 0", "SELECT 1") == ("ERROR", None, None, "no value: the script of the source gave no row")
    with pytest.raises(CheckError, match="which of a, b is the source's value"):
        scripts.dual_value(spark.sql("SELECT 1 AS a, 2 AS b"), spark.sql("SELECT 1"))


def test_registered_dual_value_shows_both_figures(spark, folder):
    row = registry.QUERIES["dual_value"](spark, folder).first()
    figures = [spark.read.parquet(f"{folder}/orders.parquet").select("o_custkey").dropna().distinct().count()]
    figures.append(registry.Tables(spark, folder).sql(parity_queries.DST).select("o_custkey").dropna().distinct().count())
    assert [row.source_value, row.destination_value] == [str(n) for n in figures]


def test_callables(spark):
    tables = {"t": spark.range(3)}

    def asserting(session, read_table):
        return {"passed": read_table('"t"').count() == 3, "violations": 0, "note": "all there"}

    row = scripts.callable_check(spark, asserting, tables).first()
    assert (row.status, row.details, row.violations) == ("PASS", "note = all there", 0.0)
    row = scripts.callable_check(spark, lambda s, r: {"n": 3}, tables).first()
    assert row.status == "PASS" and row.details.startswith("no passed") and row.details.endswith("n = 3")
    row = scripts.callable_check(spark, lambda s, r: {"passed": None}, tables).first()
    assert row.status == "FAIL"
    with pytest.raises(CheckError, match="neither"):
        scripts.callable_check(spark, lambda s, r: 3, tables)
    with pytest.raises(CheckError, match="no such table"):
        scripts.callable_check(spark, lambda s, r: r("u"), tables)


def test_literals_and_comments_are_never_refused(spark):
    tables = {"t": spark.range(3)}
    for sql, ok in (("SELECT 'delete me; please' AS details", True), ("SELECT max(id) -- ; drop it\nFROM t", True), ("SELECT 1; ", True),
                    ("SELECT id FROM t; DROP TABLE t", False), ("DELETE FROM t", False), ("SELECT nope FROM t", False), ("selected", False)):
        assert scripts.bind(spark, sql, tables)[0] is ok, sql
