"""One-sided rules and scripts."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import model
from tallymark.model import (
    SOURCE_ONLY, ColumnParity, DualScriptCheck, KeyParity, Mapping, RowCountMatch, RuleCheck, ScriptCheck,
)
from tallymark.operators import rules
from tallymark.operators.scripts import bind, callable_check, sql_check, user_sql
from tallymark.plans.runner import run
from workload.inputs import DST, SRC_A
from workload.parity_queries import VERDICT, verdict_of
from workload.registry import Tables, duck, query

D = duck(DST)


def rule_sql(table: str, bad: str) -> str:
    return f"""
    WITH n AS (SELECT count(*) AS rows, count(*) FILTER ({bad}) AS bad FROM {table})
    SELECT CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(bad AS DOUBLE) AS violations, rows AS total_rows FROM n
    """


@query("rule_null", rule_sql(f"({D})", "o_custkey IS NULL"))
def rule_null(t: Tables) -> DataFrame:
    return verdict_of(rules.check_rule(t.sql(DST), rules.not_null("o_custkey")))


@query("rule_range", rule_sql("lineitem", "l_quantity < 3 OR l_quantity > 45"))
def rule_range(t: Tables) -> DataFrame:
    return verdict_of(rules.check_rule(t.lineitem, rules.in_range("l_quantity", 3, 45)))


@query("rule_regex", rule_sql("documents", "NOT regexp_matches(text, '[.!?]$')"))
def rule_regex(t: Tables) -> DataFrame:
    return verdict_of(rules.check_rule(t.documents, rules.matches(t.documents, "text", "[.!?]$")))


@query("rule_length", rule_sql("documents", "length(text) < 40 OR length(text) > 4000"))
def rule_length(t: Tables) -> DataFrame:
    return verdict_of(rules.check_rule(t.documents, rules.length_between(t.documents, "text", 40, 4000)))


@query("rule_categorical", rule_sql("events", "event_type NOT IN ('click', 'view')"))
def rule_categorical(t: Tables) -> DataFrame:
    return verdict_of(rules.check_rule(t.events, rules.allowed_values("event_type", ["click", "view"])))


@query("rule_expression", rule_sql("lineitem", "NOT (l_discount <= l_tax OR l_quantity > 10)"))
def rule_expression(t: Tables) -> DataFrame:
    return verdict_of(rules.check_rule(t.lineitem, rules.expression("l_discount <= l_tax or l_quantity > 10")))


@query("rule_volume", """
WITH n AS (SELECT count(*) AS rows FROM events)
SELECT CASE WHEN rows BETWEEN 5 AND 700 THEN 'PASS' ELSE 'FAIL' END AS status,
       CAST(greatest(5 - rows, 0) + greatest(rows - 700, 0) AS DOUBLE) AS violations, rows AS total_rows FROM n
""")
def rule_volume(t: Tables) -> DataFrame:
    return verdict_of(rules.check_rule(t.events, rules.volume_between(5, 700)))


@query("rule_freshness", """
SELECT CASE WHEN max(ts) >= TIMESTAMP '2024-02-05 00:00:00' THEN 'PASS' ELSE 'FAIL' END AS status,
       CASE WHEN max(ts) >= TIMESTAMP '2024-02-05 00:00:00' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS violations,
       count(*) AS total_rows FROM events
""")
def rule_freshness(t: Tables) -> DataFrame:
    rule = rules.fresh("ts", datetime(2024, 2, 6), timedelta(days=1))
    return verdict_of(rules.check_rule(t.events, rule))


@query("rule_unique", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
       CAST(count(*) FILTER (n > 1) AS DOUBLE) AS violations, CAST(sum(n) AS BIGINT) AS total_rows FROM k
""")
def rule_unique(t: Tables) -> DataFrame:
    return verdict_of(rules.unique(t.lineitem, ["l_orderkey", "l_linenumber"]))


@query("rule_unique_texts", """
WITH k AS (SELECT text, count(*) AS n FROM documents GROUP BY ALL)
SELECT CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
       CAST(count(*) FILTER (n > 1) AS DOUBLE) AS violations, CAST(sum(n) AS BIGINT) AS total_rows FROM k
""")
def rule_unique_texts(t: Tables) -> DataFrame:
    return verdict_of(rules.unique(t.documents, ["text"], digest=True))


@query("rule_referential", """
WITH n AS (SELECT count(*) AS rows, count(*) FILTER (NOT EXISTS (
    SELECT 1 FROM orders o WHERE o.o_orderkey % 101 <> 0 AND o.o_orderkey = l.l_orderkey)) AS bad FROM lineitem l)
SELECT CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(bad AS DOUBLE) AS violations, rows AS total_rows FROM n
""")
def rule_referential(t: Tables) -> DataFrame:
    parent = t.orders.filter("o_orderkey % 101 <> 0")
    return verdict_of(rules.referential(t.lineitem, "l_orderkey", parent, "o_orderkey"))


@query("rule_referential_holds", """
SELECT 'PASS' AS status, 0.0::DOUBLE AS violations, count(*) AS total_rows FROM nation
WHERE n_regionkey IN (SELECT r_regionkey FROM region)
""")
def rule_referential_holds(t: Tables) -> DataFrame:
    return verdict_of(rules.referential(t.nation, "n_regionkey", t.region, "r_regionkey"))


@query("rules_one_scan", """
WITH n AS (SELECT count(*) AS rows, count(*) FILTER (l_quantity > 40) AS a, count(*) FILTER (l_returnflag <> 'N') AS b,
                  count(*) FILTER (l_discount IS NULL) AS c, count(*) FILTER (length(l_linestatus) <> 1) AS d,
                  count(*) FILTER (NOT regexp_matches(l_linestatus, '^[O]')) AS e FROM lineitem),
v AS (SELECT 0 AS position, a AS bad, rows FROM n UNION ALL SELECT 1, b, rows FROM n UNION ALL SELECT 2, c, rows FROM n
      UNION ALL SELECT 3, d, rows FROM n UNION ALL SELECT 4, e, rows FROM n)
SELECT position, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(bad AS DOUBLE) AS violations,
       rows AS total_rows FROM v
""")
def rules_one_scan(t: Tables) -> DataFrame:
    df = t.lineitem
    return rules.check_rows(df, [
        rules.in_range("l_quantity", None, 40), rules.allowed_values("l_returnflag", ["N"]), rules.not_null("l_discount"),
        rules.length_between(df, "l_linestatus", 1, 1), rules.matches(df, "l_linestatus", "^[O]"),
    ]).select("position", *VERDICT)


@query("sql_contract", """
SELECT CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(count(*) AS DOUBLE) AS violations,
       (SELECT count(*) FROM orders) AS total_rows,
       CAST(count(*) AS VARCHAR) || ' cheap orders | cheapest = ' || CAST(min(o_orderkey) AS VARCHAR) AS details
FROM orders WHERE o_totalprice < 5000
""")
def sql_contract(t: Tables) -> DataFrame:
    return sql_check(t.spark, """
        -- orders that are too cheap; "drop" in a comment is fine
        SELECT CASE WHEN count(*) = 0 THEN 'yes' ELSE 'no' END AS passed, count(*) AS violations,
               (SELECT count(*) FROM orders) AS total_rows, CAST(count(*) AS STRING) || ' cheap orders' AS details,
               min("o_orderkey") AS cheapest
        FROM orders WHERE o_totalprice < 5000;
    """, {"orders": t.orders}).select("status", "violations", "total_rows", "details")


@query("sql_join_check", f"""
WITH x AS (SELECT count(*) AS n FROM orders o JOIN ({D}) d USING (o_orderkey) WHERE o.o_orderstatus <> d.o_orderstatus)
SELECT CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(n AS DOUBLE) AS violations FROM x
""")
def sql_join_check(t: Tables) -> DataFrame:
    """One statement over both sides."""
    return sql_check(t.spark, """
        SELECT count(*) = 0 AS passed, count(*) AS violations
        FROM orders o JOIN dst d ON o.o_orderkey = d.o_orderkey WHERE o.o_orderstatus <> d.o_orderstatus
    """, {"orders": t.orders, "dst": t.sql(DST)}).select("status", "violations")


@query("measured_only", """
SELECT 'PASS' AS status, 'no passed column, so the figures are noted and not judged: n = '
       || CAST(count(*) AS VARCHAR) AS details FROM orders WHERE o_orderstatus = 'F'
""")
def measured_only(t: Tables) -> DataFrame:
    return sql_check(
        t.spark, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'", {"orders": t.orders}
    ).select("status", "details")


@query("callable_check", f"""
SELECT CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(count(*) AS DOUBLE) AS violations,
       (SELECT count(*) FROM ({D})) AS total_rows FROM ({D}) WHERE o_custkey IS NULL
""")
def callable_script(t: Tables) -> DataFrame:
    def script(spark, read_table):
        figures = read_table('"dst"').select(
            F.count_if(F.col("o_custkey").isNull()).alias("violations"), F.count(F.lit(1)).alias("total_rows")
        )
        return figures.withColumn("passed", F.col("violations") == 0)

    return verdict_of(callable_check(t.spark, script, {"dst": t.sql(DST)}))


# Odd orders under another key name, with the only defects and without a priority.
SRC_B_DEFECTS = """
SELECT o_orderkey AS order_no, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 59 = 0 THEN -1.0 ELSE o_totalprice END AS o_totalprice
FROM {orders} WHERE o_orderkey % 2 = 1
"""


@query("rule_all_tables", """
WITH n AS (SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 2 = 1 AND o_orderkey % 53 = 0) AS empty,
                  count(*) FILTER (o_orderkey % 2 = 1 AND o_orderkey % 59 = 0) AS negative FROM orders)
SELECT 'customer filled' AS test_name, 'a, b' AS rule_target, CASE WHEN empty = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
       CAST(empty AS DOUBLE) AS violations, rows AS total_rows FROM n
UNION ALL SELECT 'price not negative', 'a, b', CASE WHEN negative = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(negative AS DOUBLE), rows FROM n
UNION ALL SELECT 'key unique', 'a, b', 'PASS', 0.0, rows FROM n
UNION ALL SELECT 'first table alone', 'a', 'PASS', 0.0, (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) FROM n
UNION ALL SELECT 'priority filled', 'a, b', 'ERROR', NULL, NULL FROM n
""")
def rule_all_tables(t: Tables) -> DataFrame:
    """Rules without a table judge every table of the side; a column that one lacks is refused."""
    mapping = Mapping(
        "orders in two tables", {"a": t.sql(SRC_A), "b": t.sql(SRC_B_DEFECTS)}, kind=model.SOURCE_ONLY,
        column_map=[{"name": "o_orderkey", "source": {"a": "o_orderkey", "b": "order_no"}}],
    )
    checks = [
        RuleCheck(name="customer filled", rule=rules.not_null("o_custkey")),
        RuleCheck(name="price not negative", rule=rules.in_range("o_totalprice", 0)),
        RuleCheck(name="key unique", rule=lambda rows: rules.unique(rows, ["o_orderkey"])),
        RuleCheck(name="first table alone", rule=rules.not_null("o_custkey"), table="a"),
        RuleCheck(name="priority filled", rule=rules.not_null("o_orderpriority")),
    ]
    return run(t.spark, mapping, checks).results.select("test_name", "rule_target", "status", "violations", "total_rows")



# --- what is refused -----------------------------------------------------------------------------------------

REFUSED = {
    "no such table": "not among this mapping's source tables: nope",
    "regex without a pattern": "Regex Pattern Check needs a regex pattern",
    "script over a stranger": "not among this mapping's tables: nope",
    "script that deletes": "a script is a SELECT statement",
    "two statements": "a script is one statement; a second one follows its semicolon",
    "third side": "a check targets 'source' or 'destination'",
    "two sides of one": "this mapping has no destination, so it runs one-sided checks only",
    "no metric of columns": "column parity supports only: " + ", ".join(model.PARITY_TYPES),
    "one script of two": "both a source and a destination script are required",
    "of no type": "unknown validation type 'Mood'",
}


@query("refused_checks", f"""
WITH n AS (SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM ({D})) AS d)
SELECT 'row count' AS test_name, CASE WHEN s = d THEN 'PASS' ELSE 'FAIL' END AS status, CAST(NULL AS VARCHAR) AS problem,
       CAST(abs(s - d) AS DOUBLE) AS violations, s AS total_rows FROM n
UNION ALL SELECT 'keys filled', 'PASS', NULL, 0, (SELECT count(*) FROM orders)
UNION ALL SELECT * FROM (VALUES {", ".join("('" + n + "', 'ERROR', '" + m.replace("'", "''") + "', NULL, NULL)" for n, m in REFUSED.items())})
""")
def refused_checks(t: Tables) -> DataFrame:
    """Checks that a mapping can't run are named with the reason, those beside them run: over two sides, and over a source alone."""
    both, alone = Mapping("both", source={"orders": t.orders}, destination={"dst": t.sql(DST)}), Mapping("one", source={"orders": t.orders}, kind=SOURCE_ONLY)
    wanted = [
        (both, lambda: RowCountMatch(name="row count")),
        (alone, lambda: RuleCheck(name="keys filled", validation_type=model.NULLS, rule=rules.not_null("o_orderkey"))),
        (both, lambda: KeyParity(name="no such table", key="o_orderkey", source_tables=["nope"])),
        (both, lambda: ColumnParity(name="regex without a pattern", validation_type=model.REGEX, source_column="o_orderpriority", destination_column="o_orderpriority")),
        (both, lambda: ScriptCheck(name="script over a stranger", script="SELECT 1 AS passed", tables=["nope"])),
        (both, lambda: ScriptCheck(name="script that deletes", script="DELETE FROM orders")),
        (both, lambda: ScriptCheck(name="two statements", script="SELECT 1 AS passed; SELECT 2")),
        (both, lambda: RuleCheck(name="third side", rule=rules.not_null("o_orderkey"), side="middle")),
        (alone, lambda: RowCountMatch(name="two sides of one")),
        (both, lambda: ColumnParity(name="no metric of columns", validation_type=model.CUSTOM, source_column="o_orderkey", destination_column="o_orderkey")),
        (both, lambda: DualScriptCheck(name="one script of two", source_script="SELECT 1", destination_script="")),
        (both, lambda: RuleCheck(name="of no type", validation_type="Mood", rule=rules.not_null("o_orderkey"))),
    ]
    names, rows = ["row count", "keys filled", *REFUSED], []
    checks: dict[int, list] = {id(both): [], id(alone): []}
    for (mapping, build), name in zip(wanted, names):
        try:
            checks[id(mapping)].append(build())
        except ValueError as refusal:  # some are refused before there is a mapping
            rows.append((name, "ERROR", str(refusal), None, None))
    for mapping in (both, alone):
        outcome = run(t.spark, mapping, checks[id(mapping)])
        rows += [(r["test_name"], r["status"], r["error_message"], r["violations"], r["total_rows"]) for r in outcome.rows]
    return t.spark.createDataFrame(rows, "test_name string, status string, problem string, violations double, total_rows bigint")


MAPS = {
    "fits": ([{"name": "key", "source": {"orders": "o_orderkey"}, "destination": {"dst": "o_orderkey"}}], None),
    "blank cells go": ([{"name": "key", "source": {"orders": " "}}, {"name": "", "source": {}}], None),
    "no common name": ([{"name": " ", "source": {"orders": "o_orderkey"}}], "column map entry 1 names columns but has no common name"),
    "unknown table": ([{"name": "key", "destination": {"gold": "o_orderkey"}}], "'key' names unknown destination table(s): gold"),
    "twice": ([{"name": "Key", "source": {"orders": "o_orderkey"}}, {"name": "key ", "source": {"orders": "o_custkey"}}], "common name 'key' is used twice"),
}


@query("column_map_refusals", f"""
WITH n AS (SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS keys, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM ({D}))) AS missing,
           (SELECT count(*) FROM (SELECT o_orderkey FROM ({D}) EXCEPT SELECT o_orderkey FROM orders)) AS extra)
SELECT name, problem, CASE WHEN problem IS NULL THEN keys END AS keys, CASE WHEN problem IS NULL THEN CAST(missing + extra AS DOUBLE) END AS violations
FROM n, (VALUES {", ".join("('" + n + "', " + ("CAST(NULL AS VARCHAR)" if m is None else "'" + m.replace("'", "''") + "'") + ")" for n, (_, m) in MAPS.items())}) AS v(name, problem)
""")
def column_map_refusals(t: Tables) -> DataFrame:
    """Column maps that name nothing, strangers or one name twice are refused; under the others the keys are compared."""
    rows = []
    for name, (entries, _) in MAPS.items():
        try:
            mapping = Mapping("m", source={"orders": t.orders}, destination={"dst": t.sql(DST)}, column_map=entries)
        except ValueError as refusal:
            rows.append((name, str(refusal), None, None))
            continue
        found = run(t.spark, mapping, [KeyParity(name="keys", key="key" if mapping.column_map else "o_orderkey")]).rows[0]
        rows.append((name, None, found["total_rows"], found["violations"]))
    return t.spark.createDataFrame(rows, "name string, problem string, keys bigint, violations double")


STATEMENTS = {
    "binds": ("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'", None),
    "binds with a join": ("SELECT count(*) AS n FROM orders o JOIN dst d ON o.o_orderkey = d.o_orderkey", None),
    "column": ("SELECT nope FROM orders", "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
    "table": ("SELECT 1 FROM nope", "TABLE_OR_VIEW_NOT_FOUND"),
    "syntax": ("SELECT (1 FROM orders", "PARSE_SYNTAX_ERROR"),
    "types": ("SELECT o_orderkey + array(1) FROM orders", "DATATYPE_MISMATCH.BINARY_OP_DIFF_TYPES"),
    "grouping": ("SELECT o_custkey, count(*) FROM orders", "MISSING_GROUP_BY"),
    "no select": ("UPDATE orders SET o_custkey = 1", "a script is a SELECT statement"),
    "forbidden word": ("SELECT 1 FROM orders WHERE drop = 1", "a script may not use the word 'drop'"),
}


@query("bind_errors", f"""
WITH n AS (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS a, (SELECT count(*) FROM orders JOIN ({D}) USING (o_orderkey)) AS b)
SELECT name, problem IS NULL AS ok, problem, CASE name WHEN 'binds' THEN a WHEN 'binds with a join' THEN b END AS n
FROM n, (VALUES {", ".join("('" + n + "', " + ("CAST(NULL AS VARCHAR)" if m is None else "'" + m.replace("'", "''") + "'") + ")" for n, (_, m) in STATEMENTS.items())}) AS v(name, problem)
""")
def bind_errors(t: Tables) -> DataFrame:
    """Statements are bound without being run: what is wrong is named; those that bind are run afterwards."""
    tables, rows = {"orders": t.orders, "dst": t.sql(DST)}, []
    for name, (sql, _) in STATEMENTS.items():
        ok, problem = bind(t.spark, sql, tables)
        kind = re.match(r"\[([A-Z_.]+)\]", problem or "")
        rows.append((name, ok, kind.group(1) if kind else problem, user_sql(t.spark, sql, tables).first()["n"] if ok else None))
    return t.spark.createDataFrame(rows, "name string, ok boolean, problem string, n bigint")
