"""Two-sided checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import model as m
from tallymark.functions.text import normalise_columns
from tallymark.model import ColumnParity, DualScriptCheck, KeyParity, Mapping, RowCountMatch, RuleCheck, ScriptCheck
from tallymark.operators import parity
from tallymark.operators.metrics import Wanted, distinct_sketches, measure_distinct, merged_distinct, metric_table
from tallymark.operators.rules import expression, in_range, not_null, referential, unique
from tallymark.operators.history import append_history, read_history, roll_up
from tallymark.operators.scripts import dual_frames, dual_value
from tallymark.operators.sides import stack, tagged_union
from tallymark.operators.verdicts import together
from tallymark.plans.runner import plan_all, run
from tallymark.session import scratch_dir
from workload.inputs import DOCUMENTS_COPY, DST, LINEITEM_COPY, SRC_A, SRC_B
from workload.registry import Tables, duck, query

VERDICT = ("status", "violations", "total_rows")
KEY_MAP = [{"name": "order_id", "source": {"src_a": "o_orderkey", "src_b": "order_no"}, "destination": {"dst": "o_orderkey"}}]

D, A, B = duck(DST), duck(SRC_A), duck(SRC_B)
SOURCES_SQL = "SELECT 'source' AS side, {table} AS src_table, {expr} AS val FROM ({arm})"


def verdict_of(df: DataFrame) -> DataFrame:
    return df.select(*VERDICT)


def orders_pair(t: Tables) -> Mapping:
    return Mapping("orders", {"orders": t.orders}, {"dst": t.sql(DST)})


def split_pair(t: Tables) -> Mapping:
    return Mapping("split orders", {"src_a": t.sql(SRC_A), "src_b": t.sql(SRC_B)}, {"dst": t.sql(DST)}, KEY_MAP)


def metric_sql(column: str, *aggregates: str) -> str:
    """The metric per table and side, with a row for all tables of the side."""
    return f"""
    WITH both_sides AS (
      SELECT 'source' AS side, 'src_a' AS src_table, {column} AS val FROM ({A})
      UNION ALL SELECT 'source', 'src_b', {column} FROM ({B})
      UNION ALL SELECT 'destination', 'dst', {column} FROM ({D})
    )
    SELECT side, coalesce(src_table, '__all__') AS src_table, {', '.join(aggregates)}
    FROM both_sides GROUP BY GROUPING SETS ((side, src_table), (side))
    """


def both_metrics(t: Tables, metric: str, column: str, pattern: str | None = None) -> DataFrame:
    pair = split_pair(t)
    sides = []
    for side, frames in (("source", pair.source), ("destination", pair.destination)):
        wanted = Wanted(metric, {name: column for name in frames}, pattern)
        sides.append(metric_table(frames, wanted).select(F.lit(side).alias("side"), "*"))
    return sides[0].unionByName(sides[1])


@query("row_count_match", f"""
WITH s AS (SELECT count(*) AS n FROM orders), d AS (SELECT count(*) AS n FROM ({D}))
SELECT CASE WHEN s.n = d.n THEN 'PASS' ELSE 'FAIL' END AS status, CAST(abs(s.n - d.n) AS DOUBLE) AS violations,
       s.n AS total_rows FROM s, d
""")
def row_count_match(t: Tables) -> DataFrame:
    pair = split_pair(t)
    return verdict_of(parity.row_count_match(pair.source, pair.destination))


@query("parity_null", metric_sql("o_custkey", "CAST(sum(CASE WHEN val IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS metric"))
def parity_null(t: Tables) -> DataFrame:
    return both_metrics(t, m.NULLS, "o_custkey")


@query("parity_unique", metric_sql("o_custkey", "count(DISTINCT val) AS metric"))
def parity_unique(t: Tables) -> DataFrame:
    return both_metrics(t, m.UNIQUENESS, "o_custkey")


@query("parity_range", metric_sql("o_orderpriority", "min(val) AS low", "max(val) AS high"))
def parity_range(t: Tables) -> DataFrame:
    return both_metrics(t, m.RANGE, "o_orderpriority")


@query("parity_volume", metric_sql("o_custkey", "count(*) AS metric", "count(val) AS non_null"))
def parity_volume(t: Tables) -> DataFrame:
    return both_metrics(t, m.VOLUME, "o_custkey")


@query("parity_length", metric_sql("o_orderpriority", "min(length(val)) AS low", "max(length(val)) AS high"))
def parity_length(t: Tables) -> DataFrame:
    return both_metrics(t, m.LENGTH, "o_orderpriority")


@query("parity_regex", metric_sql(
    "o_orderpriority", "CAST(sum(CASE WHEN regexp_matches(val, '^[0-9]-[A-Z]{3}') THEN 1 ELSE 0 END) AS BIGINT) AS metric"
))
def parity_regex(t: Tables) -> DataFrame:
    return both_metrics(t, m.REGEX, "o_orderpriority", "^[0-9]-[A-Z]{3}")


@query("parity_freshness", metric_sql("o_orderdate", "CAST(max(val) AS VARCHAR) AS metric"))
def parity_freshness(t: Tables) -> DataFrame:
    return both_metrics(t, m.FRESHNESS, "o_orderdate")


COLUMN_CHECKS = [
    ColumnParity(name="nulls", validation_type=m.NULLS, source_column="o_custkey", destination_column="o_custkey"),
    ColumnParity(name="distinct", validation_type=m.UNIQUENESS, source_column="o_orderstatus",
                 destination_column="o_orderstatus"),
    ColumnParity(name="range", validation_type=m.RANGE, source_column="o_orderdate", destination_column="o_orderdate"),
    ColumnParity(name="volume", validation_type=m.VOLUME, source_column="o_custkey", destination_column="o_custkey"),
    ColumnParity(name="length", validation_type=m.LENGTH, source_column="o_orderpriority",
                 destination_column="o_orderpriority"),
    ColumnParity(name="regex", validation_type=m.REGEX, source_column="o_orderpriority",
                 destination_column="o_orderpriority", pattern="^[0-9]-[A-Z]{3}"),
    ColumnParity(name="freshness", validation_type=m.FRESHNESS, source_column="o_orderdate",
                 destination_column="o_orderdate"),
    ColumnParity(name="categories", validation_type=m.CATEGORICAL, source_column="o_orderstatus",
                 destination_column="o_orderstatus"),
]

COLUMN_FIGURES = """
  SELECT count(*) AS n, count(o_custkey) AS filled, count(DISTINCT o_orderstatus) AS states,
         min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, min(length(o_orderpriority)) AS short,
         max(length(o_orderpriority)) AS long,
         sum(CASE WHEN regexp_matches(o_orderpriority, '^[0-9]-[A-Z]{3}') THEN 1 ELSE 0 END) AS matching
"""
COLUMN_VERDICTS = f"""
WITH s AS ({COLUMN_FIGURES} FROM orders), d AS ({COLUMN_FIGURES} FROM ({D})),
c AS (SELECT count(*) AS n FROM (
  (SELECT DISTINCT o_orderstatus FROM orders EXCEPT SELECT DISTINCT o_orderstatus FROM ({D}))
  UNION ALL (SELECT DISTINCT o_orderstatus FROM ({D}) EXCEPT SELECT DISTINCT o_orderstatus FROM orders))),
v AS (
  SELECT 'nulls' AS test_name, abs((s.n - s.filled) - (d.n - d.filled)) AS violations, d.n AS total_rows FROM s, d
  UNION ALL SELECT 'distinct', abs(s.states - d.states), d.n FROM s, d
  UNION ALL SELECT 'range', CASE WHEN s.first_day = d.first_day AND s.last_day = d.last_day THEN 0 ELSE 1 END, d.n FROM s, d
  UNION ALL SELECT 'volume', abs(s.n - d.n) + abs(s.filled - d.filled), d.n FROM s, d
  UNION ALL SELECT 'length', CASE WHEN s.short = d.short AND s.long = d.long THEN 0 ELSE 1 END, d.n FROM s, d
  UNION ALL SELECT 'regex', abs(s.matching - d.matching), d.n FROM s, d
  UNION ALL SELECT 'freshness', CASE WHEN s.last_day = d.last_day THEN 0 ELSE 1 END, d.n FROM s, d
  UNION ALL SELECT 'categories', c.n, d.n FROM c, d)
SELECT test_name, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
       CAST(violations AS DOUBLE) AS violations, CAST(total_rows AS BIGINT) AS total_rows FROM v
"""


@query("column_parity_verdicts", COLUMN_VERDICTS)
def column_parity_verdicts(t: Tables) -> DataFrame:
    return plan_all(t.spark, orders_pair(t), COLUMN_CHECKS).select("test_name", *VERDICT)


@query("parity_categorical", f"""
WITH x AS (SELECT s.v AS a, d.v AS b, s.k AS ka, d.k AS kb
  FROM (SELECT DISTINCT o_orderstatus AS v, 1 AS k FROM orders) s
  FULL JOIN (SELECT DISTINCT o_orderstatus AS v, 1 AS k FROM ({D})) d ON s.v IS NOT DISTINCT FROM d.v),
g AS (SELECT count(*) AS gaps FROM x WHERE ka IS NULL OR kb IS NULL)
SELECT CASE WHEN gaps = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(gaps AS DOUBLE) AS violations,
       (SELECT count(*) FROM ({D})) AS total_rows FROM g
""")
def parity_categorical(t: Tables) -> DataFrame:
    pair = split_pair(t)
    columns = {name: "o_orderstatus" for name in ("src_a", "src_b", "dst")}
    return verdict_of(parity.categorical_parity(pair.source, pair.destination, columns, columns))


@query("category_sets", f"""
WITH u AS (
  SELECT o_orderpriority AS val, 1 AS s, 0 AS d, 1 AS a, 0 AS b FROM ({A})
  UNION ALL SELECT o_orderpriority, 1, 0, 0, 1 FROM ({B})
  UNION ALL SELECT o_orderpriority, 0, 1, 0, 0 FROM ({D}))
SELECT val, max(s) = 1 AS in_source, max(d) = 1 AS in_destination, max(a) = 1 AS in_src_a, max(b) = 1 AS in_src_b,
       CAST(sum(d) AS BIGINT) AS destination_rows FROM u GROUP BY val
""")
def category_sets(t: Tables) -> DataFrame:
    pair = split_pair(t)
    columns = {name: "o_orderpriority" for name in ("src_a", "src_b", "dst")}
    sets = parity.category_sets(pair.source, pair.destination, columns, columns)
    return sets.select(
        "val", (F.col("sides").bitwiseAND(1) > 0).alias("in_source"), (F.col("sides").bitwiseAND(2) > 0).alias("in_destination"),
        F.col("in0").alias("in_src_a"), F.col("in1").alias("in_src_b"), "destination_rows",
    )


KEY_VERDICT = f"""
WITH s AS (SELECT DISTINCT o_orderkey AS k FROM orders), d AS (SELECT DISTINCT o_orderkey AS k FROM ({D})),
n AS (SELECT (SELECT count(*) FROM (SELECT k FROM s EXCEPT SELECT k FROM d))
           + (SELECT count(*) FROM (SELECT k FROM d EXCEPT SELECT k FROM s)) AS gaps, (SELECT count(*) FROM s) AS keys)
SELECT CASE WHEN gaps = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(gaps AS DOUBLE) AS violations,
       keys AS total_rows FROM n
"""


@query("key_parity", KEY_VERDICT)
def key_parity(t: Tables) -> DataFrame:
    pair = orders_pair(t)
    return verdict_of(parity.key_parity(pair.source, pair.destination, "o_orderkey", samples=0))


@query("key_parity_mapped", KEY_VERDICT)
def key_parity_mapped(t: Tables) -> DataFrame:
    pair = split_pair(t)
    return verdict_of(parity.key_parity(pair.source, pair.destination, "order_id", pair.column_map, samples=0))


@query("key_parity_detail", f"""
SELECT k AS key, 'source' AS found_in FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT o_orderkey FROM ({D}))
UNION ALL
SELECT k, 'destination' FROM (SELECT o_orderkey AS k FROM ({D}) EXCEPT SELECT o_orderkey FROM orders)
""")
def key_parity_detail(t: Tables) -> DataFrame:
    pair = split_pair(t)
    s = {"src_a": "o_orderkey", "src_b": "order_no"}
    return parity.key_differences(pair.source, pair.destination, s, {"dst": "o_orderkey"})


@query("key_parity_dates", f"""
WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS k FROM orders),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS k FROM ({D})),
n AS (SELECT (SELECT count(*) FROM (SELECT k FROM s EXCEPT SELECT k FROM d))
           + (SELECT count(*) FROM (SELECT k FROM d EXCEPT SELECT k FROM s)) AS gaps, (SELECT count(*) FROM s) AS keys)
SELECT CASE WHEN gaps = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(gaps AS DOUBLE) AS violations,
       keys AS total_rows FROM n
""")
def key_parity_dates(t: Tables) -> DataFrame:
    """Timestamps against the same days written ``1998/10/03``: both collapse to the date."""
    texts = t.sql(DST).select(F.date_format("o_orderdate", "yyyy/MM/dd").alias("o_orderdate"))
    return verdict_of(parity.key_parity({"orders": t.orders}, {"texts": texts}, "o_orderdate", samples=0))


def multiset_verdict(source: str, destination: str, columns: str) -> str:
    return f"""
    WITH s AS (SELECT {columns} FROM {source}), d AS (SELECT {columns} FROM {destination}),
    n AS (SELECT (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM d))
               + (SELECT count(*) FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM s)) AS gaps,
                 (SELECT count(*) FROM s) AS rows)
    SELECT CASE WHEN gaps = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(gaps AS DOUBLE) AS violations,
           rows AS total_rows FROM n
    """


SHARED = "o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus"


@query("row_parity", multiset_verdict("orders", f"({D})", SHARED))
def row_parity(t: Tables) -> DataFrame:
    pair = orders_pair(t)
    return verdict_of(parity.row_parity(pair.source, pair.destination, samples=0))


@query("row_parity_mapped", multiset_verdict("orders", f"({D})", SHARED))
def row_parity_mapped(t: Tables) -> DataFrame:
    """Two source tables that name the key differently against one destination."""
    pair = split_pair(t)
    return verdict_of(parity.row_parity(pair.source, pair.destination, pair.column_map, samples=0))


@query("row_parity_detail", f"""
WITH s AS (SELECT {SHARED}, count(*) AS n FROM orders GROUP BY ALL),
d AS (SELECT {SHARED}, count(*) AS n FROM ({D}) GROUP BY ALL),
x AS (SELECT {SHARED}, sum(n) AS net FROM (SELECT * FROM s UNION ALL SELECT {SHARED}, -n FROM d) GROUP BY ALL)
SELECT {SHARED}, CASE WHEN net > 0 THEN 'source' ELSE 'destination' END AS found_in, CAST(abs(net) AS BIGINT) AS copies
FROM x WHERE net <> 0
""")
def row_parity_detail(t: Tables) -> DataFrame:
    pair = orders_pair(t)
    return parity.row_differences(pair.source, pair.destination)


@query("row_parity_lineitem", multiset_verdict("lineitem", f"({duck(LINEITEM_COPY)})", "*"))
def row_parity_lineitem(t: Tables) -> DataFrame:
    return verdict_of(parity.row_parity({"lineitem": t.lineitem}, {"copy": t.sql(LINEITEM_COPY)}, samples=0))


@query("row_parity_documents", multiset_verdict("documents", f"({duck(DOCUMENTS_COPY)})", "*"))
def row_parity_documents(t: Tables) -> DataFrame:
    """Rows with long texts, with examples: the shuffle carries a digest of the row."""
    return verdict_of(parity.row_parity({"documents": t.documents}, {"copy": t.sql(DOCUMENTS_COPY)}))


@query("row_parity_retyped", multiset_verdict("orders", f"({D})", SHARED))
def row_parity_retyped(t: Tables) -> DataFrame:
    """The destination holds everything as text, days in another layout: cells still line up."""
    texts = t.sql(DST).select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("o_orderkey"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("o_orderdate"), F.col("o_custkey").cast("string").alias("o_custkey"),
        F.concat("o_orderstatus", F.lit("  ")).alias("o_orderstatus"), "o_orderpriority",
    )
    source = t.orders.select("o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus", "o_orderpriority")
    return verdict_of(parity.row_parity({"orders": source}, {"texts": texts}, samples=0))


@query("parity_details", f"""
WITH s AS (SELECT DISTINCT o_orderkey AS k FROM orders), d AS (SELECT DISTINCT o_orderkey AS k FROM ({D})),
missing AS (SELECT k FROM s EXCEPT SELECT k FROM d), extra AS (SELECT k FROM d EXCEPT SELECT k FROM s),
sv AS (SELECT DISTINCT o_orderstatus AS v FROM orders), dv AS (SELECT DISTINCT o_orderstatus AS v FROM ({D}))
SELECT 'keys' AS test_name, concat((SELECT count(*) FROM s) - (SELECT count(*) FROM missing), ' of ', (SELECT count(*) FROM s), ' order_id keys on both sides; ',
       (SELECT count(*) FROM missing), ' only in source: ', (SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT k FROM missing ORDER BY k LIMIT 5)), '; ',
       (SELECT count(*) FROM extra), ' only in destination: ', (SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT k FROM extra ORDER BY k LIMIT 5))) AS details
UNION ALL
SELECT 'values', concat((SELECT count(*) FROM (SELECT v FROM sv INTERSECT SELECT v FROM dv)), ' of ', (SELECT count(*) FROM sv), ' values on both sides; ',
       (SELECT count(*) FROM (SELECT v FROM dv EXCEPT SELECT v FROM sv)), ' only in destination: ',
       (SELECT string_agg('''' || v || '''', ', ' ORDER BY v) FROM (SELECT v FROM dv EXCEPT SELECT v FROM sv)))
UNION ALL
SELECT 'empty customers', concat('source empty = ', (SELECT count(*) - count(o_custkey) FROM orders), ' (src_a: ', (SELECT count(*) - count(o_custkey) FROM ({A})),
       ', src_b: ', (SELECT count(*) - count(o_custkey) FROM orders WHERE o_orderkey % 2 = 1), ') | destination empty = ', (SELECT count(*) - count(o_custkey) FROM ({D})))
""")
def parity_details(t: Tables) -> DataFrame:
    """What the verdicts say: examples of keys and values, and figures per table."""
    pair = split_pair(t)
    columns = {"src_a": "o_orderstatus", "src_b": "o_orderstatus"}
    said = {
        "keys": parity.key_parity(pair.source, pair.destination, "order_id", pair.column_map),
        "values": parity.categorical_parity(pair.source, pair.destination, columns, {"dst": "o_orderstatus"}),
        "empty customers": parity.column_parity(pair.source, pair.destination, ColumnParity(
            name="nulls", validation_type=m.NULLS, source_column="o_custkey", destination_column="o_custkey")),
    }
    return stack([df.select(F.lit(name).alias("test_name"), "details") for name, df in said.items()])


@query("row_parity_ragged", """
WITH s AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0
           UNION ALL SELECT o_orderkey, o_orderstatus, '' FROM orders WHERE o_orderkey % 2 = 1),
d AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders),
n AS (SELECT (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM d)) + (SELECT count(*) FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM s)) AS gaps,
             (SELECT count(*) FROM s) AS rows)
SELECT CASE WHEN gaps = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(gaps AS DOUBLE) AS violations, rows AS total_rows FROM n
""")
def row_parity_ragged(t: Tables) -> DataFrame:
    """One source table lacks a shared column: its cells there count as empty."""
    even = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    odd = t.orders.where("o_orderkey % 2 = 1").select("o_orderkey", "o_orderstatus")
    whole = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return verdict_of(parity.row_parity({"even": even, "odd": odd}, {"whole": whole}))


@query("tagged_union", f"""
SELECT src_table, val, count(*) AS n FROM (
  SELECT 'src_a' AS src_table, CAST(o_orderkey AS VARCHAR) AS val FROM ({A})
  UNION ALL SELECT 'priorities', o_orderpriority FROM orders) GROUP BY src_table, val
""")
def tagged_union_rows(t: Tables) -> DataFrame:
    """Two tables whose columns are a number and a text: the union is text."""
    union = tagged_union(
        {"src_a": t.sql(SRC_A), "priorities": t.orders}, {"src_a": "o_orderkey", "priorities": "o_orderpriority"}
    )
    return union.groupBy("src_table", "val").agg(F.count(F.lit(1)).alias("n"))


@query("dual_value", f"""
WITH s AS (SELECT count(DISTINCT o_custkey) AS v FROM orders),
d AS (SELECT count(DISTINCT o_custkey) AS v FROM ({D}))
SELECT CASE WHEN s.v = d.v THEN 'PASS' ELSE 'FAIL' END AS status, CAST(abs(s.v - d.v) AS DOUBLE) AS violations,
       CAST(s.v AS VARCHAR) AS source_value, CAST(d.v AS VARCHAR) AS destination_value FROM s, d
""")
def dual_value_check(t: Tables) -> DataFrame:
    pair = orders_pair(t)
    sides = dual_frames(
        t.spark, 'SELECT count(DISTINCT "o_custkey") FROM orders', pair.source,
        "SELECT count(DISTINCT o_custkey) AS value FROM dst", pair.destination,
    )
    figure = F.regexp_extract_all("details", F.lit(r"(?:source|destination) has (\d+)"), F.lit(1))
    return dual_value(*sides).select(
        "status", "violations", F.get(figure, F.lit(0)).alias("source_value"), F.get(figure, F.lit(1)).alias("destination_value")
    )


@query("dual_callables", f"""
WITH s AS (SELECT count(*) AS v FROM orders WHERE o_orderstatus = 'P'),
d AS (SELECT count(*) AS v FROM ({D}) WHERE o_orderstatus = 'P')
SELECT CASE WHEN s.v = d.v THEN 'PASS' ELSE 'FAIL' END AS status, CAST(abs(s.v - d.v) AS DOUBLE) AS violations FROM s, d
""")
def dual_callables(t: Tables) -> DataFrame:
    pair = orders_pair(t)

    def counted(name: str):
        return lambda spark, read_table: {"value": read_table(name).filter("o_orderstatus = 'P'").count()}

    sides = dual_frames(t.spark, counted("orders"), pair.source, counted("dst"), pair.destination)
    return dual_value(*sides).select("status", "violations")


# --- text rules over the data ----------------------------------------------------------------

LAYOUTS = (
    ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/MM/dd", "%Y/%m/%d"), ("dd-MM-yyyy", "%d-%m-%Y"), ("dd/MM/yyyy", "%d/%m/%Y"),
    ("MM-dd-yyyy", "%m-%d-%Y"), ("MM/dd/yyyy", "%m/%d/%Y"), ("yy-MM-dd", "%y-%m-%d"), ("dd-MM-yy", "%d-%m-%y"),
    ("dd/MM/yy", "%d/%m/%y"),
)
WRITTEN = "CASE o_orderkey % 9 " + " ".join(
    f"WHEN {i} THEN strftime(o_orderdate, '{layout}')" for i, (_, layout) in enumerate(LAYOUTS)
) + " END"


@query("normalise_dates", f"""
WITH w AS (SELECT o_orderkey, {WRITTEN} AS written FROM orders),
p AS (SELECT *, regexp_split_to_array(written, '[-/]') AS x, written LIKE '%/%' AS slashed FROM w),
q AS (SELECT *, x[1] AS a, x[2] AS b, x[3] AS c FROM p),
r AS (SELECT *, CASE WHEN CAST(a AS INT) >= 69 THEN 1900 ELSE 2000 END + CAST(a AS INT) AS ya,
                CASE WHEN CAST(c AS INT) >= 69 THEN 1900 ELSE 2000 END + CAST(c AS INT) AS yc FROM q)
SELECT o_orderkey, written, coalesce(CAST(CASE
         WHEN length(a) = 4 THEN try_cast(a || '-' || b || '-' || c AS DATE)
         WHEN length(c) = 4 THEN coalesce(try_cast(c || '-' || b || '-' || a AS DATE), try_cast(c || '-' || a || '-' || b AS DATE))
         WHEN NOT slashed THEN coalesce(try_cast(CAST(ya AS VARCHAR) || '-' || b || '-' || c AS DATE),
                                        try_cast(CAST(yc AS VARCHAR) || '-' || b || '-' || a AS DATE))
         ELSE try_cast(CAST(yc AS VARCHAR) || '-' || b || '-' || a AS DATE) END AS VARCHAR), written) AS cell
FROM r
""")
def normalise_dates(t: Tables) -> DataFrame:
    written = F.coalesce(*(
        F.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", layout)) for i, (layout, _) in enumerate(LAYOUTS)
    ))
    texts = t.orders.select("o_orderkey", written.alias("written")).withColumn("cell", F.col("written"))
    return normalise_columns(texts, ["cell"])


# --- a whole run -------------------------------------------------------------------------------

def suite(t: Tables) -> tuple[Mapping, list]:
    parent = t.orders.filter("o_orderkey % 101 <> 0")
    return orders_pair(t), [
        RowCountMatch(name="row count"),
        *COLUMN_CHECKS,
        KeyParity(name="keys", key="o_orderkey"),
        KeyParity(name="whole rows"),
        RuleCheck(name="customer filled", validation_type=m.NULLS, side="destination", rule=not_null("o_custkey")),
        RuleCheck(name="customer range", validation_type=m.RANGE, side="destination", rule=in_range("o_custkey", 0, 500)),
        RuleCheck(name="key unique", validation_type=m.UNIQUENESS, side="destination",
                  rule=lambda df: unique(df, ["o_orderkey"])),
        RuleCheck(name="order known", validation_type=m.REFERENTIAL,
                  rule=lambda df: referential(df, "o_orderkey", parent, "o_orderkey")),
        RuleCheck(name="status known", rule=expression("o_orderstatus in ('F', 'O')")),
        ScriptCheck(name="asserted", script="SELECT count(*) = 0 AS passed, count(*) AS violations FROM orders WHERE o_totalprice < 2000"),
        DualScriptCheck(name="dual", source_script="SELECT max(o_custkey) FROM orders",
                        destination_script="SELECT max(o_custkey) FROM dst"),
        ColumnParity(name="no such column", validation_type=m.NULLS, source_column="nope", destination_column="nope"),
    ]


RUN_SQL = f"""
WITH rc AS ({KEY_VERDICT}), rows_v AS ({multiset_verdict("orders", f"({D})", SHARED)}), cols AS ({COLUMN_VERDICTS}),
dst AS ({D}),
v AS (
  SELECT 'row count' AS test_name, CAST(abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM dst)) AS DOUBLE) AS violations
  UNION ALL SELECT test_name, violations FROM cols
  UNION ALL SELECT 'keys', violations FROM rc
  UNION ALL SELECT 'whole rows', violations FROM rows_v
  UNION ALL SELECT 'customer filled', count(*) FROM dst WHERE o_custkey IS NULL
  UNION ALL SELECT 'customer range', count(*) FROM dst WHERE o_custkey < 0 OR o_custkey > 500
  UNION ALL SELECT 'key unique', count(*) FROM (SELECT o_orderkey FROM dst GROUP BY o_orderkey HAVING count(*) > 1)
  UNION ALL SELECT 'order known', count(*) FROM orders WHERE o_orderkey % 101 = 0
  UNION ALL SELECT 'status known', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT 'asserted', count(*) FROM orders WHERE o_totalprice < 2000
  UNION ALL SELECT 'dual', abs((SELECT max(o_custkey) FROM orders) - (SELECT max(o_custkey) FROM dst)))
SELECT test_name, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(violations AS DOUBLE) AS violations FROM v
UNION ALL SELECT 'no such column', 'ERROR', NULL
"""


@query("check_run_results", RUN_SQL)
def check_run_results(t: Tables) -> DataFrame:
    return run(t.spark, *suite(t)).results.select("test_name", "status", "violations")


@query("run_rollup", f"""
WITH r AS ({RUN_SQL})
SELECT count(*) AS total_checkpoints, count(*) FILTER (status = 'PASS') AS pass_count,
       count(*) FILTER (status <> 'PASS') AS fail_count,
       CASE WHEN count(*) = count(*) FILTER (status = 'PASS') THEN 'passed' ELSE 'failed' END AS status FROM r
""")
def run_rollup(t: Tables) -> DataFrame:
    return roll_up(run(t.spark, *suite(t)).results).drop("run_id")


@query("history_round_trip", """
SELECT 'row count' AS test_name, 'TC-001' AS test_label, 'critical' AS severity, 'manual' AS origin, 'as many rows' AS description,
       'PASS' AS status, 'passed' AS run_status, DATE '2024-05-06' AS run_date
UNION ALL SELECT 'keys', 'TC-002', 'error', 'proposed', '', 'PASS', 'passed', DATE '2024-05-06'
""")
def history_round_trip(t: Tables) -> DataFrame:
    """A suite with an inactive check, stored twice under one run id next to an older run, read back from its day on."""
    folder = scratch_dir(t.spark, "history")
    mapping = Mapping("orders", {"orders": t.orders}, {"copy": t.orders})
    checks = [
        RowCountMatch(name="row count", severity="critical", description="as many rows"),
        KeyParity(name="keys", key="o_orderkey", origin="proposed"),
        RuleCheck(name="asleep", rule=not_null("o_orderkey"), active=False),
    ]
    outcome = run(t.spark, mapping, checks, suite_id="s1", run_id="r1")
    at = lambda text: outcome.runs.withColumn("started_at", F.lit(text).cast("timestamp"))
    old = outcome.results.withColumn("run_id", F.lit("r0")), at("2024-01-02 03:04:05").withColumn("id", F.lit("r0"))
    append_history(old[1], old[0], folder)
    for _ in range(2):
        append_history(at("2024-05-06 07:08:09"), outcome.results, folder)
    runs, results = read_history(t.spark, folder)
    days = [df.filter(F.col("run_date") >= F.lit("2024-03-01").cast("date")) for df in (runs, results)]
    states = days[0].select(F.col("id").alias("run_id"), F.col("status").alias("run_status"))
    return days[1].join(states, "run_id").select(
        "test_name", "test_label", "severity", "origin", "description", "status", "run_status", "run_date")


UNIQUE_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@query("distinct_estimates", " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) AS rows, count(DISTINCT {n}) AS exact, true AS within, true AS runs_agree FROM ({D})" for n in UNIQUE_COLUMNS))
def distinct_estimates(t: Tables) -> DataFrame:
    """Sketches of single tables, stored and merged, against exact counts: within their stated bounds; two stored runs give what one gives."""
    dst, found = t.sql(DST), []
    halves = {"even": dst.where("o_orderkey % 2 = 0"), "odd": dst.where("o_orderkey % 2 = 1")}
    for name in UNIQUE_COLUMNS:
        columns = {table: name for table in halves}
        path = scratch_dir(t.spark, "sketches")
        for run_id in ("first", "second"):
            distinct_sketches(halves, columns).withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
        stored = t.spark.read.parquet(path)
        one, both = merged_distinct(stored.where("run_id = 'first'")), merged_distinct(stored)
        exact = measure_distinct(halves, columns).select("m0.total.*")
        pair = together(one=one, both=both, exact=exact)
        found.append(pair.select(
            F.lit(name).alias("column_name"), F.col("exact.rows").alias("rows"), F.col("exact.metric").alias("exact"),
            F.col("exact.metric").between(F.col("one.low"), F.col("one.high")).alias("within"),
            (F.col("one.estimate") == F.col("both.estimate")).alias("runs_agree")))
    return stack(found)


@query("parity_unique_estimated", f"""
SELECT 'PASS' AS status, CAST(0 AS DOUBLE) AS violations, (SELECT count(*) FROM ({D})) AS total_rows, 'status' AS measured
UNION ALL SELECT 'FAIL', NULL, (SELECT count(*) FROM ({D})), 'keys of a half'
""")
def parity_unique_estimated(t: Tables) -> DataFrame:
    """The same number of values passes by estimate, half of them fails; by how much is an estimate and left out here."""
    check = ColumnParity(name="u", validation_type=m.UNIQUENESS, source_column="o_custkey", destination_column="o_custkey", approximate=True)
    keys = ColumnParity(name="k", validation_type=m.UNIQUENESS, source_column="o_orderkey", destination_column="o_orderkey", approximate=True)
    same = parity.column_parity({"orders": t.sql(DST)}, {"dst": t.sql(DST)}, check)
    half = parity.column_parity({"orders": t.orders.where("o_orderkey % 2 = 0")}, {"dst": t.sql(DST)}, keys)
    names = ("status", "violations", "total_rows")
    return stack([same.select(*names, F.lit("status").alias("measured")),
                  half.select("status", F.lit(None).cast("double").alias("violations"), "total_rows", F.lit("keys of a half").alias("measured"))])
