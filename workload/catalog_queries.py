"""Table lists, harvested assets, schema changes, rule proposals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.model import SOURCE_ONLY, ColumnParity, Mapping
from tallymark.operators import catalog as k
from tallymark.operators import proposals as p
from tallymark.operators.sides import stack
from tallymark.operators.verdicts import together
from tallymark.plans.runner import run
from workload.inputs import ASSETS, DST, HARVESTED
from workload.registry import TABLES, Tables, duck, query

A, H = duck(ASSETS), duck(HARVESTED)
COUNTS = " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in TABLES)


def every_table(t: Tables) -> dict[str, DataFrame]:
    return {name: getattr(t, name) for name in TABLES}


@query("table_counts", COUNTS)
def table_counts(t: Tables) -> DataFrame:
    return k.table_counts(every_table(t))


@query("table_totals", f"""
WITH c AS ({COUNTS} UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'broken', NULL)
SELECT count(*) AS tables, CAST(sum(row_count) AS BIGINT) AS total_rows, count(*) FILTER (row_count = 0) AS empty_tables,
       count(*) FILTER (row_count IS NULL) AS unreadable FROM c
""")
def table_totals(t: Tables) -> DataFrame:
    def load(name: str):
        return lambda: getattr(t, name)

    sources = {name: load(name) for name in TABLES}
    sources["empty"] = lambda: t.orders.filter("o_orderkey < -1")
    sources["broken"] = lambda: t.spark.read.parquet(f"{t.folder}/no_such_table.parquet")
    return k.table_totals(k.guarded_table_counts(t.spark, sources))


@query("snapshot_diff", """
WITH b AS (SELECT concat('user ', CAST(user_id AS VARCHAR)) AS table_name, count(*) AS n FROM events WHERE user_id % 11 <> 0 GROUP BY 1),
a AS (SELECT concat('user ', CAST(user_id AS VARCHAR)) AS table_name, count(*) AS n FROM events
      WHERE user_id % 13 <> 0 AND (user_id % 3 = 0 OR event_id % 4 <> 0) GROUP BY 1)
SELECT coalesce(b.table_name, a.table_name) AS table_name, b.n AS before, a.n AS after,
       coalesce(a.n, 0) - coalesce(b.n, 0) AS delta, b.n IS NULL AS added, a.n IS NULL AS removed
FROM b FULL JOIN a ON a.table_name = b.table_name WHERE a.n IS DISTINCT FROM b.n
""")
def snapshot_diff(t: Tables) -> DataFrame:
    """The events of each user as a table, before and after a load that lost and gained some."""

    def snapshot(df: DataFrame) -> DataFrame:
        name = F.concat(F.lit("user "), F.col("user_id").cast("string"))
        return df.groupBy(name.alias("table_name")).agg(F.count(F.lit(1)).alias("row_count"))

    before = t.events.filter("user_id % 11 <> 0")
    after = t.events.filter("user_id % 13 <> 0 and (user_id % 3 = 0 or event_id % 4 <> 0)")
    return k.snapshot_diff(snapshot(before), snapshot(after))


# Prefixes of containers the platform creates for itself.
INTERNAL_PREFIXES = (
    "staginglakehousefordataflows",
    "dataflowsstaginglakehouse",
    "dataflowsstagingwarehouse",
)
HARVESTED_TABLES = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"), "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"), "benchmark": ("item_id", "text"), "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


def harvested(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Assets and job record of a harvest of all tables and of one item that cannot be read."""
    items = [{"id": name, "name": name, "type": "Table"} for name in (*HARVESTED_TABLES, "absent")]
    return k.harvest(
        t.spark, items, lambda item: {item["name"]: getattr(t, item["name"])}, "c1", "lake", "lake", datetime(2026, 1, 1)
    )


@query("harvest_columns", " UNION ALL ".join(
    f"SELECT 'lake:{table}' AS asset_id, '{table}' AS table_name, '{name}' AS column_name, CAST({i} AS INT) AS position, "
    f"count(*) AS rows, count(*) - count({name}) AS nulls FROM {table}"
    for table, names in HARVESTED_TABLES.items() for i, name in enumerate(names)
))
def harvest_columns(t: Tables) -> DataFrame:
    """The harvested columns of every table with the rows and nulls found in them."""
    assets, _ = harvested(t)
    figures = []
    for name, columns in HARVESTED_TABLES.items():
        counted = getattr(t, name).agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(n).isNull()).alias(n) for n in columns))
        entries = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col("rows"), F.col(n).alias("nulls")) for n in columns))
        figures.append(counted.select(F.lit(name).alias("table_name"), F.explode(entries).alias("e")).select("table_name", "e.*"))
    return k.asset_columns(assets).select("asset_id", "table_name", "column_name", "position").join(
        stack(figures), ["table_name", "column_name"]
    )


@query("harvest_job", f"""
SELECT 'lake' AS connector_type, 'incremental' AS mode, CAST({len(HARVESTED_TABLES)} AS INT) AS asset_count, 'success' AS status, true AS says_why,
       {" + ".join(f"(SELECT count(*) FROM {name})" for name in HARVESTED_TABLES)} AS rows
""")
def harvest_job(t: Tables) -> DataFrame:
    """The record of a harvest in which one item failed, with the rows of what was found."""
    assets, job = harvested(t)
    rows = k.table_counts({name: getattr(t, name) for name in HARVESTED_TABLES}).agg(F.sum("row_count").alias("rows"))
    said = job.select("connector_type", "mode", F.col("asset_count").cast("int").alias("asset_count"), "status", F.col("error_message").isNotNull().alias("says_why"))
    return said.withColumn("rows", F.lit(rows.first().rows))


DRIFT_BEFORE = """
SELECT p_brand AS table_name, concat('c', CAST(p_partkey AS VARCHAR(20))) AS column_name, p_type AS data_type
FROM {part} WHERE p_partkey % 5 <> 0
"""
DRIFT_AFTER = """
SELECT p_brand AS table_name, concat('c', CAST(p_partkey AS VARCHAR(20))) AS column_name,
       CASE WHEN p_partkey % 7 = 0 THEN 'RETYPED' ELSE p_type END AS data_type
FROM {part} WHERE p_partkey % 3 <> 0
"""


@query("schema_drift", f"""
WITH b AS ({duck(DRIFT_BEFORE)}), a AS ({duck(DRIFT_AFTER)})
SELECT coalesce(b.table_name, a.table_name) AS table_name, coalesce(b.column_name, a.column_name) AS column_name,
       b.data_type AS before, a.data_type AS after,
       CASE WHEN b.column_name IS NULL THEN 'added' WHEN a.column_name IS NULL THEN 'removed' ELSE 'retyped' END AS change
FROM b FULL JOIN a ON a.table_name = b.table_name AND a.column_name = b.column_name
WHERE a.data_type IS DISTINCT FROM b.data_type
""")
def schema_drift(t: Tables) -> DataFrame:
    """Parts as the columns of their brand, recorded twice."""
    return k.schema_drift(t.sql(DRIFT_BEFORE), t.sql(DRIFT_AFTER))


@query("gone_columns", f"""
SELECT b.* FROM ({duck(DRIFT_BEFORE)}) b ANTI JOIN ({duck(DRIFT_AFTER)}) a
ON a.table_name = b.table_name AND a.column_name = b.column_name
""")
def gone_columns(t: Tables) -> DataFrame:
    return k.gone(t.sql(DRIFT_BEFORE), t.sql(DRIFT_AFTER), "table_name", "column_name")


@query("asset_upsert", f"""
WITH o AS ({A}), n AS ({H})
SELECT coalesce(o.id, n.id) AS id, coalesce(n.connector_id, o.connector_id) AS connector_id,
       coalesce(o.connector_type, n.connector_type) AS connector_type,
       coalesce(o.source_item_id, n.source_item_id) AS source_item_id, coalesce(n.name, o.name) AS name,
       coalesce(n.type, o.type) AS type, CASE WHEN o.id IS NULL THEN n.owner ELSE o.owner END AS owner,
       coalesce(n.harvested_at, o.harvested_at) AS harvested_at
FROM o FULL JOIN n ON o.id = n.id
""")
def asset_upsert(t: Tables) -> DataFrame:
    return k.upsert_assets(t.sql(ASSETS), t.sql(HARVESTED))


@query("asset_refresh_clear", f"""
SELECT id FROM ({A}) WHERE NOT (connector_type = 'lake' AND connector_id = 'c4'
  AND source_item_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0))
""")
def asset_refresh_clear(t: Tables) -> DataFrame:
    items = t.supplier.filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"))
    return k.clear_items(t.sql(ASSETS), "lake", "c4", items).select("id")


@query("asset_list", f"""
SELECT id, name, type FROM ({A}) WHERE connector_type = 'local' AND type = 'Notebook' AND lower(name) LIKE '%r#0000%'
""")
def asset_list(t: Tables) -> DataFrame:
    return k.list_assets(t.sql(ASSETS), connector_type="local", asset_type="Notebook", search=" R#0000").select("id", "name", "type")


@query("asset_list_connector", f"SELECT id, name, type FROM ({A}) WHERE connector_id = 'c3'")
def asset_list_connector(t: Tables) -> DataFrame:
    """The connector id decides, whatever connector type is asked for."""
    return k.list_assets(t.sql(ASSETS), connector_id="c3", connector_type="lake").select("id", "name", "type")


@query("asset_type_counts", f"SELECT type, count(*) AS assets FROM ({A}) GROUP BY type")
def asset_type_counts(t: Tables) -> DataFrame:
    return k.type_counts(t.sql(ASSETS))


@query("asset_delete", f"""
WITH gone AS (SELECT concat('lake:', CAST(p_partkey AS VARCHAR)) AS id FROM part WHERE p_partkey % 3 = 0)
SELECT (SELECT count(*) FROM ({A}) WHERE id NOT IN (SELECT id FROM gone)) AS n_left,
       (SELECT count(*) FROM ({A}) WHERE id IN (SELECT id FROM gone)) AS removed
""")
def asset_delete(t: Tables) -> DataFrame:
    """More ids are asked for than there are assets; only what was there counts as removed."""
    ids = t.part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("lake:"), F.col("p_partkey").cast("string")).alias("id"))
    left, removed = k.delete_assets(t.sql(ASSETS), ids)
    counts = together(left=left.agg(F.count(F.lit(1)).alias("n")), gone=removed)
    return counts.select(F.col("left.n").alias("n_left"), F.col("gone.removed").alias("removed"))


@query("harvested_only", """
SELECT p_name AS table_name, p_partkey FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0)
""")
def harvested_only(t: Tables) -> DataFrame:
    live = t.part.select(F.col("p_name").alias("table_name"), "p_partkey")
    return k.harvested_only(live, t.part.filter("p_partkey % 50 = 0").select(F.col("p_name").alias("table_name")))


@query("name_search", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%r#00000%' AND lower(c_name) LIKE '%77%'")
def name_search(t: Tables) -> DataFrame:
    found = k.name_contains(t.customer, "c_name", " 77 ")
    return k.name_contains(found, "c_name", "R#00000").select("c_custkey", "c_name")


@query("without_internal", """
SELECT doc_id, name FROM (SELECT doc_id, concat(CASE doc_id % 4 WHEN 0 THEN 'StagingLakehouseForDataflows_'
  WHEN 1 THEN ' DataflowsStagingWarehouse' ELSE 'staging_' END, source) AS name FROM documents)
WHERE doc_id % 4 > 1
""")
def without_internal(t: Tables) -> DataFrame:
    prefix = (
        F.when(F.col("doc_id") % 4 == 0, F.lit("StagingLakehouseForDataflows_"))
        .when(F.col("doc_id") % 4 == 1, F.lit(" DataflowsStagingWarehouse")).otherwise(F.lit("staging_"))
    )
    return k.without_internal(t.documents.select("doc_id", F.concat(prefix, "source").alias("name")), INTERNAL_PREFIXES)


# --- rule proposals -----------------------------------------------------------------------------

PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("profile_columns", " UNION ALL ".join(f"""
SELECT '{name}' AS column_name, count(*) AS rows, count(*) - count({name}) AS nulls,
       CAST(min({name}) AS VARCHAR) AS low, CAST(max({name}) AS VARCHAR) AS high,
       min(length(CAST({name} AS VARCHAR))) AS min_length, max(length(CAST({name} AS VARCHAR))) AS max_length FROM orders
""" for name in PROFILED))
def profile_columns(t: Tables) -> DataFrame:
    return p.profile(t.orders).select("column_name", "rows", "nulls", "low", "high", "min_length", "max_length")


CANDIDATES = " UNION ALL ".join(f"""
SELECT {i * 10} AS position, '{name}' AS column_name, {number} AS is_number, {text} AS is_text, count(*) AS rows,
       count(DISTINCT {name}) AS n_distinct, CAST(min({name}) AS VARCHAR) AS low, CAST(max({name}) AS VARCHAR) AS high,
       CAST(min(length(CAST({name} AS VARCHAR))) AS VARCHAR) AS short, CAST(max(length(CAST({name} AS VARCHAR))) AS VARCHAR) AS long,
       count({name}) AS filled FROM orders
""" for i, (name, number, text) in enumerate(
    (n, n in ("o_orderkey", "o_custkey", "o_totalprice"), n in ("o_orderstatus", "o_orderpriority")) for n in PROFILED
))


RULES = f"""
WITH c AS (SELECT *, '`' || column_name || '`' AS q FROM ({CANDIDATES})),
allowed AS (SELECT 'o_orderstatus' AS column_name, string_agg(DISTINCT chr(39) || o_orderstatus || chr(39), ', ' ORDER BY chr(39) || o_orderstatus || chr(39)) AS list FROM orders
            UNION ALL SELECT 'o_orderpriority', string_agg(DISTINCT chr(39) || o_orderpriority || chr(39), ', ' ORDER BY chr(39) || o_orderpriority || chr(39)) FROM orders)
SELECT position, column_name || ' is filled' AS name, column_name, 'Null Value Constraint' AS validation_type,
       q || ' is not null' AS condition FROM c WHERE filled = rows
UNION ALL SELECT position + 1, column_name || ' is unique', column_name, 'Uniqueness Constraint', 'count(distinct ' || q || ') = count(*)' FROM c
  WHERE filled = rows AND n_distinct = rows
UNION ALL SELECT position + 2, column_name || ' in range', column_name, 'Boundary Range Constraint',
  q || ' between ' || CASE WHEN is_number THEN low || ' and ' || high
  ELSE 'cast(' || chr(39) || low || chr(39) || ' as timestamp_ntz) and cast(' || chr(39) || high || chr(39) || ' as timestamp_ntz)' END FROM c WHERE NOT is_text
UNION ALL SELECT position + 3, column_name || ' length', column_name, 'Length Constraint',
  'length(' || q || ') between ' || short || ' and ' || long FROM c WHERE is_text AND n_distinct > 20
UNION ALL SELECT position + 4, column_name || ' allowed', column_name, 'Categorical Constraint', q || ' in (' || list || ')' FROM c JOIN allowed USING (column_name)
  WHERE is_text AND n_distinct <= 20
"""


@query("candidate_rules", RULES)
def candidate_rules(t: Tables) -> DataFrame:
    """Rules that hold on every one of the orders."""
    return p.candidate_rules(t.orders, "orders").drop("table_name")


@query("candidate_checks", f"SELECT name, 'PASS' AS status, CAST(0 AS DOUBLE) AS violations, (SELECT count(*) FROM orders) AS total_rows FROM ({RULES})")
def candidate_checks(t: Tables) -> DataFrame:
    """Each proposed rule, run as a check of the table it was proposed for."""
    mapping = Mapping("orders", {"orders": t.orders}, kind=SOURCE_ONLY)
    checks = [p.as_check(r) for r in p.candidate_rules(t.orders, "orders").collect()]
    return run(t.spark, mapping, checks).results.select(F.col("test_name").alias("name"), "status", "violations", "total_rows")


PAIR_COLUMNS = (("o_orderkey", 0), ("o_custkey", 0), ("o_orderstatus", 2), ("o_orderpriority", 2), ("o_orderdate", 1))
PAIR_KINDS = (
    ("Null Value Constraint", "Boundary Range Constraint", "Uniqueness Constraint"), ("Null Value Constraint", "Boundary Range Constraint", "Data Freshness"),
    ("Null Value Constraint", "Length Constraint", "Categorical Constraint"),
)


@query("candidate_pairs", " UNION ALL ".join(
    f"SELECT '{name}' AS source_column, '{name}' AS destination_column, '{kind}' AS validation_type, true AS admitted, (SELECT count(*) FROM orders) AS rows"
    for name, family in PAIR_COLUMNS for kind in PAIR_KINDS[family]))
def candidate_pairs(t: Tables) -> DataFrame:
    """Column checks proposed for the orders and their copy; each is admitted and gives a verdict."""
    mapping = Mapping("pair", {"orders": t.orders}, {"dst": t.sql(DST)})
    found = p.candidate_pairs(t.orders, t.sql(DST)).collect()
    checks = [ColumnParity(name=r.name, validation_type=r.validation_type, source_column=r.source_column, destination_column=r.destination_column) for r in found]
    verdicts = run(t.spark, mapping, checks).results.select("test_name", (F.col("status") != "ERROR").alias("admitted"))
    proposed = p.candidate_pairs(t.orders, t.sql(DST)).join(verdicts, F.col("name") == F.col("test_name"))
    rows = t.orders.agg(F.count(F.lit(1)).alias("rows"))
    return proposed.select("source_column", "destination_column", "validation_type", "admitted").withColumn("rows", F.lit(rows.first().rows))


@query("candidate_keys", f"""
SELECT 'o_orderkey' AS source_column, 'o_orderkey' AS destination_column,
       (SELECT count(*) = count(DISTINCT o_orderkey) FROM ({duck(DST)})) AS destination_unique
FROM (SELECT 1) WHERE (SELECT count(*) = count(DISTINCT o_orderkey) FROM orders)
""")
def candidate_keys(t: Tables) -> DataFrame:
    return p.candidate_keys(t.orders, t.sql(DST))


@query("common_values", """
WITH v AS (SELECT 'source' AS column_name, source AS value, count(*) AS rows FROM documents GROUP BY source
           UNION ALL SELECT 'text', text, count(*) FROM documents GROUP BY text)
SELECT column_name, value, rows FROM v
QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, value) <= 5
""")
def common_values(t: Tables) -> DataFrame:
    return p.common_values(t.documents, ["source", "text"], 5)


PROPOSED = """
SELECT o_orderkey AS position, o_orderpriority AS left_table, o_orderstatus AS right_table,
       o_custkey % 40 AS column_name, CASE WHEN o_orderkey % 4 = 0 THEN concat('^', o_orderstatus) END AS pattern
FROM {orders}
"""
EXISTING = """
SELECT DISTINCT o_orderpriority AS left_table, o_orderstatus AS right_table, o_custkey % 40 AS column_name,
       CAST(NULL AS VARCHAR(20)) AS pattern
FROM {orders} WHERE o_custkey % 40 < 15
"""


@query("rule_dedupe", f"""
WITH s AS (SELECT *, least(left_table, right_table) || '+' || greatest(left_table, right_table) AS tables FROM ({duck(PROPOSED)})),
e AS (SELECT *, least(left_table, right_table) || '+' || greatest(left_table, right_table) AS tables FROM ({duck(EXISTING)}))
SELECT position, CASE WHEN row_number() OVER (PARTITION BY tables, column_name, pattern ORDER BY position) > 1
    OR EXISTS (SELECT 1 FROM e WHERE e.tables = s.tables AND e.column_name = s.column_name AND e.pattern IS NOT DISTINCT FROM s.pattern)
  THEN 'Duplicate of an existing rule' END AS reason FROM s
""")
def rule_dedupe(t: Tables) -> DataFrame:
    def signed(df: DataFrame) -> DataFrame:
        return df.withColumn("tables", p.tables_signature(F.array("left_table", "right_table")))

    marked = p.sort_out_duplicates(
        signed(t.sql(PROPOSED)), signed(t.sql(EXISTING)), ["tables", "column_name", "pattern"], "position"
    )
    return marked.select("position", "reason")
