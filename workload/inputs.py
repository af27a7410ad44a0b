"""Derived inputs: the same text for Spark and for the SQL it is checked against."""

# A destination copy of orders with seeded defects.
DST = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
       CASE WHEN o_orderkey % 61 = 0 AND o_orderstatus = 'P' THEN 'PENDING' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 71 = 0 THEN substring(o_orderpriority, 1, 3) ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN o_orderkey % 89 = 0 OR o_orderdate >= DATE '2001-07-01'
            THEN o_orderdate - INTERVAL '1' DAY ELSE o_orderdate END AS o_orderdate
FROM {orders} WHERE o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate
FROM {orders} WHERE o_orderkey % 211 = 0 AND o_orderkey % 97 <> 0
UNION ALL
SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_orderpriority, o_orderdate
FROM {orders} WHERE o_orderkey < 5
"""
SRC_A = "SELECT * FROM {orders} WHERE o_orderkey % 2 = 0"
SRC_B = """
SELECT o_orderkey AS order_no, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 2 = 1
"""
LINEITEM_COPY = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       CASE WHEN l_partkey % 101 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag, l_linestatus, l_shipdate
FROM {lineitem} WHERE l_orderkey % 97 <> 0
"""
DOCUMENTS_COPY = """
SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN concat(text, ' [cut]') ELSE text END AS text, lang, source, n_chars
FROM {documents} WHERE doc_id % 41 <> 0
"""

# Run history: customers are mappings, orders are runs of them, line items are results.
MAPPINGS = """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS source_connector_id,
       (c_nationkey + c_custkey) % 25 AS destination_connector_id
FROM {customer} WHERE c_custkey % 7 <> 0
"""
RUNS = """
SELECT o_orderkey AS id, o_custkey AS mapping_id,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 150 END AS suite_id,
       o_orderdate AS started_at, o_orderkey % 9 AS total_checkpoints,
       o_custkey % (o_orderkey % 9 + 1) AS pass_count,
       o_orderkey % 9 - o_custkey % (o_orderkey % 9 + 1) AS fail_count,
       CASE WHEN o_orderkey % 9 = o_custkey % (o_orderkey % 9 + 1) THEN 'passed' ELSE 'failed' END AS status
FROM {orders}
"""
RESULTS = """
SELECT l_orderkey AS run_id, l_partkey AS test_case_id, concat('TC-00', CAST(l_linenumber AS VARCHAR(10))) AS test_label,
       concat('check ', CAST(l_partkey AS VARCHAR(20))) AS test_name,
       concat('table ', CAST(l_suppkey AS VARCHAR(20))) AS rule_target,
       CASE l_partkey % 10 WHEN 0 THEN 'Null Value Constraint' WHEN 1 THEN 'Boundary Range Constraint'
            WHEN 2 THEN 'Regex Pattern Check' WHEN 3 THEN 'Uniqueness Constraint' WHEN 4 THEN 'Length Constraint'
            WHEN 5 THEN 'Categorical Constraint' WHEN 6 THEN 'Referential Integrity' WHEN 7 THEN 'Data Freshness'
            WHEN 8 THEN 'Record Volume Integrity' ELSE 'Custom' END AS validation_type,
       CASE WHEN l_suppkey % 20 = 19 THEN 'SKIPPED' WHEN l_suppkey % 10 < 7 THEN 'PASS'
            WHEN l_suppkey % 10 < 9 THEN 'FAIL' ELSE 'ERROR' END AS status,
       CASE WHEN l_suppkey % 10 < 7 THEN CAST(0 AS DOUBLE)
            WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity * (l_partkey % 5) END AS violations,
       CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_quantity * 2 AS BIGINT) END AS total_rows
FROM {lineitem}
"""
SUITES = "SELECT s_suppkey AS id, s_suppkey * 3 AS mapping_id, s_name AS name FROM {supplier}"
CASES = """
SELECT p_partkey AS id, p_partkey % 1499 AS mapping_id, p_name AS name, p_partkey % 6 <> 0 AS active FROM {part}
"""
MEMBERS = """
SELECT DISTINCT l_suppkey AS suite_id, l_partkey AS test_case_id, l_partkey AS position FROM {lineitem}
"""
SCHEDULES = "SELECT s_suppkey AS suite_id, s_nationkey AS hour FROM {supplier} WHERE s_suppkey % 2 = 0"

# Harvested assets: suppliers, harvested again with changes.
ASSETS = """
SELECT concat('lake:', CAST(s_suppkey AS VARCHAR(20))) AS id, concat('c', CAST(s_nationkey AS VARCHAR(20))) AS connector_id,
       CASE WHEN s_nationkey % 2 = 0 THEN 'lake' ELSE 'local' END AS connector_type,
       CAST(s_suppkey AS VARCHAR(20)) AS source_item_id, s_name AS name,
       CASE s_suppkey % 3 WHEN 0 THEN 'Lakehouse' WHEN 1 THEN 'Notebook' ELSE 'Pipeline' END AS type,
       CASE WHEN s_suppkey % 4 = 0 THEN 'ann' END AS owner,
       DATE '2026-01-01' + s_nationkey AS harvested_at
FROM {supplier}
"""
HARVESTED = """
SELECT concat('lake:', CAST(s_suppkey * 2 AS VARCHAR(20))) AS id, 'c99' AS connector_id, 'lake' AS connector_type,
       CAST(s_suppkey * 2 AS VARCHAR(20)) AS source_item_id, concat(s_name, ' again') AS name, 'Lakehouse' AS type,
       'bob' AS owner, DATE '2026-03-01' AS harvested_at
FROM {supplier} WHERE s_suppkey % 5 <> 0
"""
