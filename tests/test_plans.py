"""What the plans look like: pruned scans, one shuffle, no pair-producing joins, no Python."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 - registers the queries
from tallymark.operators import parity
from workload import registry
from workload.inputs import DST, LINEITEM_COPY, MAPPINGS, RESULTS, RUNS


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


LAZY = [n for n in sorted(registry.QUERIES) if not n.startswith(
    ("ingest", "stream", "append", "check_run", "run_rollup", "dual_callables", "rule_all", "xml_", "history_", "harvest_job", "refused", "bind"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_pair_producing_join_and_no_python(spark, folder, name):
    plan = plan_of(registry.QUERIES[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "MapInPandas" not in plan


def test_a_column_check_reads_its_column_only(spark, folder):
    assert set(scans(plan_of(registry.QUERIES["parity_volume"](spark, folder)))) == {
        "o_orderkey:bigint,o_custkey:bigint", "o_orderkey:bigint,o_custkey:bigint"}
    assert scans(plan_of(registry.QUERIES["rule_range"](spark, folder))) == ["l_quantity:double"]
    assert scans(plan_of(registry.QUERIES["select_value"](spark, folder))) == ["l_shipdate:timestamp_ntz"]


def test_filters_reach_the_scan(spark, folder):
    plan = plan_of(registry.QUERIES["retention"](spark, folder))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan or "LessThan(o_orderdate" in plan


def test_whole_rows_shuffle_once(spark, folder):
    t = registry.Tables(spark, folder)
    df = parity.row_parity({"s": t.lineitem}, {"d": t.sql(LINEITEM_COPY)}, samples=0)
    plan = plan_of(df)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_examples_reuse_the_shuffle(spark, folder):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = registry.Tables(spark, folder)
        plan = plan_of(parity.row_parity({"s": t.orders}, {"d": t.sql(DST)}))
        assert plan.count("ReusedExchange") >= 2
        columns = {"s": "o_orderstatus", "d": "o_orderstatus"}
        assert plan_of(parity.categorical_parity({"s": t.orders}, {"d": t.sql(DST)}, columns, columns)).count("ReusedExchange") == 2
        assert plan_of(parity.key_parity({"s": t.orders}, {"d": t.sql(DST)}, "o_orderkey")).count("ReusedExchange") == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_referential_check_is_a_grouping(spark, folder):
    plan = plan_of(registry.QUERIES["rule_referential"](spark, folder))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_reports_scope_results_before_they_sum_them(spark, folder):
    """Results meet their runs by run; sums by type then need one more, map-side combined, shuffle."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(registry.QUERIES["by_type"](spark, folder))
        assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("SortMergeJoin") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stored_results_are_pruned_by_day(spark, folder, tmp_path):
    from datetime import datetime

    from tallymark.operators import history, reports

    t = registry.Tables(spark, folder)
    runs, results, mappings = t.sql(RUNS), t.sql(RESULTS), t.sql(MAPPINGS)
    day = {"run_date": F.to_date("started_at")}
    runs.withColumns(day).write.partitionBy("run_date").parquet(str(tmp_path / "runs"))
    results.join(runs.withColumns(day).selectExpr("id AS run_id", "run_date"), "run_id").write.partitionBy("run_date").parquet(str(tmp_path / "results"))
    stored = [spark.read.parquet(str(tmp_path / n)) for n in ("results", "runs")]
    plan = plan_of(reports.by_type(reports.scoped_digest(*stored, mappings, history.Scope(window="1y", as_of=datetime(2001, 8, 2)))))
    assert len(re.findall(r"PartitionFilters: \[[^\]]*run_date[^\]]*>= 2000-08-02", plan)) == 3  # results once, runs twice


def test_frequent_values_are_limited_in_each_task(spark, folder):
    assert plan_of(registry.QUERIES["common_values"](spark, folder)).count("WindowGroupLimit") == 2
