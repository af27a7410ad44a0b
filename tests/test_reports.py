from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymark.operators import history as h
from tallymark.operators import reports as r

RUNS = [  # id, mapping, started, total, passed
    ("r1", "m1", datetime(2026, 1, 1), 3, 3), ("r2", "m1", datetime(2026, 2, 1), 3, 1), ("r3", "m1", datetime(2026, 2, 1), 2, 1),
    ("r4", "m2", datetime(2026, 1, 15), 0, 0), ("r5", "gone1", datetime(2026, 1, 20), 4, 3), ("r6", "gone2", datetime(2025, 1, 1), 1, 1),
]
RESULTS = [  # run, type, status, violations, rows
    ("r1", "Null Value Constraint", "PASS", 0.0, 10), ("r2", "Null Value Constraint", "FAIL", 4.0, 10),
    ("r2", "Referential Integrity", "FAIL", 82660.0, 41330), ("r3", "Custom", "ERROR", None, None), ("r3", "Custom", "ODD", 3.0, None),
    ("r5", "Custom", "PASS", -5.0, 100), ("r5", "Custom", "FAIL", 7.0, 0), ("r6", "Custom", "PASS", 1.0, 8),
]


@pytest.fixture(scope="module")
def tables(spark):
    results = spark.createDataFrame(
        [(*x, f"TC-{i:03d}", f"check {i}", "t") for i, x in enumerate(RESULTS)],
        "run_id string, validation_type string, status string, violations double, total_rows bigint, test_label string, "
        "test_name string, rule_target string")
    runs = spark.createDataFrame(
        [(i, m, s, t, p, t - p, "passed" if t == p else "failed") for i, m, s, t, p in RUNS],
        "id string, mapping_id string, started_at timestamp_ntz, total_checkpoints int, pass_count int, fail_count int, status string")
    return results, runs, spark.createDataFrame([("m1", "one"), ("m2", "two")], "id string, name string")


def test_row_quality_clamps_and_leaves_out(tables):
    got = r.row_quality(tables[0]).first().asDict()
    assert got == {"examined": 41458, "clean": 10.0 + 6 + 0 + 100 + 7, "violations": 4.0 + 41330 + 0 + 1, "excluded": 3, "quality_pct": 0.3}


def test_latest_runs_keep_ties_and_respect_the_window(tables):
    _, runs, _ = tables
    assert {x.id for x in h.latest_runs(runs).collect()} == {"r2", "r3", "r4", "r5", "r6"}
    scope = h.Scope(window="1m", as_of=datetime(2026, 1, 31))
    assert {x.id for x in h.latest_runs(h.in_window(runs, scope).filter("started_at < '2026-01-31'")).collect()} == {"r1", "r4", "r5"}


def test_a_layer_filter_leaves_deleted_layers_out(tables):
    _, runs, mappings = tables
    everything = h.scoped_runs(runs, mappings, h.Scope(basis="all")).collect()
    assert {x.mapping_name for x in everything} == {"one", "two", h.DELETED} and len(everything) == 6
    named = h.scoped_runs(runs, mappings, h.Scope(mapping_ids=["m1", "gone1"], basis="all")).collect()
    assert {x.id for x in named} == {"r1", "r2", "r3"}
    assert {x.id for x in h.orphaned_runs(runs, mappings).collect()} == {"r5", "r6"}


def test_reports(tables):
    digested = r.scoped_digest(*tables, h.Scope(basis="all"))
    assert r.status_counts(digested).first().asDict() == {"n_pass": 3, "n_fail": 3, "n_error": 1, "total": 7}
    types = {x.validation_type: x for x in r.by_type(digested).collect()}
    assert (types["Custom"].n_pass, types["Custom"].checks, types["Custom"].rows) == (3, 5, 108)
    assert types["Referential Integrity"].violation_pct == 100.0
    layers = [(x.mapping_id, x.mapping_name, x.n_pass, x.n_fail, x.n_error, x.quality_pct) for x in r.by_layer(digested).collect()]
    assert layers == [(None, h.DELETED, 2, 1, 0, 99.07), ("m1", "one", 2, 2, 1, 0.04)]
    summary = r.summary(digested, tables[1], tables[2]).first()
    assert (summary.layers_covered, summary.runs_covered, summary.orphaned_runs) == (2, 5, 2)
    assert (summary.null_violations, summary.null_rows, summary.null_checks) == (4.0, 20, 2)
    busiest = r.busiest_layers(r.by_layer(digested), 1).collect()
    assert [(x.mapping_name, x.checks, x.hidden) for x in busiest] == [("one", 5, 1)]


def test_reports_over_nothing(tables):
    none = r.scoped_digest(*tables, h.Scope(mapping_ids=["nobody"], basis="all"))
    assert r.status_counts(none).first().total == 0 and r.status_shares(none).isEmpty()
    assert r.summary(none, tables[1], tables[2]).first().quality_pct is None
    assert r.busiest_layers(r.by_layer(none)).isEmpty()


def test_offenders_and_their_order(tables):
    found = r.offenders(h.scoped_results(*tables, h.Scope(basis="all")), 3)
    assert [(x.violations, x.offender_count) for x in found.orderBy(F.desc("violations")).collect()] == [(82660.0, 5), (7.0, 5), (4.0, 5)]
    for down in (False, True):
        rows = [x.total_rows for x in r.sort_checks(tables[0], "total_rows", down).collect()]
        known = [x for x in rows if x is not None]
        assert rows[-2:] == [None, None] and known == sorted(known, reverse=down)


def test_pass_rates(tables):
    rate = r.row_pass_rate(F.col("violations"), F.col("total_rows"), F.col("status"))
    got = [x[0] for x in tables[0].orderBy("test_label").select(rate).collect()]
    assert got == [100.0, 60.0, 0.0, 0.0, 0.0, 100.0, 0.0, 87.5]
    assert {x.id: x.pass_rate for x in r.run_pass_rate(tables[1]).collect()} == {
        "r1": 100.0, "r2": 33.3, "r3": 50.0, "r4": 0.0, "r5": 75.0, "r6": 100.0}


def test_daily_trend(tables):
    _, runs, mappings = tables
    trend = r.trend(runs, mappings, h.Scope())
    assert [x.run_id for x in trend.collect()] == ["r6", "r1", "r4", "r5", "r2", "r3"]
    single = {(str(x.day), x.series): x.pct for x in r.daily_trend(trend).collect()}
    assert single[("2026-02-01", "one")] == 50.0 and single[("2026-01-15", "two")] is None and len(single) == 5
    pooled = {(str(x.day), x.series): x.pct for x in r.daily_trend(trend, pooled=True).collect()}
    assert pooled[("2026-02-01", r.ALL_LAYERS)] == 40.0 and pooled[("2026-01-20", r.ALL_LAYERS)] == 75.0 and len(pooled) == 5


def test_export(tables, spark, tmp_path):
    out = r.export_tables(*tables, h.Scope(basis="all"))
    r.write_export(out, str(tmp_path / "p"))
    r.write_export(out, str(tmp_path / "c"), "csv", ["summary", "runs"])
    summary = [tuple(x) for x in spark.read.parquet(str(tmp_path / "p/summary")).orderBy("position").collect()]
    assert dict(x[1:] for x in summary) | {"n_pass": "3.00", "n_fail": "3.00", "runs_covered": "5.00", "basis": "all", "since": None} == dict(x[1:] for x in summary)
    assert len(summary) == 16
    assert spark.read.csv(str(tmp_path / "c/runs"), header=True).count() == 6
    assert {k: v.count() for k, v in out.items()} == {"checks": 8, "by_dimension": 3, "by_layer": 2, "runs": 6, "summary": 16}


def test_scope_arguments():
    with pytest.raises(ValueError):
        h.Scope(basis="newest")
    with pytest.raises(ValueError):
        h.Scope(window="2w")
    with pytest.raises(ValueError):
        h.Scope(window="1y")


def test_labels_number_the_checks_of_each_suite(spark):
    cases = spark.createDataFrame([("a", p) for p in (0, 3, 4, 9, 25)] + [("b", 7)], "suite_id string, position int")
    got = {(x.suite_id, x.position): x.test_label for x in h.labelled(cases, block=4).collect()}
    assert got == {("a", 0): "TC-001", ("a", 3): "TC-002", ("a", 4): "TC-003", ("a", 9): "TC-004", ("a", 25): "TC-005", ("b", 7): "TC-001"}
