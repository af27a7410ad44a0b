from datetime import timedelta

import pytest

from tallymark import model as m
from tallymark.model import CheckError, ColumnParity, DualScriptCheck, KeyParity, Mapping, RowCountMatch, RuleCheck, ScriptCheck
from tallymark.operators import history
from tallymark.operators.rules import not_null, unique
from tallymark.plans.runner import plan_all, run, units


def pair(spark):
    return Mapping("orders", {"s": spark.range(10)}, {"d": spark.range(9)})


def checks():
    return [
        RowCountMatch(name="rows"),
        ColumnParity(name="nulls", validation_type=m.NULLS, source_column="id", destination_column="id"),
        ColumnParity(name="range", validation_type=m.RANGE, source_column="id", destination_column="id"),
        ColumnParity(name="broken", validation_type=m.RANGE, source_column="nope", destination_column="id"),
        ColumnParity(name="distinct", validation_type=m.UNIQUENESS, source_column="id", destination_column="id"),
        KeyParity(name="keys", key="id"),
        KeyParity(name="all"),
        RuleCheck(name="filled", rule=not_null("id")),
        RuleCheck(name="single", rule=lambda df: unique(df, ["id"]), active=False),
        ScriptCheck(name="script", script="SELECT count(*) = 10 AS passed FROM s"),
        ScriptCheck(name="bad script", script="SELECT nope FROM s"),
        DualScriptCheck(name="dual", source_script="SELECT count(*) FROM s", destination_script=lambda s, r: {"value": r("d").count()}),
        ScriptCheck(name="crash", script=lambda s, r: 1 / 0),
    ]


def test_a_run_goes_on_after_errors(spark):
    outcome = run(spark, pair(spark), checks(), run_id="r1")
    got = {r["test_name"]: (r["test_label"], r["status"], r["violations"]) for r in outcome.rows}
    assert got == {
        "rows": ("TC-001", "FAIL", 1.0), "nulls": ("TC-002", "PASS", 0.0), "range": ("TC-003", "FAIL", 1.0),
        "broken": ("TC-004", "ERROR", None), "distinct": ("TC-005", "FAIL", 1.0), "keys": ("TC-006", "FAIL", 1.0),
        "all": ("TC-007", "FAIL", 1.0), "filled": ("TC-008", "PASS", 0.0), "single": ("TC-009", "PASS", 0.0),
        "script": ("TC-010", "PASS", None), "bad script": ("TC-011", "ERROR", None), "dual": ("TC-012", "FAIL", 1.0),
        "crash": ("TC-013", "ERROR", None),
    }
    errors = {r["test_name"]: r["error_message"] for r in outcome.rows if r["status"] == "ERROR"}
    assert "no such column: s.nope" in errors["broken"] and "division" in errors["crash"]
    summary = outcome.runs.first()
    assert (summary.status, summary.total_checkpoints, summary.pass_count, summary.fail_count) == ("failed", 13, 4, 9)
    rolled = history.roll_up(outcome.results).first()
    assert (rolled.pass_count, rolled.fail_count, rolled.status) == (4, 9, "failed")
    assert outcome.results.schema == m.RESULT_SCHEMA


def test_a_suite_leaves_inactive_checks_out(spark):
    chosen = [c for c in checks() if c.name in ("rows", "single")]
    outcome = run(spark, pair(spark), chosen, suite_id="s1")
    assert [r["test_name"] for r in outcome.rows] == ["rows"] and outcome.runs.first().suite_id == "s1"


def test_column_checks_and_row_rules_share_a_scan(spark):
    groups = [u.checks for u in units(spark, pair(spark), checks())]
    assert [1, 2, 3] in groups and [7] in groups


def test_lazy_plan_gives_the_same_verdicts(spark):
    chosen = [c for c in checks() if c.name not in ("broken", "bad script", "crash")]
    lazy = {r.test_name: (r.status, r.violations) for r in plan_all(spark, pair(spark), chosen).collect()}
    eager = {r["test_name"]: (r["status"], r["violations"]) for r in run(spark, pair(spark), chosen).rows}
    assert lazy == eager


def test_source_only_mappings_refuse_two_sided_checks(spark):
    alone = Mapping("alone", {"s": spark.range(3)}, kind=m.SOURCE_ONLY)
    outcome = run(spark, alone, [
        RowCountMatch(name="rows"), RuleCheck(name="filled", rule=not_null("id")),
        RuleCheck(name="other side", rule=not_null("id"), side="destination"), ScriptCheck(name="n", script="SELECT 1 AS passed"),
    ])
    assert [r["status"] for r in outcome.rows] == ["ERROR", "PASS", "ERROR", "PASS"]


def test_rules_without_a_table_judge_every_table(spark):
    a, b = spark.range(1, 3).toDF("x"), spark.sql("SELECT CAST(NULL AS int) AS x, 1 AS only UNION ALL SELECT 3, 2")
    both = Mapping("both", {"a": a, "b": b}, kind=m.SOURCE_ONLY)
    rows = run(spark, both, [
        RuleCheck(name="filled", rule=not_null("x")), RuleCheck(name="alone", rule=not_null("x"), table="a"), RuleCheck(name="lacking", rule=not_null("only")),
    ]).rows
    assert [(r["status"], r["violations"], r["total_rows"], r["rule_target"]) for r in rows] == [
        ("FAIL", 1.0, 4, "a, b"), ("PASS", 0.0, 2, "a"), ("ERROR", None, None, "a, b")]
    assert "a lacks only" in rows[2]["error_message"]


def test_definitions_are_checked(spark):
    with pytest.raises(ValueError):
        Mapping("x", {})
    with pytest.raises(ValueError):
        ColumnParity(name="x", validation_type=m.REFERENTIAL, source_column="a", destination_column="a")
    with pytest.raises(ValueError):
        RowCountMatch(name="")
    with pytest.raises(ValueError):
        DualScriptCheck(name="x", source_script="SELECT 1", destination_script="")
    with pytest.raises(CheckError, match="not among"):
        m.admit(RowCountMatch(name="x", source_tables=["zz"]), pair(spark))
    with pytest.raises(CheckError, match="pattern"):
        m.admit(ColumnParity(name="x", validation_type=m.REGEX, source_column="id", destination_column="id"), pair(spark))


def test_history_is_stored_read_and_pruned(spark, tmp_path):
    stored, kept = str(tmp_path / "history"), str(tmp_path / "kept")
    for n in range(3):
        outcome = run(spark, pair(spark), checks()[:2], run_id=f"r{n}")
        history.append_history(outcome.runs, outcome.results, stored)
    runs, results = history.read_history(spark, stored)
    assert (runs.count(), results.count()) == (3, 6)
    now = runs.agg({"started_at": "max"}).first()[0]
    history.prune_stored(spark, stored, kept, now + timedelta(days=19))
    assert [df.count() for df in history.read_history(spark, kept)] == [3, 6]
    cutoff = runs.filter("id = 'r2'").first().started_at
    left = history.prune(runs, results, cutoff)
    assert [df.count() for df in left] == [1, 2]
    detail = history.run_detail(runs, results, "r1").collect()
    assert [r.test_label for r in detail] == ["TC-001", "TC-002"] and detail[0].run_status == "failed"
