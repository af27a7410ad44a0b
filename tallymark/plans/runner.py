"""Checks to plans: shared scans, one result row per check, one row per run.

Every check is a lazy one-row plan. Column checks over the same tables and row rules over
the same table share a scan. Only verdict rows reach the driver, and independent plans
are submitted side by side so that their stages share the cluster.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import model
from tallymark.model import (
    ALL_COLUMNS, Check, CheckError, ColumnParity, DualScriptCheck, KeyParity, Mapping, RowCountMatch, RuleCheck, ScriptCheck,
    admit,
)
from tallymark.operators import parity, scripts, set_checks
from tallymark.operators.rules import Rule, check_rows, check_rule
from tallymark.operators.sides import lacking, side_rows, stack
from tallymark.operators.verdicts import ERROR, PASS

WORKERS = 4


def label(position: int) -> str:
    return f"TC-{position:03d}"


def side_tables(check: ScriptCheck, mapping: Mapping) -> dict[str, DataFrame]:
    """A script may read every table of the mapping: one session reaches both sides."""
    return mapping.every_table()


def _rule_rows(check: RuleCheck, mapping: Mapping) -> DataFrame:
    """The rows a rule judges: those of every table of the side, unless the check names one."""
    return side_rows(mapping.side(check.side, [check.table] if check.table else ()), mapping.column_map, check.side)


def _rule_or_plan(check: RuleCheck, mapping: Mapping) -> tuple[DataFrame, Rule | DataFrame]:
    rows = _rule_rows(check, mapping)
    try:
        made = check.rule if isinstance(check.rule, Rule) else check.rule(rows)
        if isinstance(made, Rule):
            rows.agg(made.violations, made.note)
    except Exception as problem:
        gaps = lacking(mapping.side(check.side, [check.table] if check.table else ()), mapping.column_map, check.side)
        named = [f"{', '.join(tables)} lacks {name}" for name, tables in gaps.items() if re.search(rf"(?<!\w){re.escape(name)}(?!\w)", str(problem))]
        if named:
            raise CheckError(f"the rule needs a column of every table: {'; '.join(named)}") from problem
        raise
    return rows, made


def plan(spark: SparkSession, mapping: Mapping, check: Check) -> DataFrame:
    """The check on its own, as a lazy one-row verdict."""
    admit(check, mapping)
    if isinstance(check, RowCountMatch):
        return parity.row_count_match(*check.frames(mapping))
    if isinstance(check, ColumnParity):
        return parity.column_parity(*check.frames(mapping), check, mapping.column_map)
    if isinstance(check, KeyParity):
        source, destination = check.frames(mapping)
        if check.key == ALL_COLUMNS:
            return parity.row_parity(source, destination, mapping.column_map)
        return parity.key_parity(source, destination, check.key, mapping.column_map)
    if isinstance(check, DualScriptCheck):
        tables = mapping.every_table()
        sides = scripts.dual_frames(
            spark, check.source_script, {**tables, **mapping.source},
            check.destination_script, {**tables, **mapping.destination},
        )
        return scripts.dual_value(*sides)
    if isinstance(check, ScriptCheck):
        if callable(check.script):
            return scripts.callable_check(spark, check.script, side_tables(check, mapping))
        return scripts.sql_check(spark, check.script, side_tables(check, mapping))
    if isinstance(check, RuleCheck):
        rows, made = _rule_or_plan(check, mapping)
        return check_rule(rows, made) if isinstance(made, Rule) else made
    raise CheckError(f"no plan for a {type(check).__name__}")


@dataclass
class Unit:
    """Checks answered by one plan, in the order of the plan's ``position``."""

    checks: list[int]
    build: Callable[[], DataFrame]


def units(spark: SparkSession, mapping: Mapping, checks: Sequence[Check]) -> list[Unit]:
    """Group the checks that can share a scan; every other check is a unit of its own."""
    shared_parity: dict[tuple, list[int]] = {}
    shared_sets: dict[tuple, list[int]] = {}
    shared_rules: dict[tuple, list[tuple[int, Rule]]] = {}
    single: list[Unit] = []
    for i, check in enumerate(checks):
        if isinstance(check, ColumnParity) and parity.shares_a_scan(check):
            key = (tuple(check.source_tables), tuple(check.destination_tables))
            shared_parity.setdefault(key, []).append(i)
        elif set_checks.shares_a_grouping(check) and len(mapping.source) + len(mapping.destination) <= set_checks.MOST_TABLES:
            shared_sets.setdefault((tuple(check.source_tables), tuple(check.destination_tables)), []).append(i)
        elif isinstance(check, RuleCheck) and mapping.kind == model.TWO_SIDED or (
            isinstance(check, RuleCheck) and check.side == "source"
        ):
            made = _quietly(lambda check=check: admit(check, mapping) or _rule_or_plan(check, mapping)[1])
            if isinstance(made, Rule):
                shared_rules.setdefault((check.side, check.table), []).append((i, made))
            else:
                single.append(_alone(spark, mapping, check, i))
        else:
            single.append(_alone(spark, mapping, check, i))
    out = []
    for members in shared_parity.values():
        out.append(Unit(members, lambda members=members: _parity_unit(mapping, [checks[i] for i in members])))
    for members in shared_sets.values():
        if len(members) == 1:
            single.append(_alone(spark, mapping, checks[members[0]], members[0]))
        else:
            out.append(Unit(members, lambda members=members: _set_unit(mapping, [checks[i] for i in members])))
    for pairs in shared_rules.values():
        out.append(Unit(
            [i for i, _ in pairs],
            lambda pairs=pairs: check_rows(_rule_rows(checks[pairs[0][0]], mapping), [rule for _, rule in pairs]),
        ))
    return out + single


def _quietly(build: Callable[[], object]) -> object | None:
    try:
        return build()
    except Exception:  # the check fails again, and is reported, when it is planned alone
        return None


def _alone(spark: SparkSession, mapping: Mapping, check: Check, i: int) -> Unit:
    return Unit([i], lambda: plan(spark, mapping, check).select(F.lit(0).alias("position"), "*"))


def _parity_unit(mapping: Mapping, checks: Sequence[ColumnParity]) -> DataFrame:
    for check in checks:
        admit(check, mapping)
    source, destination = checks[0].frames(mapping)
    return parity.column_parity_many(source, destination, checks, mapping.column_map)


def _set_unit(mapping: Mapping, checks: Sequence[Check]) -> DataFrame:
    for check in checks:
        admit(check, mapping)
    source, destination = checks[0].frames(mapping)
    return set_checks.set_parity_many(source, destination, checks, mapping.column_map)


def plan_all(spark: SparkSession, mapping: Mapping, checks: Sequence[Check]) -> DataFrame:
    """Every check in one lazy frame: label, name, target and verdict."""
    arms = []
    for unit in units(spark, mapping, checks):
        df = unit.build()
        if "error_message" not in df.columns:
            df = df.withColumn("error_message", F.lit(None).cast("string"))
        at = F.element_at(F.array(*(F.lit(i + 1) for i in unit.checks)), F.col("position") + 1)
        arms.append(df.select(
            at.alias("number"), "status", "details", "violations", "total_rows", "error_message",
        ))
    number = F.col("number")

    def of_check(values: Iterable[str]):
        return F.element_at(F.array(*(F.lit(v) for v in values)), number)

    return stack(arms).select(
        F.format_string("TC-%03d", number).alias("test_label"),
        of_check(c.name for c in checks).alias("test_name"),
        of_check(c.target(mapping) for c in checks).alias("rule_target"),
        of_check(c.validation_type for c in checks).alias("validation_type"),
        of_check(c.severity for c in checks).alias("severity"),
        "status", "violations", "total_rows", "details", "error_message",
    )


@dataclass
class Outcome:
    run_id: str
    runs: DataFrame
    results: DataFrame
    rows: list[dict] = field(default_factory=list)


def _evidence(check: Check, mapping: Mapping) -> str:
    if isinstance(check, ScriptCheck):
        return check.script if isinstance(check.script, str) else getattr(check.script, "__name__", "callable")
    if isinstance(check, DualScriptCheck):
        sides = (check.source_script, check.destination_script)
        left, right = (s if isinstance(s, str) else getattr(s, "__name__", "callable") for s in sides)
        return f"[source] {left}  |  [destination] {right}"
    return f"{type(check).__name__} {check.target(mapping)}"


def _answer(unit: Unit) -> tuple[list[dict], float]:
    began = time.monotonic()
    rows = [row.asDict() for row in unit.build().collect()]
    return sorted(rows, key=lambda r: r["position"]), time.monotonic() - began


def _answers(spark: SparkSession, mapping: Mapping, checks: Sequence[Check], unit: Unit) -> dict[int, tuple[dict, float]]:
    """Verdict per check; a shared scan that fails is retried check by check."""
    try:
        rows, seconds = _answer(unit)
        return {i: (row, seconds) for i, row in zip(unit.checks, rows, strict=True)}
    except Exception as problem:
        if len(unit.checks) > 1:
            out: dict[int, tuple[dict, float]] = {}
            for i in unit.checks:
                out |= _answers(spark, mapping, checks, _alone(spark, mapping, checks[i], i))
            return out
        return {unit.checks[0]: ({"status": ERROR, "error_message": str(problem).strip()}, 0.0)}


def run(
    spark: SparkSession, mapping: Mapping, checks: Sequence[Check], suite_id: str | None = None,
    run_id: str | None = None, workers: int = WORKERS,
) -> Outcome:
    """Run the checks; an exception in one is its ERROR row and the run goes on.

    A suite leaves inactive checks out, a run over the mapping takes them all.
    """
    chosen = [c for c in checks if c.active] if suite_id is not None else list(checks)
    run_id = run_id or uuid.uuid4().hex
    started, began = datetime.now(timezone.utc), time.monotonic()
    answers: dict[int, tuple[dict, float]] = {}
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        for part in pool.map(lambda u: _answers(spark, mapping, chosen, u), units(spark, mapping, chosen)):
            answers |= part
    rows = []
    for i, check in enumerate(chosen):
        row, seconds = answers[i]
        rows.append({
            "run_id": run_id, "test_case_id": check.id, "test_label": label(i + 1), "test_name": check.name,
            "rule_target": check.target(mapping), "validation_type": check.validation_type,
            "severity": check.severity, "origin": check.origin, "description": check.description, "status": row["status"],
            "evaluated_query": _evidence(check, mapping), "details": row.get("details"),
            "error_message": row.get("error_message"), "violations": row.get("violations"),
            "total_rows": row.get("total_rows"), "duration_seconds": round(seconds, 3),
            "executed_at": datetime.now(timezone.utc),
        })
    passed = sum(r["status"] == PASS for r in rows)
    run_row = {
        "id": run_id, "mapping_id": mapping.id, "suite_id": suite_id,
        "status": "passed" if passed == len(rows) else "failed", "total_checkpoints": len(rows),
        "pass_count": passed, "fail_count": len(rows) - passed,
        "compute_time_seconds": round(time.monotonic() - began, 3),
        "started_at": started, "finished_at": datetime.now(timezone.utc),
    }
    return Outcome(
        run_id,
        spark.createDataFrame([run_row], model.RUN_SCHEMA),
        spark.createDataFrame(rows, model.RESULT_SCHEMA),
        rows,
    )
