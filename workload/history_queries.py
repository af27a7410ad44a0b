"""Run history and quality reports: orders are runs, line items their results, customers the mappings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators import digests as dg
from tallymark.operators import history as h
from tallymark.operators import reports as r
from tallymark.session import scratch_dir
from workload.inputs import CASES, MAPPINGS, MEMBERS, RESULTS, RUNS, SCHEDULES, SUITES
from workload.registry import Tables, duck, query

AS_OF = datetime(2001, 8, 2)
CUTOFF = datetime(1999, 1, 1)
FEW = (1, 2, 3, 4, 5, 6, 7)

BASE = f"""
mappings AS ({duck(MAPPINGS)}), runs AS ({duck(RUNS)}), results AS ({duck(RESULTS)}),
suites AS ({duck(SUITES)}), cases AS ({duck(CASES)}), members AS ({duck(MEMBERS)}), schedules AS ({duck(SCHEDULES)})
"""
LATEST = "started_at = (SELECT max(started_at) FROM runs x WHERE x.mapping_id = runs.mapping_id)"


def scoped(where: str = "true", join: str = "LEFT JOIN") -> str:
    """Result rows in scope, as the reports see them."""
    return f"""
    {BASE}, scope AS (SELECT * FROM runs WHERE {where}),
    r AS (SELECT results.*, scope.mapping_id, scope.started_at AS run_started_at,
                 coalesce(m.name, '(deleted test layer)') AS mapping_name,
                 CASE WHEN total_rows > 0 THEN least(greatest(coalesce(violations, 0), 0), total_rows) END AS bad
          FROM results JOIN scope ON scope.id = results.run_id {join} mappings m ON m.id = scope.mapping_id)
    """


PCT = "CASE WHEN {whole} = 0 THEN NULL ELSE round({part} * 100.0 / {whole}, 2) END"


def frames(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.sql(RESULTS), t.sql(RUNS), t.sql(MAPPINGS)


def digested(t: Tables, scope: h.Scope, named: bool = True) -> DataFrame:
    return r.scoped_digest(*frames(t), scope, named)


@query("status_counts", f"""
WITH {scoped()}, n AS (SELECT count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail,
                              count(*) FILTER (status = 'ERROR') AS n_error FROM r)
SELECT *, n_pass + n_fail + n_error AS total FROM n
""")
def status_counts(t: Tables) -> DataFrame:
    return r.status_counts(digested(t, h.Scope(basis="all"), named=False))


@query("status_shares", f"""
WITH {scoped(LATEST)} SELECT status, count(*) AS checks FROM r WHERE status IN ('PASS', 'FAIL', 'ERROR') GROUP BY status
""")
def status_shares(t: Tables) -> DataFrame:
    return r.status_shares(digested(t, h.Scope(), named=False))


ROW_QUALITY = f"""
SELECT CAST(coalesce(sum(total_rows) FILTER (total_rows > 0), 0) AS BIGINT) AS examined,
       CAST(coalesce(sum(total_rows - bad), 0) AS DOUBLE) AS clean, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS violations,
       count(*) FILTER (coalesce(total_rows, 0) <= 0) AS excluded,
       {PCT.format(part="sum(total_rows - bad)", whole="sum(total_rows) FILTER (total_rows > 0)")} AS quality_pct FROM r
"""


@query("row_quality", f"WITH {scoped()} {ROW_QUALITY}")
def row_quality(t: Tables) -> DataFrame:
    results, runs, mappings = frames(t)
    return r.row_quality(h.scoped_results(results, runs, mappings, h.Scope(basis="all")))


@query("row_quality_window", f"""
WITH {scoped("started_at >= TIMESTAMP '2001-05-04 00:00:00'")} {ROW_QUALITY}
""")
def row_quality_window(t: Tables) -> DataFrame:
    """The last three months."""
    results, runs, mappings = frames(t)
    return r.row_quality(h.scoped_results(results, runs, mappings, h.Scope(basis="all", window="3m", as_of=AS_OF)))


BY_TYPE = f"""
SELECT validation_type, count(*) FILTER (status NOT IN ('FAIL', 'ERROR')) AS n_pass,
       count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'ERROR') AS n_error,
       CAST(coalesce(sum(bad), 0) AS DOUBLE) AS violations, CAST(coalesce(sum(total_rows), 0) AS BIGINT) AS rows,
       count(*) AS checks, {PCT.format(part="coalesce(sum(bad), 0)", whole="coalesce(sum(total_rows), 0)")} AS violation_pct
FROM r GROUP BY validation_type
"""
BY_LAYER = f"""
SELECT CASE WHEN mapping_name <> '(deleted test layer)' THEN mapping_id END AS mapping_id, mapping_name,
       count(*) FILTER (status NOT IN ('FAIL', 'ERROR')) AS n_pass,
       count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'ERROR') AS n_error,
       max(run_started_at) AS last_run_at,
       {PCT.format(part="sum(total_rows - bad)", whole="sum(total_rows) FILTER (total_rows > 0)")} AS quality_pct
FROM r GROUP BY 1, 2
"""


@query("by_type", f"WITH {scoped()} {BY_TYPE}")
def by_type(t: Tables) -> DataFrame:
    return r.by_type(digested(t, h.Scope(basis="all"), named=False))


@query("by_layer", f"WITH {scoped()} {BY_LAYER}")
def by_layer(t: Tables) -> DataFrame:
    return r.by_layer(digested(t, h.Scope(basis="all")))


@query("latest_basis", f"WITH {scoped(LATEST)} {BY_LAYER}")
def latest_basis(t: Tables) -> DataFrame:
    return r.by_layer(digested(t, h.Scope()))


@query("latest_in_window", f"""
WITH {scoped(f"started_at >= TIMESTAMP '2000-08-02 00:00:00' AND {LATEST}")} {BY_TYPE}
""")
def latest_in_window(t: Tables) -> DataFrame:
    return r.by_type(digested(t, h.Scope(window="1y", as_of=AS_OF), named=False))


@query("latest_of_layers", f"""
WITH {scoped(f"mapping_id IN {FEW} AND {LATEST}", "JOIN")} {BY_LAYER}
""")
def latest_of_layers(t: Tables) -> DataFrame:
    return r.by_layer(digested(t, h.Scope(mapping_ids=FEW)))


@query("latest_of_many_layers", f"""
WITH {scoped(f"mapping_id % 3 = 1 AND {LATEST}", "JOIN")} {BY_LAYER}
""")
def latest_of_many_layers(t: Tables) -> DataFrame:
    """Layers named by a table instead of a list."""
    chosen = t.sql(MAPPINGS).where("id % 3 = 1").select(F.col("id").alias("mapping_id"))
    return r.by_layer(digested(t, h.Scope(mapping_ids=chosen)))


@query("busiest_layers", f"""
WITH {scoped()}, l AS (SELECT mapping_name, count(*) AS checks FROM r GROUP BY 1)
SELECT *, (SELECT count(*) FROM l) - 8 AS hidden FROM l ORDER BY checks DESC, mapping_name LIMIT 8
""")
def busiest_layers(t: Tables) -> DataFrame:
    return r.busiest_layers(r.by_layer(digested(t, h.Scope(basis="all"))))


@query("null_summary", f"""
WITH {scoped()}
SELECT CAST(coalesce(sum(bad), 0) AS DOUBLE) AS violations,
       CAST(coalesce(sum(total_rows) FILTER (total_rows > 0), 0) AS BIGINT) AS rows, count(*) AS checks
FROM r WHERE validation_type = 'Null Value Constraint'
""")
def null_summary(t: Tables) -> DataFrame:
    return r.null_summary(digested(t, h.Scope(basis="all"), named=False))


SUMMARY = f"""
SELECT count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail,
       count(*) FILTER (status = 'ERROR') AS n_error,
       CAST(coalesce(sum(total_rows) FILTER (total_rows > 0), 0) AS BIGINT) AS examined,
       CAST(coalesce(sum(total_rows - bad), 0) AS DOUBLE) AS clean, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS violations,
       count(*) FILTER (coalesce(total_rows, 0) <= 0) AS excluded,
       CAST(coalesce(sum(bad) FILTER (validation_type = 'Null Value Constraint'), 0) AS DOUBLE) AS null_violations,
       CAST(coalesce(sum(total_rows) FILTER (total_rows > 0 AND validation_type = 'Null Value Constraint'), 0) AS BIGINT) AS null_rows,
       count(*) FILTER (validation_type = 'Null Value Constraint') AS null_checks, max(run_started_at) AS last_run_at,
       {PCT.format(part="sum(total_rows - bad)", whole="sum(total_rows) FILTER (total_rows > 0)")} AS quality_pct,
       count(DISTINCT CASE WHEN mapping_name = '(deleted test layer)' THEN mapping_name ELSE CAST(mapping_id AS VARCHAR) END)
         AS layers_covered,
       count(DISTINCT run_id) AS runs_covered,
       (SELECT count(*) FROM runs WHERE mapping_id NOT IN (SELECT id FROM mappings)) AS orphaned_runs
FROM r
"""


@query("summary", f"WITH {scoped()} {SUMMARY}")
def summary(t: Tables) -> DataFrame:
    _, runs, mappings = frames(t)
    return r.summary(digested(t, h.Scope(basis="all")), runs, mappings)


@query("export_summary", f"""
WITH {scoped()}, s AS ({SUMMARY})
""" + " UNION ALL ".join(
    f"SELECT CAST({i + 1} AS INT) AS position, '{name}' AS measure, CAST(CAST({name} AS DECIMAL(38,2)) AS VARCHAR) AS value FROM s"
    for i, name in enumerate(r.FIGURES)
) + """
UNION ALL SELECT 14, 'basis', 'all' UNION ALL SELECT 15, 'since', NULL UNION ALL SELECT 16, 'layers', 'all'
""")
def export_summary(t: Tables) -> DataFrame:
    return r.export_tables(*frames(t), h.Scope(basis="all"))["summary"]


@query("export_checks", f"""
WITH {scoped(LATEST)}
SELECT mapping_name, test_name, rule_target, validation_type, status, violations, total_rows, run_started_at FROM r
""")
def export_checks(t: Tables) -> DataFrame:
    return r.export_tables(*frames(t), h.Scope())["checks"]


OFFENDERS = """
SELECT run_id, test_label, test_name, rule_target, validation_type, status, violations, total_rows, mapping_name,
       run_started_at, (SELECT count(*) FROM r WHERE violations > 0) AS offender_count
FROM r WHERE violations > 0 ORDER BY violations DESC, run_started_at, run_id, test_label, test_name, rule_target LIMIT 200
"""


@query("worst_offenders", f"WITH {scoped()} {OFFENDERS}")
def worst_offenders(t: Tables) -> DataFrame:
    return r.offenders(h.scoped_results(*frames(t), h.Scope(basis="all")))


@query("offenders_sorted", f"""
WITH {scoped()}
SELECT run_id, test_label, violations, total_rows FROM r WHERE violations > 0
ORDER BY total_rows DESC NULLS LAST, run_started_at, run_id, test_label, test_name, rule_target LIMIT 200
""")
def offenders_sorted(t: Tables) -> DataFrame:
    """The offenders with most rows among all offenders; unknown row counts come last."""
    scoped_rows = h.scoped_results(*frames(t), h.Scope(basis="all"))
    return r.offenders(scoped_rows, by="total_rows").select("run_id", "test_label", "violations", "total_rows")


TREND = f"""
SELECT runs.id AS run_id, runs.mapping_id, coalesce(m.name, '(deleted test layer)') AS mapping_name, started_at, status,
       pass_count, fail_count, total_checkpoints,
       {PCT.format(part="pass_count", whole="total_checkpoints")} AS pass_pct
FROM runs LEFT JOIN mappings m ON m.id = runs.mapping_id
"""


@query("trend", f"WITH {BASE} {TREND}")
def trend(t: Tables) -> DataFrame:
    _, runs, mappings = frames(t)
    return r.trend(runs, mappings, h.Scope())


@query("trend_daily", f"""
WITH {BASE}, x AS ({TREND})
SELECT CAST(started_at AS DATE) AS day, 'All layers' AS series,
       CASE WHEN sum(total_checkpoints) = 0 THEN NULL
            ELSE floor(sum(pass_count) * 100.0 / sum(total_checkpoints) + 0.5) END AS pct FROM x GROUP BY 1
""")
def trend_daily(t: Tables) -> DataFrame:
    _, runs, mappings = frames(t)
    return r.daily_trend(r.trend(runs, mappings, h.Scope()), pooled=True)


@query("trend_daily_layers", f"""
WITH {BASE}, x AS ({TREND} WHERE runs.mapping_id IN {FEW[:5]} AND m.id IS NOT NULL)
SELECT CAST(started_at AS DATE) AS day, mapping_name AS series,
       arg_max(pass_pct, (started_at, run_id)) AS pct FROM (SELECT * FROM x) GROUP BY 1, 2
""")
def trend_daily_layers(t: Tables) -> DataFrame:
    """Five layers: each keeps its own line."""
    _, runs, mappings = frames(t)
    return r.daily_trend(r.trend(runs, mappings, h.Scope(mapping_ids=FEW[:5])))


@query("run_pass_rate", f"""
WITH {BASE} SELECT id, CASE WHEN total_checkpoints = 0 THEN 0.0 ELSE round(pass_count * 100.0 / total_checkpoints, 1) END AS pass_rate
FROM runs
""")
def run_pass_rate(t: Tables) -> DataFrame:
    return r.run_pass_rate(t.sql(RUNS)).select("id", "pass_rate")


@query("row_pass_rate", f"""
WITH {BASE}, x AS (SELECT validation_type, CASE
    WHEN total_rows > 0 AND violations IS NOT NULL
      THEN greatest(0.0, least(100.0, (total_rows - violations) * 100.0 / total_rows))
    WHEN status = 'PASS' THEN 100.0 ELSE 0.0 END AS rate FROM results)
SELECT validation_type, count(*) AS n, round(min(rate), 6) AS low, round(max(rate), 6) AS high,
       count(*) FILTER (rate < 50) AS poor FROM x GROUP BY 1
""")
def row_pass_rate(t: Tables) -> DataFrame:
    rate = r.row_pass_rate(F.col("violations"), F.col("total_rows"), F.col("status"))
    return t.sql(RESULTS).select("validation_type", rate.alias("rate")).groupBy("validation_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("rate"), 6).alias("low"), F.round(F.max("rate"), 6).alias("high"),
        F.count_if(F.col("rate") < 50).alias("poor"),
    )


@query("orphan_runs", f"""
WITH {BASE} SELECT id, mapping_id, started_at FROM runs WHERE mapping_id NOT IN (SELECT id FROM mappings)
""")
def orphan_runs(t: Tables) -> DataFrame:
    return h.orphaned_runs(t.sql(RUNS), t.sql(MAPPINGS)).select("id", "mapping_id", "started_at")


@query("run_list", f"""
WITH {BASE} SELECT runs.id, runs.mapping_id, runs.suite_id, runs.started_at, runs.status, m.name AS mapping_name,
       s.name AS suite_name
FROM runs LEFT JOIN mappings m ON m.id = runs.mapping_id LEFT JOIN suites s ON s.id = runs.suite_id
""")
def run_list(t: Tables) -> DataFrame:
    return h.run_list(t.sql(RUNS), t.sql(MAPPINGS), t.sql(SUITES)).select(
        "id", "mapping_id", "suite_id", "started_at", "status", "mapping_name", "suite_name"
    )


@query("newest_runs", f"""
WITH {BASE} SELECT id, started_at, status FROM runs ORDER BY started_at DESC, id LIMIT 20
""")
def newest_runs(t: Tables) -> DataFrame:
    return h.newest(t.sql(RUNS), "started_at", 20, "id").select("id", "started_at", "status")


@query("latest_run_results", f"""
WITH {BASE} SELECT * FROM results WHERE run_id = (
  SELECT id FROM runs WHERE id IN (SELECT run_id FROM results) ORDER BY started_at DESC, id LIMIT 1)
""")
def latest_run_results(t: Tables) -> DataFrame:
    results = t.sql(RESULTS)
    ran = t.sql(RUNS).join(results.select(F.col("run_id").alias("id")), "id", "left_semi")
    return h.latest_run_results(ran, results)


@query("run_rollups", f"""
WITH {BASE} SELECT run_id, count(*) AS total_checkpoints, count(*) FILTER (status = 'PASS') AS pass_count,
       count(*) FILTER (status <> 'PASS') AS fail_count,
       CASE WHEN count(*) FILTER (status <> 'PASS') = 0 THEN 'passed' ELSE 'failed' END AS status
FROM results GROUP BY run_id
""")
def run_rollups(t: Tables) -> DataFrame:
    return h.roll_up(t.sql(RESULTS))


@query("retention", f"""
WITH {BASE}, kept AS (SELECT * FROM runs WHERE started_at >= TIMESTAMP '1999-01-01 00:00:00')
SELECT 'run' AS what, id, count(*) AS n FROM kept GROUP BY id
UNION ALL SELECT 'result', run_id, count(*) FROM results WHERE run_id IN (SELECT id FROM kept) GROUP BY run_id
""")
def retention(t: Tables) -> DataFrame:
    runs, results = h.prune(t.sql(RUNS), t.sql(RESULTS), CUTOFF)
    left = runs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("run").alias("what"), "id", "n")
    return left.unionByName(
        results.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("result").alias("what"), "id", "n")
    )


# --- suites and checks --------------------------------------------------------------------------

@query("suite_list", f"""
WITH {BASE} SELECT s.id, s.name, m.name AS mapping_name,
       (SELECT count(*) FROM members x WHERE x.suite_id = s.id) AS test_case_count
FROM suites s LEFT JOIN mappings m ON m.id = s.mapping_id
""")
def suite_list(t: Tables) -> DataFrame:
    return h.suite_list(t.sql(SUITES), t.sql(MEMBERS), t.sql(MAPPINGS)).select("id", "name", "mapping_name", "test_case_count")


@query("suite_cases", f"""
WITH {BASE} SELECT s.id AS suite_id, c.id AS test_case_id, c.name, x.position
FROM suites s JOIN members x ON x.suite_id = s.id JOIN cases c ON c.id = x.test_case_id WHERE c.active
""")
def suite_cases(t: Tables) -> DataFrame:
    return h.suite_cases(t.sql(SUITES), t.sql(MEMBERS), t.sql(CASES), active_only=True).select(
        "suite_id", "test_case_id", "name", "position"
    )


@query("check_labels", f"""
WITH {BASE}, x AS (SELECT m.suite_id, c.id AS test_case_id, m.position FROM members m JOIN cases c ON c.id = m.test_case_id
                   WHERE c.active)
SELECT suite_id, test_case_id, printf('TC-%03d', row_number() OVER (PARTITION BY suite_id ORDER BY position)) AS test_label FROM x
""")
def check_labels(t: Tables) -> DataFrame:
    """The active checks of every suite, labelled by position."""
    members = h.suite_cases(t.sql(SUITES), t.sql(MEMBERS), t.sql(CASES), active_only=True, ordered=False)
    return h.labelled(members, block=500).select("suite_id", "test_case_id", "test_label")


@query("table_usage", """
SELECT table_name, count(*) AS checks FROM (
  SELECT p_partkey, p_brand AS table_name FROM part UNION SELECT p_partkey, p_type FROM part
  UNION SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0) GROUP BY table_name
""")
def table_usage(t: Tables) -> DataFrame:
    """Parts as checks that name their brand, their type and sometimes their name, some twice."""
    cases = t.part.select(
        F.array("p_brand", "p_type").alias("target_tables"), F.array("p_type").alias("source_tables"),
        F.when(F.col("p_partkey") % 3 == 0, F.array("p_name", "p_brand")).alias("destination_tables"),
    )
    return h.table_usage(cases, ["target_tables", "source_tables", "destination_tables"])


@query("mappings_of_source", f"""
WITH {BASE} SELECT m.id, m.name, (SELECT count(*) FROM cases c WHERE c.mapping_id = m.id) AS test_case_count,
       (SELECT count(*) FROM suites s WHERE s.mapping_id = m.id) AS suite_count
FROM mappings m WHERE source_connector_id = 7 OR destination_connector_id = 7
""")
def mappings_of_source(t: Tables) -> DataFrame:
    return h.mappings_of_source(t.sql(MAPPINGS), t.sql(CASES), t.sql(SUITES), 7)


@query("cascade_delete", f"""
WITH {BASE}, gone AS (SELECT c_custkey AS mapping_id FROM customer WHERE c_custkey % 11 = 0),
lost AS (SELECT id FROM suites WHERE mapping_id IN (SELECT mapping_id FROM gone))
SELECT 'mappings' AS what, id FROM mappings WHERE id NOT IN (SELECT mapping_id FROM gone)
UNION ALL SELECT 'cases', id FROM cases WHERE mapping_id NOT IN (SELECT mapping_id FROM gone)
UNION ALL SELECT 'suites', id FROM suites WHERE mapping_id NOT IN (SELECT mapping_id FROM gone)
UNION ALL SELECT 'members', test_case_id FROM members WHERE suite_id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'schedules', suite_id FROM schedules WHERE suite_id NOT IN (SELECT id FROM lost)
""")
def cascade_delete(t: Tables) -> DataFrame:
    tables = {
        "mappings": t.sql(MAPPINGS), "cases": t.sql(CASES), "suites": t.sql(SUITES), "members": t.sql(MEMBERS),
        "schedules": t.sql(SCHEDULES),
    }
    ids = {"mappings": "id", "cases": "id", "suites": "id", "members": "test_case_id", "schedules": "suite_id"}
    deleted = t.customer.filter("c_custkey % 11 = 0").select(F.col("c_custkey").alias("mapping_id"))
    left = h.cascade_delete(tables, deleted)
    parts = [df.select(F.lit(name).alias("what"), F.col(ids[name]).alias("id")) for name, df in left.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("repointed_mapping", f"""
WITH {BASE}, gone AS (SELECT c_custkey AS mapping_id FROM customer WHERE c_custkey % 13 = 0),
lost AS (SELECT id FROM cases WHERE mapping_id IN (SELECT mapping_id FROM gone))
SELECT 'cases' AS what, id FROM cases WHERE id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'members', test_case_id FROM members WHERE test_case_id NOT IN (SELECT id FROM lost)
""")
def repointed_mapping(t: Tables) -> DataFrame:
    gone = t.customer.filter("c_custkey % 13 = 0").select(F.col("c_custkey").alias("mapping_id"))
    cases, members = h.clear_cases(t.sql(CASES), t.sql(MEMBERS), gone)
    return cases.select(F.lit("cases").alias("what"), "id").unionByName(
        members.select(F.lit("members").alias("what"), F.col("test_case_id").alias("id"))
    )


# --- from stored sums ---------------------------------------------------------------------------------------

def stored_sums(t: Tables) -> str:
    """The history in two arrivals, the second of which brings some runs again, with its sums per day."""
    results, runs, _ = frames(t)
    path = scratch_dir(t.spark, "history")
    for part in ("id % 3 <> 0", "id % 3 <> 1"):
        own = runs.where(part)
        dg.append_runs(own, results.join(own.select(F.col("id").alias("run_id")), "run_id", "left_semi"), path)
    return path


@query("by_type_stored", f"WITH {scoped()} {BY_TYPE}")
def by_type_stored(t: Tables) -> DataFrame:
    return r.by_type(dg.read_sums(t.spark, stored_sums(t), t.sql(MAPPINGS), h.Scope(basis="all")).checks)


@query("by_layer_stored", f"""
WITH {scoped("started_at >= TIMESTAMP '2001-05-04 00:00:00'")} {BY_LAYER}
""")
def by_layer_stored(t: Tables) -> DataFrame:
    """The last three months: sums of whole days, and of the day the window begins in single results."""
    scope = h.Scope(basis="all", window="3m", as_of=AS_OF)
    return r.by_layer(dg.read_sums(t.spark, stored_sums(t), t.sql(MAPPINGS), scope).checks)


@query("summary_stored", f"""
WITH {scoped("started_at >= TIMESTAMP '1999-01-01 00:00:00'").replace("runs AS (", "every_run AS (").replace(
    "suites AS (", "runs AS (SELECT * FROM every_run WHERE started_at >= TIMESTAMP '1999-01-01 00:00:00'), suites AS (", 1)} {SUMMARY}
""")
def summary_stored(t: Tables) -> DataFrame:
    """After retention has dropped what is older than 1999; deleted mappings show in the names alone."""
    kept = scratch_dir(t.spark, "kept")
    dg.prune_runs(t.spark, stored_sums(t), kept, CUTOFF, days=0)
    mappings = t.sql(MAPPINGS)
    sums = dg.read_sums(t.spark, kept, mappings, h.Scope(basis="all"))
    return dg.summary_of_days(sums, mappings)
