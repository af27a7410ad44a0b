"""Sums of the run history per day, stored beside it, so that reports over all runs read no single result.

Two tables, partitioned by the month the runs started: ``checks`` with a row for each day, mapping and validation type, in the form in which reports sum
them further, and ``runs`` with a row for each day and mapping. A month's sums are made again from its results whenever runs are
appended to it, so a run that is appended twice counts once; retention drops months and makes the one it cuts through again. Names of
mappings are not stored: a mapping that is deleted is a deleted one in the next report.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark import model
from tallymark.functions.text import pass_pct
from tallymark.operators.history import DELETED, RETENTION_DAYS, Scope, moment, of_mappings, orphaned_runs, with_names
from tallymark.operators.reports import CLEAN_SUMS, digest_sums
from tallymark.operators.verdicts import together
from tallymark.session import scratch_dir

@dataclass(frozen=True)
class DaySums:
    """The two tables, each with ``run_date`` and ``month``; both may be stored or made on the spot."""

    checks: DataFrame
    runs: DataFrame

    def where(self, condition) -> DaySums:
        return DaySums(self.checks.where(condition), self.runs.where(condition))

    def union(self, other: DaySums) -> DaySums:
        return DaySums(self.checks.unionByName(other.checks), self.runs.unionByName(other.runs))


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def day_sums(results: DataFrame, runs: DataFrame) -> DaySums:
    """Sums of results and runs (both with ``run_date``) per day and mapping."""
    of_run = runs.select(F.col("id").alias("run_id"), "run_date", "mapping_id", F.col("started_at").alias("run_started_at"))
    joined = results.drop("run_date").join(of_run, "run_id")
    checks = joined.groupBy("run_date", "mapping_id", "validation_type").agg(F.max("run_started_at").alias("run_started_at"), *digest_sums())
    with_results = results.select("run_id").distinct().withColumn("held", F.lit(1))
    counted = of_run.join(with_results, "run_id", "left").groupBy("run_date", "mapping_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count("held").alias("covered"), F.max(F.when(F.col("held") == 1, F.col("run_started_at"))).alias("last_run_at"))
    return DaySums(checks.withColumn("month", month_of(F.col("run_date"))), counted.withColumn("month", month_of(F.col("run_date"))))


def _stored(spark: SparkSession, path: str, name: str, months: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}").withColumn("month", F.col("month").cast("string"))
    return df if months is None else df.where(F.col("month").isin(list(months)))


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def refresh_months(spark: SparkSession, path: str, months: Iterable[str] | None = None) -> None:
    """Make the sums of some months (all where none are named) again from the history stored under ``path``; no other month is read or written."""
    made = day_sums(_stored(spark, path, "results", months), _stored(spark, path, "runs", months))
    _write(made.checks, f"{path}/day_sums/checks")
    _write(made.runs, f"{path}/day_sums/runs")


def append_runs(runs: DataFrame, results: DataFrame, path: str) -> list[str]:
    """Append runs with their results and bring the sums of their months up to date; gives the months.

    Rows of the same runs that are there already are replaced. The months of the new runs are rewritten, a bounded part of the history.
    """
    spark = runs.sparkSession
    stamped = runs.withColumn("run_date", F.to_date("started_at")).withColumn("month", month_of(F.col("started_at")))
    months = sorted(r.month for r in stamped.select("month").distinct().collect())
    of_day = stamped.select(F.col("id").alias("run_id"), "run_date", "month")
    new = {"results": results.join(of_day, "run_id").select(*results.columns, "run_date", "month"), "runs": stamped}
    known = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/runs")
    there = known.getFileSystem(spark._jsc.hadoopConfiguration()).exists(known)
    for name, key in (("results", "run_id"), ("runs", "id")):
        rows = new[name]
        if there:  # the months read are those written, so what stays of them is written elsewhere first
            kept, aside = _stored(spark, path, name, months).join(of_day.select(F.col("run_id").alias(key)), key, "left_anti"), scratch_dir(spark, name)
            kept.select(rows.columns).write.parquet(aside)
            rows = rows.unionByName(spark.read.schema(kept.select(rows.columns).schema).parquet(aside))
        _write(rows, f"{path}/{name}")
    refresh_months(spark, path, months)
    return months


def read_sums(spark: SparkSession, path: str, mappings: DataFrame, scope: Scope) -> DaySums:
    """The stored sums of the scope with ``mapping_name``: what ``by_type``, ``by_layer``, ``status_counts`` and ``null_summary`` sum further.

    Days after the scope's first are read as sums; of the first, which the window may cut, the single results are. Only scopes over all
    runs can be read from sums.
    """
    if scope.basis != "all":
        raise ValueError("sums per day are over all runs; the latest runs are read from the history")
    sums = DaySums(*(_stored(spark, path, f"day_sums/{n}") for n in ("checks", "runs")))
    if scope.since is not None:
        day, month = F.lit(scope.since.date()), scope.since.strftime("%Y-%m")
        runs, results = (_stored(spark, path, n, [month]).where(F.col("run_date") == day) for n in ("runs", "results"))
        cut = day_sums(results, runs.where(F.col("started_at") >= moment(runs, "started_at", scope.since)))
        sums = sums.where((F.col("month") >= month) & (F.col("run_date") > day)).union(cut)
    sums = DaySums(of_mappings(sums.checks, scope), of_mappings(sums.runs, scope))
    deleted = scope.mapping_ids is None
    return DaySums(with_names(sums.checks, mappings, deleted), with_names(sums.runs, mappings, deleted))


def summary_of_days(sums: DaySums, mappings: DataFrame, every_run: DataFrame | None = None) -> DataFrame:
    """The headline figures of :func:`reports.summary` from sums per day. ``every_run``: the stored ``runs`` sums, for orphans outside the scope."""
    nulls = F.col("validation_type") == model.NULLS
    total = lambda value, name: F.coalesce(F.sum(value), F.lit(0)).alias(name)
    checks = sums.checks.agg(
        *(total(F.col(n), n) for n in ("n_pass", "n_fail", "n_error", *CLEAN_SUMS)),
        *(total(F.when(nulls, F.col(of)), n) for n, of in (("null_violations", "violations"), ("null_rows", "examined"), ("null_checks", "checks"))))
    layer = F.when(F.col("mapping_name") == DELETED, F.lit(DELETED)).otherwise(F.col("mapping_id").cast("string"))
    layers = sums.runs.where("covered > 0").groupBy(layer.alias("layer")).agg(F.sum("covered").alias("covered"), F.max("last_run_at").alias("last_run_at"))
    runs = layers.agg(F.max("last_run_at").alias("last_run_at"), F.count(F.lit(1)).alias("layers_covered"), total(F.col("covered"), "runs_covered"))
    orphans = orphaned_runs(every_run if every_run is not None else sums.runs, mappings).agg(total(F.col("runs"), "orphaned_runs"))
    pair = together(checks=checks, runs=runs, orphans=orphans)
    return pair.select("checks.*", "runs.*", pass_pct(F.col("checks.clean"), F.col("checks.examined")).alias("quality_pct"), "orphans.orphaned_runs")


def prune_runs(spark: SparkSession, path: str, target: str, as_of: datetime, days: int = RETENTION_DAYS) -> None:
    """Write history and sums without runs before the cutoff to ``target``: later months' sums are copied, the month of the cutoff is summed again."""
    cutoff = as_of - timedelta(days=days)
    month = cutoff.strftime("%Y-%m")
    runs, results = (_stored(spark, path, n).where(F.col("month") >= month) for n in ("runs", "results"))
    old = runs.where((F.col("month") == month) & (F.col("started_at") < moment(runs, "started_at", cutoff))).select(F.col("id").alias("run_id"))
    later, cut = results.where(F.col("month") > month), results.where(F.col("month") == month).join(old, "run_id", "left_anti")
    _write(runs.where(F.col("started_at") >= moment(runs, "started_at", cutoff)), f"{target}/runs")
    _write(later.unionByName(cut.select(later.columns)), f"{target}/results")
    for name in ("checks", "runs"):
        _write(_stored(spark, path, f"day_sums/{name}").where(F.col("month") > month), f"{target}/day_sums/{name}")
    refresh_months(spark, target, [month])
