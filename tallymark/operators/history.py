"""Stored runs and results: appending, scoping, pruning and listing them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark import model

# The windows on offer, in days, and how a deleted mapping is shown.
RANGES = {"1m": 30, "3m": 90, "6m": 180, "1y": 365, "all": None}
DELETED = "(deleted test layer)"
RETENTION_DAYS = 20


@dataclass(frozen=True)
class Scope:
    """Which part of the history a report is about.

    ``mapping_ids``: a few ids, or a table with a column ``mapping_id`` of any length.
    """

    mapping_ids: Sequence | DataFrame | None = None
    basis: str = "latest"
    window: str = "all"
    as_of: datetime | None = None

    def __post_init__(self) -> None:
        if self.basis not in ("latest", "all"):
            raise ValueError("basis must be 'latest' or 'all'")
        if self.window not in RANGES:
            raise ValueError(f"window must be one of {', '.join(RANGES)}")
        if RANGES[self.window] is not None and self.as_of is None:
            raise ValueError("a time window needs an as_of moment")

    @property
    def since(self) -> datetime | None:
        days = RANGES[self.window]
        return None if days is None else self.as_of - timedelta(days=days)


def moment(df: DataFrame, column: str, value: datetime) -> Column:
    return F.lit(value).cast(df.schema[column].dataType)


def in_window(runs: DataFrame, scope: Scope) -> DataFrame:
    runs = of_mappings(runs, scope)
    if scope.since is not None:
        runs = since_day(runs, scope).filter(F.col("started_at") >= moment(runs, "started_at", scope.since))
    return runs


def of_mappings(df: DataFrame, scope: Scope) -> DataFrame:
    if scope.mapping_ids is None:
        return df
    if isinstance(scope.mapping_ids, DataFrame):
        return df.join(scope.mapping_ids.select("mapping_id").distinct(), "mapping_id", "left_semi")
    return df.filter(F.col("mapping_id").isin(list(scope.mapping_ids)))


def since_day(df: DataFrame, scope: Scope) -> DataFrame:
    """Stored tables are partitioned by ``run_date``: days before the window are not read."""
    if scope.since is None or "run_date" not in df.columns:
        return df
    return df.filter(F.col("run_date") >= F.lit(scope.since.date()))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each mapping's newest runs, ties kept: a grouped maximum joined back.

    The maximum is combined on the map side, so a mapping with most of the runs is no
    bigger a group than any other, as it would be in a window.
    """
    newest = runs.groupBy("mapping_id").agg(F.max("started_at").alias("started_at"))
    return runs.join(newest, ["mapping_id", "started_at"], "left_semi")


def with_names(runs: DataFrame, mappings: DataFrame, keep_deleted: bool) -> DataFrame:
    names = mappings.select(F.col("id").alias("mapping_id"), F.col("name").alias("mapping_name"))
    joined = runs.join(names, "mapping_id", "left" if keep_deleted else "inner")
    return joined.withColumn("mapping_name", F.coalesce("mapping_name", F.lit(DELETED)))


def scoped_runs(
    runs: DataFrame, mappings: DataFrame, scope: Scope, basis: str | None = None, named: bool = True
) -> DataFrame:
    """Runs in scope with ``mapping_name``; runs of deleted mappings only without a filter.

    Without a filter every run is kept whether its mapping is there or not, so ``named=False`` spares the join.
    """
    chosen = in_window(runs, scope)
    if (basis or scope.basis) == "latest":
        chosen = latest_runs(chosen)
    if not named and scope.mapping_ids is None:
        return chosen.withColumn("mapping_name", F.lit(None).cast("string"))
    return with_names(chosen, mappings, keep_deleted=scope.mapping_ids is None)


def scoped_results(results: DataFrame, runs: DataFrame, mappings: DataFrame, scope: Scope, named: bool = True) -> DataFrame:
    """Result rows in scope with their run and mapping; stored results of earlier days are not read."""
    chosen = scoped_runs(runs, mappings, scope, named=named).select(
        F.col("id").alias("run_id"), "mapping_id", "mapping_name", F.col("started_at").alias("run_started_at"),
    )
    return since_day(results, scope).join(chosen, "run_id")


def roll_up(results: DataFrame) -> DataFrame:
    """One row per run; anything that is not a PASS counts as failed."""
    passed = F.count_if(F.col("status") == "PASS")
    total = F.count(F.lit(1))
    return results.groupBy("run_id").agg(
        total.alias("total_checkpoints"), passed.alias("pass_count"), (total - passed).alias("fail_count"),
        F.when(total == passed, F.lit("passed")).otherwise(F.lit("failed")).alias("status"),
    )


def orphaned_runs(runs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Runs whose mapping is gone."""
    return runs.join(mappings.select(F.col("id").alias("mapping_id")), "mapping_id", "left_anti")


def run_list(runs: DataFrame, mappings: DataFrame, suites: DataFrame, mapping_id: object = None) -> DataFrame:
    """Every run with the names of its mapping and suite, newest first."""
    if mapping_id is not None:
        runs = runs.filter(F.col("mapping_id") == F.lit(mapping_id))
    names = mappings.select(F.col("id").alias("mapping_id"), F.col("name").alias("mapping_name"))
    suite_names = suites.select(F.col("id").alias("suite_id"), F.col("name").alias("suite_name"))
    return (
        runs.join(names, "mapping_id", "left").join(suite_names, "suite_id", "left")
        .orderBy(F.col("started_at").desc(), F.col("id"))
    )


def newest(df: DataFrame, moment: str, n: int, *ties: str) -> DataFrame:
    """The n newest rows; ties in the order of the given columns."""
    return df.orderBy(F.col(moment).desc_nulls_last(), *(F.col(t).asc_nulls_last() for t in ties)).limit(n)


def latest_run_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The results of the newest run, in label order."""
    last = newest(runs, "started_at", 1, "id").select(F.col("id").alias("run_id"))
    return results.join(F.broadcast(last), "run_id", "left_semi").orderBy("test_label")


def run_detail(runs: DataFrame, results: DataFrame, run_id: object) -> DataFrame:
    """One run's results next to the run itself, in label order."""
    header = runs.filter(F.col("id") == F.lit(run_id)).select(
        F.col("id").alias("run_id"), "mapping_id", F.col("status").alias("run_status"), "started_at",
    )
    return header.join(results.filter(F.col("run_id") == F.lit(run_id)), "run_id", "left").orderBy("test_label")


# --- suites and checks ----------------------------------------------------------------------

def suite_list(suites: DataFrame, members: DataFrame, mappings: DataFrame) -> DataFrame:
    """Suites with the name of their mapping and how many checks they hold."""
    counts = members.groupBy("suite_id").agg(F.count(F.lit(1)).alias("test_case_count"))
    names = mappings.select(F.col("id").alias("mapping_id"), F.col("name").alias("mapping_name"))
    return (
        suites.join(counts, suites["id"] == counts["suite_id"], "left").drop("suite_id")
        .join(names, "mapping_id", "left")
        .withColumn("test_case_count", F.coalesce("test_case_count", F.lit(0)))
    )


def suite_cases(
    suites: DataFrame, members: DataFrame, cases: DataFrame, active_only: bool = False, ordered: bool = True
) -> DataFrame:
    """The checks of every suite, in position order unless what comes next orders them anyway."""
    cases = cases.filter("active") if active_only else cases
    found = (
        suites.select(F.col("id").alias("suite_id"))
        .join(members, "suite_id")
        .join(cases.withColumnRenamed("id", "test_case_id"), "test_case_id")
    )
    return found.orderBy("suite_id", "position") if ordered else found


def labelled(cases: DataFrame, block: int = 10_000) -> DataFrame:
    """Checks of a suite with their label ``TC-001``, ... by position.

    Positions are counted from 0 within a suite. Ranks are taken inside blocks of positions
    and moved up by the size of the blocks before, so no suite is ranked in one task.
    """
    blocked = cases.withColumn("block", F.floor(F.col("position") / block))
    sizes = blocked.groupBy("suite_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("suite_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("suite_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("suite_id", "block").orderBy("position"))
    ranked = blocked.withColumn("inside", inside).join(offsets, ["suite_id", "block"])
    label = F.format_string("TC-%03d", F.col("offset") + F.col("inside"))
    return ranked.withColumn("test_label", label).drop("block", "inside", "offset")


def cascade_delete(tables: Mapping[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """What is left of mappings, cases, suites, members and schedules; run history stays.

    ``deleted`` has one column, ``mapping_id``.
    """
    gone = deleted.select("mapping_id").distinct()
    lost = tables["suites"].join(gone, "mapping_id", "left_semi").select(F.col("id").alias("suite_id"))
    return {
        "mappings": tables["mappings"].join(gone, tables["mappings"]["id"] == gone["mapping_id"], "left_anti"),
        "cases": tables["cases"].join(gone, "mapping_id", "left_anti"),
        "suites": tables["suites"].join(gone, "mapping_id", "left_anti"),
        "members": tables["members"].join(lost, "suite_id", "left_anti"),
        "schedules": tables["schedules"].join(lost, "suite_id", "left_anti"),
    }


def clear_cases(cases: DataFrame, members: DataFrame, mapping_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A re-pointed mapping loses its checks; its suites stay, emptied."""
    gone = mapping_ids.select("mapping_id").distinct()
    lost = cases.join(gone, "mapping_id", "left_semi").select(F.col("id").alias("test_case_id"))
    return cases.join(gone, "mapping_id", "left_anti"), members.join(lost, "test_case_id", "left_anti")


def table_usage(cases: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many checks name each table; a check counts once however often it names it.

    ``columns`` are arrays of table names.
    """
    empty = F.array().cast("array<string>")
    named = F.array_distinct(F.concat(*(F.coalesce(F.col(name), empty) for name in columns)))
    return (
        cases.select(F.explode(named).alias("table_name")).filter("table_name is not null and table_name <> ''")
        .groupBy("table_name").agg(F.count(F.lit(1)).alias("checks"))
    )


def mappings_of_source(mappings: DataFrame, cases: DataFrame, suites: DataFrame, connector: object) -> DataFrame:
    """Mappings that read or write a source, with the checks and suites each holds."""
    using = mappings.filter(
        (F.col("source_connector_id") == F.lit(connector)) | (F.col("destination_connector_id") == F.lit(connector))
    )

    def held(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("mapping_id").alias("id")).agg(F.count(F.lit(1)).alias(name))

    return (
        using.select("id", "name")
        .join(held(cases, "test_case_count"), "id", "left").join(held(suites, "suite_count"), "id", "left")
        .fillna(0, ["test_case_count", "suite_count"]).orderBy("name")
    )


# --- storage --------------------------------------------------------------------------------

def append_history(runs: DataFrame, results: DataFrame, path: str) -> None:
    """Add runs to the stored history, partitioned by the day they started and by run.

    A run's folders are overwritten, so appending it again after a failure doubles nothing; results come
    first, and a run is only there once its results are.
    """
    day = F.to_date("started_at")
    stamped = results.join(
        runs.select(F.col("id").alias("run_id"), day.alias("run_date")), "run_id"
    ).select(*results.columns, "run_date")
    for name, rows, run in (("results", stamped, "run_id"), ("runs", runs.withColumn("run_date", day), "id")):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", run).parquet(f"{path}/{name}")


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    def table(name: str, schema) -> DataFrame:
        return spark.read.schema(schema.add("run_date", "date")).parquet(f"{path}/{name}")

    fresh = lambda s: type(s)(list(s.fields))  # noqa: E731 - add() changes the schema in place
    return table("runs", fresh(model.RUN_SCHEMA)), table("results", fresh(model.RESULT_SCHEMA))


def prune(runs: DataFrame, results: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """Runs started before the cutoff go, with their results."""
    old = runs.filter(F.col("started_at") < moment(runs, "started_at", cutoff)).select(F.col("id").alias("run_id"))
    kept = runs.filter(~F.coalesce(F.col("started_at") < moment(runs, "started_at", cutoff), F.lit(False)))
    return kept, results.join(old, "run_id", "left_anti")


def prune_stored(spark: SparkSession, path: str, target: str, as_of: datetime, days: int = RETENTION_DAYS) -> None:
    """Write what retention keeps to ``target``; the old folder is untouched.

    Whole days before the cutoff are never read: the day is the partition.
    """
    cutoff = as_of - timedelta(days=days)
    runs, results = read_history(spark, path)
    recent = F.col("run_date") >= F.lit(cutoff.date())
    runs, results = prune(runs.filter(recent), results.filter(recent), cutoff)
    results.write.partitionBy("run_date").parquet(f"{target}/results")
    runs.write.partitionBy("run_date").parquet(f"{target}/runs")
