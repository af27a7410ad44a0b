"""The same checks on every micro-batch, with one result folder per batch.

A verdict depends on the rows of its batch alone, never on how the stream was cut: the keys of a
batch have to be known to the static table, while keys that have not arrived yet are no defect.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymark import model
from tallymark.operators.rules import Rule, check_rows, referential
from tallymark.operators.sides import stack

BATCH_COLUMNS = ("run_id", "rule", "validation_type", "status", "violations", "total_rows", "details")


def check_batch(batch: DataFrame, run_id: str, rules: Sequence[Rule], static: DataFrame | None, key: str | None) -> DataFrame:
    """All rules in one scan of the batch, and its rows whose key the static table does not know."""
    arms = []
    if rules:
        arms.append(check_rows(batch, rules).drop("position"))
    if static is not None and key:
        found = referential(batch, key, static, key)
        arms.append(found.select(
            F.lit(f"{key} known").alias("rule"), F.lit(model.REFERENTIAL).alias("validation_type"), "*"
        ))
    return stack(arms).select(F.lit(run_id).alias("run_id"), "rule", "validation_type", "status", "violations",
                              "total_rows", "details")


def check_stream(
    stream: DataFrame, rules: Callable[[DataFrame], Sequence[Rule]] | Sequence[Rule], target: str, checkpoint: str,
    name: str = "checks", static: DataFrame | None = None, key: str | None = None,
) -> StreamingQuery:
    """Check what has arrived, batch by batch, into ``target``.

    A batch that is run again after a failure overwrites its own folder, so results never
    repeat.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            made = rules(batch) if callable(rules) else rules
            results = check_batch(batch, f"{name}-{batch_id}", made, static, key)
            results.coalesce(1).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(on_batch).start()
    )


def read_results(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)
