"""Keys that repeat anywhere in a stream, and rows that come too late to be counted.

What a batch holds does not matter to either: repeats meet in keyed state that expires with the watermark, and arrivals are counted
before the watermark takes anything away.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymark import model
from tallymark.functions.columns import c
from tallymark.operators.verdicts import verdict


def repeated_keys(stream: DataFrame, keys: Sequence[str], moment: str, within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Occurrences of a key that follow each other by less than ``within``: the key, first_seen, last_seen, rows and repeats.

    State is one row per key seen during the last ``within`` plus ``late``; a group is given once, when the watermark has passed it, so
    it comes out the same however the stream is cut into batches. Rows with a null in the key are no repeats. Works on
    tables alike.
    """
    timed = stream.where(reduce(and_, (c(k).isNotNull() for k in keys))).withColumn("__at", F.col(moment).cast("timestamp")).withWatermark("__at", late)
    groups = timed.groupBy(F.session_window("__at", within).alias("__w"), *(c(k) for k in keys)).agg(
        F.count(F.lit(1)).alias("rows"), F.min("__at").alias("first_seen"), F.max("__at").alias("last_seen"))
    return groups.where("rows > 1").select(
        *(c(k) for k in keys), F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "rows", (F.col("rows") - 1).alias("repeats"))


def uniqueness_verdict(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One verdict over the repeats written so far."""
    totals = found.agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("repeats"), F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    details = F.concat(F.col("repeats").cast("string"), F.lit(f" rows repeat a {', '.join(keys)} of {model.UNIQUENESS.lower()} seen before, in "),
                       F.col("groups").cast("string"), F.lit(" groups"))
    return totals.select(*verdict(F.col("repeats") == 0, F.col("repeats"), F.col("rows"), details))


# ---- late rows -----------------------------------------------------------------------------------


def write_arrivals(stream: DataFrame, moment: str, target: str, checkpoint: str, size: str = "1 day", by: Sequence[str] = (), name: str = "arrivals") -> StreamingQuery:
    """Rows that arrive for each window, whenever they arrive: a few rows a batch, before any watermark.

    A batch that is run again overwrites its own folder.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy(F.window(F.col(moment).cast("timestamp"), size).alias("w"), *(c(n) for n in by)).agg(
            F.count(F.lit(1)).alias("arrived"), F.max(F.col(moment).cast("timestamp")).alias("newest"))
        counted.select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *by, "arrived",
            F.col("newest").cast("timestamp_ntz").alias("newest"),
        ).coalesce(1).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(on_batch).start()
    )


def left_out(windows: DataFrame, arrivals: DataFrame, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """Per closed window the rows that arrived, those that were counted, and those that came behind the watermark.

    ``windows`` are the closed windows as written (``rows`` counted), ``arrivals`` what :func:`write_arrivals` wrote. A window all of whose
    rows came late is closed too, with nothing counted; windows that are still open are not listed.
    """
    keys = ["window_start", *by]
    totals = arrivals.groupBy("window_start", "window_end", *by).agg(F.sum("arrived").alias("arrived"))
    watermark = arrivals.agg((F.max("newest") - F.expr(f"INTERVAL {late}")).alias("watermark")).scalar()
    counted = windows.select(*(c(k).alias(f"__{k}") for k in keys), F.col("rows").alias("counted"))
    same = reduce(and_, (c(k).eqNullSafe(c(f"__{k}")) for k in keys))
    closed = totals.join(counted, same, "left").where(F.col("counted").isNotNull() | (F.col("window_end") <= watermark))
    seen = F.coalesce("counted", F.lit(0))
    return closed.select(*(c(k) for k in keys), "arrived", seen.alias("counted"), (F.col("arrived") - seen).alias("left_out"))
