"""Running quality per event-time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_quality(
    stream: DataFrame, moment: str, bad: Column, size: str = "1 day", late: str = "1 hour", by: tuple[str, ...] = ()
) -> DataFrame:
    """Rows and rows that break the rule per tumbling window, and the share that passes.

    Works on streams and on tables alike; on a stream, rows later than ``late`` are dropped.
    """
    timed = stream.withColumn("__at", F.col(moment).cast("timestamp")).withWatermark("__at", late)
    counted = timed.groupBy(F.window("__at", size).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("violations"),
    )
    clean = F.col("rows") - F.col("violations")
    return counted.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "rows", "violations",
        F.round(clean * 100.0 / F.col("rows"), 2).alias("quality_pct"),
    )


def write_windows(windows: DataFrame, target: str, checkpoint: str, name: str = "windows") -> StreamingQuery:
    """Closed windows, each written once."""
    return (
        windows.writeStream.queryName(name).outputMode("append").format("parquet")
        .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
