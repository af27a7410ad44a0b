from pyspark.sql import functions as F

from tallymark.operators import rules
from tallymark.streaming.checks import check_batch, check_stream, read_results
from tallymark.streaming.uniqueness import left_out, repeated_keys, uniqueness_verdict, write_arrivals
from tallymark.streaming.windows import windowed_quality, write_windows


def source(spark, folder):
    return spark.readStream.schema("id bigint, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(folder)


def rows(spark, low, high, day):
    return spark.range(low, high).select("id", F.expr(f"timestamp_ntz'2024-01-0{day} 12:00:00'").alias("ts"))


def test_each_batch_is_checked_once(spark, tmp_path):
    folder, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    made = [rules.in_range("id", None, 14)]
    for low, day in ((0, 1), (10, 2)):
        rows(spark, low, low + 10, day).coalesce(1).write.mode("append").parquet(folder)
        check_stream(source(spark, folder), made, target, checkpoint, static=spark.range(18), key="id").awaitTermination()
    got = {(r.batch_id, r.rule): (r.run_id, r.status, r.violations, r.total_rows) for r in read_results(spark, target).collect()}
    assert got == {
        (0, "id in range"): ("checks-0", "PASS", 0.0, 10), (0, "id known"): ("checks-0", "PASS", 0.0, 10),
        (1, "id in range"): ("checks-1", "FAIL", 5.0, 10), (1, "id known"): ("checks-1", "FAIL", 2.0, 10),
    }
    again = check_batch(rows(spark, 10, 20, 2), "checks-1", made, spark.range(18), "id")
    again.write.mode("overwrite").parquet(f"{target}/batch_id=1")
    assert read_results(spark, target).count() == 4


def test_verdicts_do_not_depend_on_the_batches(spark):
    one = check_batch(spark.range(1, 9), "r", [], spark.range(1, 9), "id").first()
    two = [check_batch(spark.range(a, a + 4), "r", [], spark.range(1, 9), "id").first() for a in (1, 5)]
    assert one.status == "PASS" and [r.status for r in two] == ["PASS", "PASS"]


def test_closed_windows_are_written_once(spark, tmp_path):
    folder, target, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for day in (1, 2, 3):
        rows(spark, 0, day * 2, day).coalesce(1).write.mode("append").parquet(folder)
        windows = windowed_quality(source(spark, folder), "ts", F.col("id") == 0)
        write_windows(windows, target, checkpoint).awaitTermination()
    got = sorted((r.window_start.day, r.rows, r.violations, r.quality_pct) for r in spark.read.schema(windows.schema).parquet(target).collect())
    assert got == [(1, 2, 1, 50.0), (2, 4, 1, 75.0)]


def keyed(spark, values):
    return spark.createDataFrame(values, "k string, at int").select("k", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, at)").alias("ts"))


KEYED = [("a", 0), ("a", 5), ("b", 7), ("a", 50), (None, 51), (None, 52), ("b", 90), ("a", 95), ("a", 96), ("a", 97), ("c", 400), ("d", 401)]


def test_repeats_do_not_depend_on_the_batches(spark, tmp_path):
    """One to five arrivals give the same groups; a key seen again after its state has expired is new."""
    results = []
    for n, cuts in enumerate(([400], [6, 50, 95, 99, 400], [0, 51, 96, 400])):
        folder, target, checkpoint = (str(tmp_path / f"{p}{n}") for p in ("in", "out", "cp"))
        for low, high in zip([-1, *cuts[:-1]], [*cuts[:-1], 999]):
            keyed(spark, [v for v in KEYED if low < v[1] <= high]).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema("k string, ts timestamp_ntz").parquet(folder)
            found = repeated_keys(stream, ["k"], "ts", within="20 minutes", late="1 minute")
            write_windows(found, target, checkpoint, f"repeats{n}").awaitTermination()
        results.append(sorted((r.k, r.first_seen.minute, r.rows, r.repeats) for r in spark.read.schema(found.schema).parquet(target).collect()))
    assert results == [[("a", 0, 2, 1), ("a", 35, 3, 2)]] * 3
    table = repeated_keys(keyed(spark, KEYED), ["k"], "ts", within="20 minutes")
    assert sorted((r.k, r.rows) for r in table.collect()) == [("a", 2), ("a", 3)]
    assert [(r.status, r.violations, r.total_rows) for r in uniqueness_verdict(table, ["k"]).collect()] == [("FAIL", 3.0, 5)]
    assert uniqueness_verdict(table.where("rows > 9"), ["k"]).first().status == "PASS"


def test_late_rows_are_named(spark, tmp_path):
    folder, target, checkpoint, seen, other = (str(tmp_path / p) for p in ("in", "out", "cp", "seen", "cp2"))
    for batch in ([("a", 0), ("a", 10), ("b", 200)], [("a", 5), ("b", 30), ("a", 210), ("b", 500)]):
        keyed(spark, batch).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("k string, ts timestamp_ntz").parquet(folder)
        windows = windowed_quality(stream, "ts", F.col("k").isNull(), size="1 hour", late="1 minute", by=("k",))
        write_windows(windows, target, checkpoint).awaitTermination()
        write_arrivals(stream, "ts", seen, other, size="1 hour", by=("k",)).awaitTermination()
    got = left_out(spark.read.schema(windows.schema).parquet(target), spark.read.parquet(seen), by=("k",), late="1 minute")
    assert sorted((r.window_start.hour, r.k, r.arrived, r.counted, r.left_out) for r in got.collect()) == [
        (0, "a", 3, 2, 1), (0, "b", 1, 0, 1), (3, "a", 1, 1, 0), (3, "b", 1, 1, 0)]
