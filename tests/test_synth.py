import re

from pyspark.sql import functions as F

from tallymark.operators.synth import cell, fill, non_empty, synthetic_rows
from tallymark.sources.append import cast_to

SCHEMA = [
    ("email", "VARCHAR"), ("first_name", "VARCHAR"), ("datetime_text", "VARCHAR"), ("start_date", "VARCHAR"), ("lunch_time", "VARCHAR"),
    ("phone", "TEXT"), ("street", "VARCHAR"), ("zip", "VARCHAR"), ("customer_id", "VARCHAR"), ("odd", "VARCHAR"), ("flag", "BOOLEAN"),
    ("price", "DECIMAL(10,3)"), ("ratio", "DOUBLE"), ("n", "INTEGER"), ("u", "UUID"), ("d", "DATE"), ("ts", "TIMESTAMP"), ("t", "TIME"),
]
SHAPES = {
    "email": r"[a-z]{6}@[a-z]{6}\.example", "first_name": r"[A-Z][a-z]{5}", "datetime_text": r"20\d\d-\d\d-\d\d \d\d:\d\d:\d\d",
    "start_date": r"20\d\d-\d\d-\d\d", "lunch_time": r"\d\d:\d\d:\d\d", "phone": r"\+999\d{8}", "street": r"[A-Z][a-z]{5} road \d\d",
    "zip": r"\d{6}", "customer_id": r"\d{3}-\d{3}", "odd": r"[A-Z][a-z]+ \d\d", "flag": "true|false", "price": r"\d\d\.\d{3}",
    "ratio": r"\d\d\.\d{2}", "n": r"\d\d", "u": r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}",
    "d": r"20\d\d-\d\d-\d\d", "ts": r"20\d\d-\d\d-\d\d \d\d:\d\d:\d\d", "t": r"\d\d:\d\d:\d\d",
}


def test_cells_have_the_shape_their_type_and_name_ask_for(spark):
    rows = synthetic_rows(spark, SCHEMA, 300, seed=4).collect()
    assert len(rows) == 300
    for name, shape in SHAPES.items():
        assert all(re.fullmatch(shape, r[name]) for r in rows), (name, rows[0][name])
    assert len({r["u"] for r in rows}) == 300
    assert all(0 <= int(r["n"]) < 100 and "2001" <= r["d"] < "2026" for r in rows)


def test_the_same_seed_gives_the_same_rows_whatever_the_partitions(spark):
    a = fill(spark.range(0, 50, 1, 1), SCHEMA, 9).collect()
    assert a == fill(spark.range(0, 50, 1, 7), SCHEMA, 9).collect() and a != fill(spark.range(50), SCHEMA, 10).collect()


def test_rows_cast_to_their_schema(spark):
    target = spark.createDataFrame([], "id int, price decimal(10,2), on_date date, at timestamp_ntz, ok boolean, name string").schema
    assert cast_to(synthetic_rows(spark, target, 200), target).filter("_bad > 0").isEmpty()


def test_timestamp_is_not_cut_to_a_time(spark):
    made = spark.range(1).select(cell("x", "TIMESTAMP WITH TIME ZONE", 0).alias("v"), cell("birthdate", "VARCHAR", 0).alias("b")).first()
    assert len(made.v) == 19 and len(made.b) == 10


def test_non_empty_rows(spark):
    df = spark.createDataFrame([("", None), (" ", "  "), ("x", None), (None, "0")], "a string, b string")
    assert non_empty(df).count() == 2
    assert non_empty(df.select(F.col("a").alias("a.b"), "b")).count() == 2
