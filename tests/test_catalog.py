from datetime import datetime

from pyspark.sql import functions as F

from tallymark.operators import catalog as k
from tallymark.operators import proposals as p

AT = datetime(2026, 1, 1)


def test_counts_list_unreadable_and_empty_tables(spark):
    def broken():
        raise OSError("gone")

    def fails_late():
        return spark.range(5).filter("assert_true(id < 3) is null")

    sources = {"a": lambda: spark.range(3), "b": lambda: spark.range(0), "c": broken, "d": fails_late}
    counts = k.guarded_table_counts(spark, sources)
    assert {r.table_name: r.row_count for r in counts.collect()} == {"a": 3, "b": 0, "c": None, "d": None}
    assert k.table_totals(counts).first().asDict() == {"tables": 4, "total_rows": 3, "empty_tables": 1, "unreadable": 2}
    whole = k.guarded_table_counts(spark, {"a": lambda: spark.range(3)})
    assert [tuple(r) for r in whole.collect()] == [("a", 3)] and k.guarded_table_counts(spark, {}).isEmpty()


def test_snapshot_diff(spark):
    schema = "table_name string, row_count bigint"
    before = spark.createDataFrame([("same", 5), ("grew", 1), ("gone", 7), ("unread", None)], schema)
    after = spark.createDataFrame([("same", 5), ("grew", 4), ("new", 0), ("unread", None)], schema)
    rows = [tuple(r) for r in k.snapshot_diff(before, after).collect()]
    assert rows == [("gone", 7, None, -7, False, True), ("grew", 1, 4, 3, False, False), ("new", None, 0, 0, True, False)]


def test_harvest_upsert_and_clear(spark):
    def load(item):
        if item["name"] == "bad":
            raise OSError("no access")
        return {"t": spark.range(1).withColumn("s", F.lit("x"))}

    items = [{"id": 1, "name": "one", "type": "Lakehouse"}, {"id": 2, "name": "bad", "type": "Lakehouse"}]
    assets, job = k.harvest(spark, items, load, "c1", "lake", "Lake", AT)
    assert [tuple(r) for r in job.select("asset_count", "status", "error_message").collect()] == [(1, "success", "no access")]
    columns = [(r.column_name, r.data_type, r.position) for r in k.asset_columns(assets).collect()]
    assert columns == [("id", "bigint", 0), ("s", "string", 1)]
    failed, job = k.harvest(spark, items[1:], load, "c1", "lake", "Lake", AT)
    assert job.first().status == "failed" and failed.isEmpty()

    again, _ = k.harvest(spark, [{"id": 1, "name": "renamed", "type": "Lakehouse", "owner": "x"}, {"id": 3, "name": "three", "type": "N"}],
                         load, "c2", "lake", "Other", datetime(2026, 2, 1))
    merged = {r.id: r for r in k.upsert_assets(assets, again).collect()}
    assert sorted(merged) == ["lake:1", "lake:3"]
    one = merged["lake:1"]
    assert (one.name, one.connector_id, one.connector_name, one.owner) == ("renamed", "c2", "Lake", None)
    kept = k.clear_items(k.upsert_assets(assets, again), "lake", "c2", spark.createDataFrame([(3,)], "id int"))
    assert [r.id for r in kept.collect()] == ["lake:1"]
    listed = k.list_assets(k.upsert_assets(assets, again), search="RENA")
    assert [r.name for r in listed.collect()] == ["renamed"] and "tables" not in listed.columns
    left, removed = k.delete_assets(assets, spark.createDataFrame([("lake:1",), ("lake:9",)], "id string"))
    assert left.isEmpty() and removed.first().removed == 1
    assert k.harvested_only(spark.createDataFrame([("a",)], "table_name string"), None).isEmpty()


def test_drift(spark):
    schema = "table_name string, column_name string, data_type string"
    before = spark.createDataFrame([("t", "a", "int"), ("t", "b", "int"), ("t", "c", "int")], schema)
    after = spark.createDataFrame([("t", "a", "int"), ("t", "b", "bigint"), ("t", "d", "int")], schema)
    got = sorted((r.column_name, r.change) for r in k.schema_drift(before, after).collect())
    assert got == [("b", "retyped"), ("c", "removed"), ("d", "added")]
    assert [r.column_name for r in k.gone(before, after, "table_name", "column_name").collect()] == ["c"]


def test_proposals_hold_on_the_table_they_come_from(spark):
    df = spark.range(200).selectExpr("id", "concat('name ', id) as name", "if(id % 2 = 0, 'x', 'y') as flag", "id * 1.5D as amount",
                                     "if(id = 3, null, id) as gap")
    found = p.candidate_rules(df, "t").collect()
    kinds = {(r.column_name, r.validation_type) for r in found}
    assert ("gap", "Null Value Constraint") not in kinds and ("flag", "Categorical Constraint") in kinds
    assert ("name", "Length Constraint") in kinds and ("id", "Uniqueness Constraint") in kinds
    almost = spark.range(200).selectExpr("if(id = 7, 8, id) as id", "'it''s' as `odd``name`")
    assert {(r.column_name, r.condition) for r in p.candidate_rules(almost, "t").collect() if r.validation_type in ("Uniqueness Constraint", "Categorical Constraint")} == {
        ("odd`name", "`odd``name` in ('it\\'s')")}
    for r in found:
        if r.validation_type != "Uniqueness Constraint":
            assert df.filter(f"not coalesce({r.condition}, true)").isEmpty(), r.condition
    assert p.owned_everywhere(p.candidate_rules(df, "t"), ["id"]).select("column_name").distinct().count() == 1


def test_duplicate_proposals(spark):
    schema = "position int, name string, kind string"
    proposed = spark.createDataFrame([(1, " A ", "n"), (2, "a", "n"), (3, "b", "n"), (4, "c", None), (5, "c", None)], schema)
    existing = spark.createDataFrame([(0, "B", "n")], schema)
    sign = lambda df: df.withColumn("name", p.name_signature(F.col("name")))
    got = {r.position: r.reason for r in p.sort_out_duplicates(sign(proposed), sign(existing), ["name", "kind"], "position").collect()}
    assert got == {1: None, 2: p.DUPLICATE, 3: p.DUPLICATE, 4: None, 5: p.DUPLICATE}
