"""Set checks that share a grouping say what each says on its own."""

import pytest

from tallymark import model as m
from tallymark.model import ColumnParity, KeyParity, Mapping
from tallymark.operators import parity
from tallymark.operators.set_checks import set_parity_many
from tallymark.plans.runner import plan, run, units

MAP = [{"name": "key", "source": {"a": "id", "b": "number"}, "destination": {"d": "id"}}]


@pytest.fixture
def mapping(spark):
    a = spark.createDataFrame([(1, "x", "2020-01-02"), (2, None, "2020-01-03"), (10, "y", None), (None, "y", "t")], "id int, word string, day string")
    b = spark.createDataFrame([(9, "z", "2020-01-02 00:00:00"), (2, "x", "u"), (100, "w", "v")], "number long, word string, day string")
    d = spark.createDataFrame([(2, "x", "2020-01-02"), (9, "q", "t"), (7, "z", None), (11, "p'", "w")], "id long, word string, day string")
    return Mapping("m", {"a": a, "b": b}, {"d": d}, MAP)


def checks():
    columns = lambda kind, name: ColumnParity(name=f"{kind} {name}", validation_type=kind, source_column=name, destination_column=name)
    return [KeyParity(name="keys", key="key"), KeyParity(name="days", key="day"), KeyParity(name="words", key="word"),
            *(columns(kind, name) for kind in (m.CATEGORICAL, m.UNIQUENESS) for name in ("word", "day", "key"))]


def rows_of(frame):
    return [(r.status, r.details, r.violations, r.total_rows) for r in frame.collect()]


def test_same_verdicts_as_alone(spark, mapping):
    wanted = checks()
    many = set_parity_many(mapping.source, mapping.destination, wanted, mapping.column_map).orderBy("position")
    assert rows_of(many) == [rows_of(plan(spark, mapping, c))[0] for c in wanted]
    few = set_parity_many(mapping.source, mapping.destination, wanted[:1], mapping.column_map, samples=0)
    assert few.first().details == parity.key_parity(mapping.source, mapping.destination, "key", mapping.column_map, samples=0).first().details


def test_empty_tables(spark, mapping):
    empty = Mapping("e", {t: df.limit(0) for t, df in mapping.source.items()}, {t: df.limit(0) for t, df in mapping.destination.items()}, MAP)
    wanted = checks()
    assert rows_of(set_parity_many(empty.source, empty.destination, wanted, MAP).orderBy("position")) == [rows_of(plan(spark, empty, c))[0] for c in wanted]
    half = Mapping("h", mapping.source, empty.destination, MAP)
    assert rows_of(set_parity_many(half.source, half.destination, wanted, MAP).orderBy("position")) == [rows_of(plan(spark, half, c))[0] for c in wanted]


def test_one_plan_for_all(spark, mapping):
    wanted = [*checks(), KeyParity(name="gone", key="nope")]
    sets = [u for u in units(spark, mapping, wanted) if len(u.checks) > 1]
    assert [u.checks for u in sets] == [list(range(len(wanted)))]
    outcome = run(spark, mapping, wanted)
    assert [r["status"] for r in outcome.rows][-1] == "ERROR" and "nope" in outcome.rows[-1]["error_message"]
    assert [r["details"] for r in outcome.rows][:-1] == [rows_of(plan(spark, mapping, c))[0][1] for c in wanted[:-1]]


def test_every_table_is_read_once(spark, folder):
    t = spark.read.parquet(f"{folder}/orders.parquet")
    wanted = [KeyParity(name="k", key="o_orderkey"), *(ColumnParity(name=n, validation_type=kind, source_column=n, destination_column=n)
              for n in ("o_orderstatus", "o_custkey") for kind in (m.CATEGORICAL, m.UNIQUENESS))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan_text = set_parity_many({"a": t}, {"b": t.where("o_orderkey > 5")}, wanted)._jdf.queryExecution().executedPlan().toString()
        assert plan_text.count("FileScan parquet") == 2 and plan_text.count("Exchange hashpartitioning(at") >= 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
