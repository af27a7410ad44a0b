from datetime import datetime, timedelta

import pytest

from tallymark import model as m
from tallymark.model import CheckError
from tallymark.operators import rules

ROWS = [(1, "A", 5.0, datetime(2020, 1, 1)), (2, "b", None, datetime(2020, 1, 3)), (2, None, 50.0, None), (None, "", 7.0, None)]
SCHEMA = "k bigint, code string, amount double, at timestamp_ntz"


def figures(df):
    row = df.first()
    return row.status, row.violations, row.total_rows


def test_row_rules(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    checked = rules.check_rows(df, [
        rules.not_null("code"), rules.in_range("amount", 5, 10), rules.in_range("amount", None, 50),
        rules.matches(df, "code", "^[A-Z]$"), rules.length_between(df, "code", 1), rules.length_between(df, "amount", 3, 3),
        rules.allowed_values("code", ["A", "b"]), rules.expression("amount > 5 or code = 'A'"), rules.volume_between(5, None),
        rules.volume_between(None, 3), rules.volume_between(1, 9), rules.fresh("at", datetime(2020, 1, 4), timedelta(days=1)),
        rules.fresh("at", datetime(2020, 1, 4, 1), timedelta(days=1)),
    ]).orderBy("position").collect()
    assert [r.violations for r in checked] == [1, 1, 0, 2, 1, 1, 1, 1, 1, 1, 0, 0, 1]
    assert {r.total_rows for r in checked} == {4}
    assert checked[0].details == "1 null code value(s)" and checked[0].validation_type == m.NULLS
    assert checked[1].status == "FAIL" and checked[2].status == "PASS"


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert figures(rules.check_rule(df, rules.not_null("code"))) == ("PASS", 0.0, 0)
    assert figures(rules.check_rule(df, rules.fresh("at", datetime(2020, 1, 1), timedelta(days=1)))) == ("FAIL", 1.0, 0)
    assert figures(rules.unique(df, ["k"])) == ("PASS", 0.0, 0)
    assert figures(rules.referential(df, "k", df, "k")) == ("PASS", 0.0, 0)


def test_unique_and_referential(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert figures(rules.unique(df, ["k"])) == ("FAIL", 1.0, 4)
    assert rules.unique(df, ["k"]).first().details == "1 repeated (k) value(s), 1 surplus row(s)"
    assert figures(rules.unique(df, ["k", "code"])) == ("PASS", 0.0, 4)
    parent = spark.createDataFrame([(2,), (3,), (3,)], "id bigint")
    assert figures(rules.referential(df, "k", parent, "id")) == ("FAIL", 1.0, 4)
    assert figures(rules.referential(df, "k", parent, "id", nulls_fail=True)) == ("FAIL", 2.0, 4)
    assert figures(rules.referential(df.filter("k = 2"), "k", parent, "id")) == ("PASS", 0.0, 2)


def test_a_hot_key_does_not_change_the_counts(spark):
    child = spark.range(3000).selectExpr("if(id % 3 = 0, -1, id) as k")
    parent = spark.range(3000).selectExpr("id as k")
    assert figures(rules.referential(child, "k", parent, "k")) == ("FAIL", 1000.0, 3000)
    assert figures(rules.unique(child, ["k"])) == ("FAIL", 1.0, 3000)


def test_misconfigured_rules():
    with pytest.raises(CheckError):
        rules.in_range("x")
    with pytest.raises(CheckError):
        rules.matches(None, "x", "")
