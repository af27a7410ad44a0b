"""Every registered query against its SQL, or against what must hold where SQL cannot say it."""

import pytest

import __spark_entry__ as entry
from oracle import connect, differences
from workload import registry

NAMES = sorted(registry.QUERIES)  # the queries of optional parts are tested with them


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, con, folder, name):
    assert differences(spark, con, folder, name, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 18 and {r.status for r in rows} <= {"PASS", "FAIL"}
    assert [r.test_label for r in sorted(rows, key=lambda r: r.test_label)][0] == "TC-001"
