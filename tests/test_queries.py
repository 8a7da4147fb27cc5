"""Every registered query against its SQL on the smallest tables."""

import pytest

from sluiceflow.operators import sorting
from sluiceflow.plans.catalog import all_oracles, all_queries
from tests.compare import compare, connect

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def tables():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    outcome = compare(spark, tables, DIRECTORY, QUERIES[name], ORACLES.get(name))
    assert not outcome.startswith("FAIL"), outcome


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_partition_bounds_are_disjoint_and_complete(spark):
    table = spark.read.parquet(f"{DIRECTORY}/lineitem.parquet")
    rows = sorted(sorting.partition_bounds(table, "l_extendedprice", 8).collect(), key=lambda r: r["partition"])
    assert sum(r["n"] for r in rows) == spark.read.parquet(f"{DIRECTORY}/lineitem.parquet").count()
    assert all(a["hi"] < b["lo"] for a, b in zip(rows, rows[1:]))
