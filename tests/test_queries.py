"""Every registered query against its SQL on the same tables."""

import os
import sys

import pytest
from conftest import DATA, ROOT

sys.path.insert(0, ROOT)

import __spark_entry__ as registry  # noqa: E402
from compare import compare, connect  # noqa: E402

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(os.path.join(DATA, "sf0.001"))


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert registry.entry(spark).count() == 200


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    result = QUERIES[name](spark, os.path.join(DATA, "sf0.001")).toArrow()
    assert compare(result, con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, os.path.join(DATA, "sf0.001")).toArrow().num_rows > 0
