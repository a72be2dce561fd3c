"""Every registered query against its SQL in DuckDB, or at least for rows."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == []


# Queries without SQL have tests of their own; the costly ones are not run again here.
COSTLY = {
    "build_corpus", "generate_rows_columnwise", "generate_rows_json", "score_table_regression",
    "utility_LinearSVC", "utility_MLPClassifier", "utility_RandomForestClassifier",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - COSTLY))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
