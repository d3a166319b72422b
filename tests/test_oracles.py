"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connection, rows

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = {k: v for c in entry.CATALOGS for k, v in c.ORACLES.items()}
OTHERS = sorted({k for c in entry.CATALOGS for k in c.QUERIES} - set(SQL))


@pytest.fixture(scope="module")
def duck():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["logistic_scores", "boosted_scores"])
def test_scores(spark, name):
    """One probability for each event from bar 480 on; what they should be is in test_scoring."""
    got = entry.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) and not got.duplicated(["ticker", "t0"]).any() and (got.t0 >= 480).all() and got.p.between(0, 1).all() and got.p.nunique() > 2


def test_every_query_has_sql_or_a_test_of_its_own():
    assert OTHERS == ["boosted_scores", "class_balance", "family_first_search", "logistic_scores", "utility_register"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
