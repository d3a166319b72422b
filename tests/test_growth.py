"""What keeps queries right and even on larger tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from compare import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from tidebar.functions import canonical as J
from tidebar.operators import interpret


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stale_families_are_no_candidates_even_where_parts_have_their_keys(spark, tmp_path):
    keys = [1, 2, 3, 1_000_001, 1_000_002, 1_000_003]
    pd.DataFrame({"p_partkey": keys, "p_brand": "b", "p_type": "t", "p_size": [4, 4, 9, 1, 9, 5]}).astype({"p_size": "int32"}).to_parquet(tmp_path / "part.parquet")
    part = pd.read_parquet(tmp_path / "part.parquet")  # noqa: F841
    assert rows(entry.queries()["family_map_check"](spark, str(tmp_path)).toPandas()) == rows(duckdb.sql(entry.oracle_sql()["family_map_check"]).df())


def test_a_double_is_written_out_once(spark):
    x = spark.range(1).select((F.col("id") / 7).alias("v"))
    text = x.select(J.canonical(F.col("v"), T.DoubleType()).alias("j"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("format_string") == 3


def test_intervals_are_swept_in_one_ordered_pass(spark):
    spans = [("k", "a", 0.0, 4.0), ("k", "a", 1.0, 2.0), ("k", "a", 4.0, 6.0), ("k", "b", 2.0, 3.0), ("k", "b", 2.0, 3.0), ("k", "b", 5.0, 9.0), ("k", "b", 7.0, 7.0)]
    spans += [("apart", "a", 0.0, 1.0), ("apart", "b", 1.0, 2.0), ("one", "b", 0.0, 1.0), (None, "a", 0.0, 2.0), (None, "b", 1.0, 2.0)]
    got = interpret.interval_jaccard(spark.createDataFrame(spans, "key string, side string, lo double, hi double"))
    assert {r.key: r.jaccard for r in got.collect()} == {"k": pytest.approx(2 / 9), "apart": 0.0, "one": 0.0, None: 0.5}
    assert "Join" not in plan(got) and plan(got).split("Initial Plan")[-1].count("Sort [") == 1


@pytest.mark.parametrize("operator", [interpret.contribution_cells, interpret.contribution_features])
def test_rows_of_a_feature_are_not_dealt_by_feature(spark, operator):
    x = spark.range(100).selectExpr("string(id % 2) AS ticker", "string(id % 3) AS feature", "double(id) AS value", "double(id) AS contribution")
    assert "BroadcastHashJoin [ticker" in plan(operator(x, ["ticker"]))


@pytest.mark.parametrize("name", ["contribution_cells", "contribution_features"])
def test_contributions_are_rounded_once(spark, tmp_path, name):
    pd.DataFrame({"l_linestatus": "O", "l_linenumber": [1, 2], "l_extendedprice": [9000.0, 18000.0], "l_discount": 0.1, "l_tax": 0.0200085037}).astype({"l_linenumber": "int32"}).to_parquet(tmp_path / "lineitem.parquet")
    lineitem = pd.read_parquet(tmp_path / "lineitem.parquet")  # noqa: F841
    assert rows(entry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(duckdb.sql(entry.oracle_sql()[name]).df())
