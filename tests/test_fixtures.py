"""Values worked out by hand."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions import dsl
from tidebar.operators import engine, features, interpret, recurrences, screening, search, trades
from tidebar.sources import bars as B
from tidebar.sources import stores


def series(spark, closes, opens=None, ticker="A"):
    opens = opens or closes
    rows = [(ticker, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(o), float(max(o, c)), float(min(o, c)), float(c), 1.0) for i, (o, c) in enumerate(zip(opens, closes, strict=True))]
    return spark.createDataFrame(rows, "ticker string, idx int, ts timestamp, open double, high double, low double, close double, volume double")


def test_average_range(spark):
    rows = [("A", i, float(h), float(lo), float(c)) for i, (h, lo, c) in enumerate([(10, 8, 9), (12, 9, 11), (11, 10, 10.5)])]
    x = spark.createDataFrame(rows, "ticker string, idx int, high double, low double, close double")
    got = [r.atr_2 for r in recurrences.with_recurrences(x, (2,), (2,)).orderBy("idx").collect()]
    assert got == [None, 2.5, 1.75]


def test_exponential_mean_skips_leading_nulls(spark):
    got = [r.x for r in dsl.feature(series(spark, [1, 2, 3, 4, 9, 9, 9]), "ewm(shift(c, 3), 3)", "x").orderBy("idx").collect()]
    assert got == [None] * 5 + [2.25, 3.125]


def test_relative_strength_edges(spark):
    up = [r.rsi_14 for r in recurrences.with_recurrences(series(spark, list(range(1, 31)))).orderBy("idx").collect()]
    flat = [r.rsi_14 for r in recurrences.with_recurrences(series(spark, [1] * 30)).orderBy("idx").collect()]
    assert up[-1] == 100 and flat[-1] == 50 and up[:14] == [None] * 14


def test_fold_over_many_chunks(spark):
    from tidebar.functions.folds import CHUNK, running

    n = 3 * CHUNK + 5
    x = spark.range(n).select((F.col("id") % 2).alias("k"), F.col("id").alias("at"), F.lit(1).alias("v"))
    y = running(x, ["k"], ["at"], {"s": 0}, "`s`: int", lambda s, r: F.struct((s["s"] + r["v"]).alias("s")))
    got = {(r.k, r["at"]): r.state.s for r in y.collect()}
    assert len(got) == n and all(got[i % 2, i] == i // 2 + 1 for i in range(n))


def test_no_python_in_recurrences_and_replay(spark):
    s = "ticker string, t0 int, p double, passes boolean, size double, net_return double, flat_from int"
    x = engine.replay(spark.createDataFrame([("A", 0, 0.6, True, 1.0, 0.1, 3)], s), ["ticker"])
    for df in (features.core(series(spark, [1, 2, 3])), x):
        assert not any(w in df._jdf.queryExecution().toString() for w in ("InPandas", "InArrow", "ArrowEval", "BatchEvalPython"))


def test_average_precision_with_ties(spark):
    x = spark.createDataFrame([("k", 1, 0.9), ("k", 0, 0.9), ("k", 1, 0.8), ("k", 0, 0.1)], "k string, y int, p double")
    assert trades.average_precision(x, ["k"]).first().average_precision == pytest.approx(0.5833333333333333)


def test_uniqueness(spark):
    x = spark.createDataFrame([("A", 0, 99), ("A", 1, 99)], "ticker string, t0 int, end_idx int")
    out = trades.uniqueness(x, trades.Costs(horizon=3)).collect()
    assert [r.weight for r in out] == pytest.approx([2 / 3, 2 / 3])


@pytest.mark.parametrize(("way", "entry", "exit_", "net"), [(1, 100.02, 101.9796, 0.01938818355716927), (-1, 99.98, 102.0204, -0.020608061618322977)])
def test_trade(spark, way, entry, exit_, net):
    bars = series(spark, [100, 100, 110 if way > 0 else 110, 102, 102], [100, 100, 100, 102, 102])
    e = spark.createDataFrame([("A", 0, way, 1.0, 1.0, 1.0)], "ticker string, t0 int, direction int, atr_t0 double, width_tp double, width_sl double")
    r = trades.simulated(bars, e).first()
    assert (r.exit_idx, r.exit_kind) == (3, "condition")
    assert r.entry_fill == pytest.approx(entry) and r.exit_fill == pytest.approx(exit_) and r.net_return == pytest.approx(net)
    assert r.market_exit_reason == ("TARGET_TRIGGER" if way > 0 else "STOP_TRIGGER")


def test_capital_and_flat_from(spark):
    s = "ticker string, t0 int, p double, passes boolean, size double, net_return double, flat_from int"
    x = spark.createDataFrame([("A", 0, 0.6, True, 1.0, 0.01938818355716927, 5), ("A", 5, 0.6, True, 1.0, 0.0, 9), ("B", 0, 0.6, True, 1.0, 0.0, 6), ("B", 5, 0.6, True, 1.0, 0.0, 9), ("C", 0, 0.6, True, 1.0, -2.0, 1), ("C", 3, 0.6, True, 1.0, 0.1, 4)], s)
    got = {(r.ticker, r.t0): r for r in engine.replay(x, ["ticker"]).collect()}
    assert got["A", 0].capital_after == pytest.approx(1019.3881835571692)
    assert got["A", 5].fate == "entered" and got["B", 5].fate == "ignored_while_open"
    assert got["C", 0].capital_after == 0 and got["C", 3].fate == "after_halt"


def test_ties_between_setups_of_one_bar(spark):
    s = "ticker string, t0 int, p double, passes boolean, size double, net_return double, flat_from int"
    x = spark.createDataFrame([("A", 0, 0.6, True, 1.0, 0.1, 3), ("A", 0, 0.6, True, 1.0, 0.1, 3), ("A", 1, 0.7, True, 1.0, 0.1, 3), ("A", 1, 0.6, True, 1.0, 0.1, 3), ("A", 3, 0.6, True, 0.0, 0.1, 5), ("A", 4, 0.1, False, 1.0, 0.1, 5)], s)
    assert sorted(r.fate for r in engine.replay(x, ["ticker"]).collect()) == ["entered", "not_selected", "not_selected", "simultaneous_tie_skip", "simultaneous_tie_skip", "threshold_rejects"]


def test_hold(spark):
    assert engine.hold(series(spark, [105, 110], [100, 105])).first().end_capital == pytest.approx(1099.34019795381)


def test_drawdown(spark):
    x = spark.createDataFrame([("A", i, 0, e) for i, e in enumerate([999.9, 1010.0, 1005.0, 950.0, 1020.0])], "ticker string, trade_id int, seq int, equity double")
    assert engine.drawdown(x).first().max_drawdown_pct == pytest.approx(5.9405940594059405)


def test_fold_edges(spark):
    e = spark.createDataFrame([("A", t) for t in range(100, 1101)], "ticker string, t0 int")
    got = {(r.val_lo, r.val_hi) for r in trades.folds(e).select("val_lo", "val_hi").distinct().collect()}
    assert got == {(300, 500), (500, 700), (700, 900), (900, 1101)}


def test_operating_point_prefers_inside_the_plateau(spark):
    g = spark.createDataFrame([("A", 0.50, None, "both", [0.10, 0.02], [9, 9]), ("A", 0.52, None, "both", [0.06, 0.05], [9, 9]), ("A", 0.54, None, "both", [0.03, 0.03], [9, 9])], "ticker string, theta double, lambda double, direction string, fold_growth array<double>, fold_trades array<int>")
    r = engine.operating_point(g, ["ticker"], least_trades=2).first()
    assert (r.theta, r.theta_boundary, r.plateau_size) == (0.52, False, 2) and r.se == pytest.approx(0.04)
    assert engine.operating_point(g, ["ticker"], least_trades=99).first().trade_floor_met is False


def test_acceptance(spark):
    x = spark.createDataFrame([("T", 0, "flat", 1, "f", 0.02), ("T", 0, "flat", 1, "f", 0.01), ("T", 0, "flat", 2, "f", -0.01)], "ticker string, outer_fold int, arm string, picked int, family string, confirm_delta double")
    r = search.acceptance(x).first()
    assert r.accepted == "feature:1" and r.statistic == pytest.approx(0.011)


def test_acceptance_needs_two_rotations_and_a_majority(spark):
    d = lambda unit, *gains: [("T", 0, "flat", unit, "f", r, g) for r, g in enumerate(gains)]
    one = lambda rows: search.acceptance(spark.createDataFrame(rows, "ticker string, outer_fold int, arm string, picked int, family string, rotation int, confirm_delta double")).first()
    assert one(d(1, 0.9)).unit is None and one(d(1, 0.9)).statistic == 0
    assert one(d(1, 0.9, -0.1)).unit is None
    r = one(d(1, 0.002, 0.003))
    assert r.unit == "feature:1" and r.accepted is None and r.statistic == pytest.approx(-0.0015)
    r = one([("T", 0, "flat", 9, "f", 0, 0.05), ("T", 0, "flat", 2, "f", 1, 0.05), ("T", 0, "flat", 9, "f", 2, 0.05), ("T", 0, "flat", 2, "f", 3, 0.05), *d(3, None, 0.9)])
    assert (r.accepted, r.units, r.units_eligible) == ("feature:9", 3, 2)


def test_family_classes(spark):
    rows = [("u", "A", "passed"), ("u", "B", "passed"), ("u", "C", "failed"), ("c", "A", "passed"), ("c", "B", "passed"), ("c", "C", "failed"), ("c", "D", None), ("a", "A", "passed"), ("s", "A", None), ("n", "A", "failed"), ("n", "A", "failed")]
    x = search.family_matrix(spark.createDataFrame([(t, f, v) for f, t, v in rows], "ticker string, family string, null string"))
    got = {r.family: (r.classification, r.recurrence, r.n_screening) for r in x.collect()}
    assert got == {"u": ("universal", 0.667, 0), "c": ("conditional", 0.5, 1), "a": ("asset_specific", 1.0, 0), "s": ("screening_only", 0.0, 1), "n": ("unconfirmed", 0.0, 0)}
    assert [r.family for r in search.transfer_prior(x).orderBy("place").collect()] == ["u", "c", "a", "s", "n"]


def test_quality_counts_far_repeats_and_infinite_volume(spark):
    b = series(spark, [10, 11, 12, 13]).withColumn("position", F.col("idx"))
    again = b.withColumn("ts", F.when(F.col("idx") == 3, F.lit("2024-01-01 00:00:00").cast("timestamp")).otherwise(F.col("ts")))
    assert B.quality(again).first().duplicate_ts == 1
    assert B.quality(b.withColumn("volume", F.when(F.col("idx") == 1, float("inf")).otherwise(F.col("volume")))).first().bad_volume == 1


def test_blocks_and_reorder(spark):
    x = search.blocks(spark.createDataFrame([("A", t) for t in (0, 5, 23, 24, 30, 48, 49)], "ticker string, t0 int"), 24)
    got = [(r.t0, r.block) for r in x.orderBy("t0").collect()]
    assert got == [(0, 0), (5, 0), (23, 0), (24, 1), (30, 1), (48, 2), (49, 2)]
    p = search.permuted(x, search.orders(x, 42, 1)).collect()
    assert sorted(r.src_t0 for r in p) == sorted(r.t0 for r in p)


def test_segments_bridge_empty_bins(spark):
    rows = [(1.5, 1)] * 30 + [(3.5, 1)] * 30 + [(4.5, 0)] * 60
    x = interpret.entry_segments(spark.createDataFrame(rows, "value double, entry int"), [1.0, 2.0, 3.0, 4.0, 5.0])
    assert sorted((r.lo_bin, r.hi_bin, r["class"]) for r in x.collect()) == [(1, 3, "hot"), (4, 5, "cold")]


def test_nearest_rank_and_hour_boundaries(spark):
    x = spark.createDataFrame([(float(i),) for i in range(6)], "v double")
    assert x.agg(screening.nearest_rank("v", 0.5).alias("q")).first().q == 2.0
    t = [dt.datetime(2024, 1, 1, 0, 59), dt.datetime(2024, 1, 1, 1, 1)]
    b = spark.createDataFrame([("A", i, x, 1.0, 1.0, 1.0, 1.0, 1.0) for i, x in enumerate(t)], "ticker string, idx int, ts timestamp, open double, high double, low double, close double, volume double")
    assert screening.profile(b).first().max_gap_hours == 1


def test_asof(spark):
    left = spark.createDataFrame([("A", 5), ("A", 9), ("A", 1)], "ticker string, t int")
    right = spark.createDataFrame([("A", 2, "a"), ("A", 5, "b"), ("A", 8, "c"), ("A", 9, None)], "ticker string, at int, v string")
    got = {r.t: r.context.v if r.context else "none" for r in features.asof(left, right, "t", "at").collect()}
    assert got == {5: "b", 9: None, 1: "none"}


def test_iso_week(spark):
    d = spark.createDataFrame([("A", dt.date(2021, 1, 3), 1.0, 1.0, 1.0, 1.0, 1.0, dt.datetime(2021, 1, 3))], "ticker string, session date, open double, high double, low double, close double, volume double, available_at timestamp")
    assert B.weekly(d).first().week == "2020-53"


def test_wilson(spark):
    lo, hi = search.wilson(F.lit(3), F.lit(50))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (r.lo, r.hi) == (pytest.approx(0.020614596, abs=1e-8), pytest.approx(0.162173434, abs=1e-8))


@pytest.mark.parametrize(("column", "value", "rule"), [("high", 0.5, "high_below_low"), ("open", -1.0, "bad_price"), ("close", float("nan"), "bad_price"), ("volume", -1.0, "bad_volume"), ("low", 99.0, "low_above_body")])
def test_quality_rules(spark, column, value, rule):
    b = series(spark, [10, 11, 12, 13]).withColumn(column, F.when(F.col("idx") == 2, F.lit(value)).otherwise(F.col(column)))
    assert B.quality(b).first()[rule] == 1
    with pytest.raises(ValueError, match=rule):
        B.require_quality(b)


def test_features_do_not_look_ahead(spark):
    closes = [100 + 10 * np.sin(i / 3) + i % 5 for i in range(80)]
    whole, cut = features.core(series(spark, closes)), features.core(series(spark, closes[:60]))
    a, b = (x.where("idx < 60").orderBy("idx").toPandas() for x in (whole, cut))
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("text", ["shift(c,-1)", "shift(c,0)", "shift(c,x)", "c.__class__", "open('f')", "c**2", "rolling_mean(c, n=5)", "q", "True", "rolling_mean(c, 2.5)", "shift(c, True)", "clip(c, l, h)", "c if c else o"])
def test_language_refuses(text):
    with pytest.raises(dsl.Refused):
        dsl.parsed(text)


def test_language_nests_windows(spark):
    b = series(spark, list(range(1, 13)))
    got = dsl.feature(b, "rolling_mean(shift(c, 1), 3) - 1", "x").orderBy("idx").collect()
    assert [r.x for r in got[:5]] == [None, None, None, 1.0, 2.0]
    assert dsl.proposal_problems(b, "c - c", "x", warm_up=2) == ["constant"]


def test_ledger_detects_tampering(spark):
    x = stores.chained(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "seq long, body string"), "seq", "body")
    assert stores.broken_links(x).count() == 0
    assert stores.broken_links(x.withColumn("body", F.when(F.col("seq") == 2, "z").otherwise(F.col("body")))).count() == 1


def test_upsert_adds_columns(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3, "n")], "k string, v int, note string")
    assert sorted((r.k, r.v, r.note) for r in stores.upserted(old, new, ["k"]).collect()) == [("a", 1, None), ("b", 3, "n")]


def test_bars_round_trip(spark, tmp_path):
    b = series(spark, [1, 2, 3])
    stores.write_bars(b, str(tmp_path / "bars"))
    back = spark.read.parquet(str(tmp_path / "bars"))
    assert back.where("ticker = 'A'").count() == 3
    assert stores.folder_digest(spark, str(tmp_path / "bars" / "ticker=A")).first().digest
