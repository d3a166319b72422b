"""Records of tickers, cells of contributions, pools, samples and held tickers, by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebar.operators import engine, interpret, records, screening, search


def test_cells_of_contributions(spark):
    rows = [("A", "x", float(v), c) for v, c in ((-10, 1.0), (0, -1.0), (0, -1.0), (10, 2.0))] + [("A", "x", None, 9.0), ("A", "flat", 3.0, 0.0), ("A", "flat", 3.0, 0.0), ("A", "gone", None, 1.0)]
    frame = spark.createDataFrame(rows, "ticker string, feature string, value double, contribution double")
    got = {(r.feature, r.cell): r for r in interpret.contribution_cells(frame, ["ticker"], -1.0, 1.0, 0.5).collect()}
    assert len(got) == 3 * 6
    x = [(got["x", c].lo, got["x", c].hi, got["x", c].n, got["x", c]["mean"]) for c in range(6)]
    # the deviation is sqrt(50), so the outer values lie at 1.41 of it
    assert x == [(None, -1.0, 1, 1.0), (-1.0, -0.5, 0, None), (-0.5, 0.0, 0, None), (0.0, 0.5, 2, -1.0), (0.5, 1.0, 0, None), (1.0, None, 2, 5.5)]  # a missing value lies in the last cell
    assert got["flat", 3].n == 2 and got["gone", 5].n == 1 and all(r.thin for r in got.values())


def test_flips_skip_thin_and_zero_cells(spark):
    rows = [(f, float(c), m) for f, means in {"turns": [1, 0, -1, 1], "once": [-1, -1, 1, 1]}.items() for c, m in enumerate(means) for _ in range(30)] + [("once", 4.0, -1), ("turns", 4.0, -5)]
    x = spark.createDataFrame([("A", f, v, float(m)) for f, v, m in rows], "ticker string, feature string, value double, contribution double")
    got = {r.feature: r for r in interpret.contribution_features(x, ["ticker"]).collect()}
    assert (got["turns"].flips, got["turns"].reversal) == (2, True) and (got["once"].flips, got["once"].reversal) == (1, False)
    assert got["once"]["rank"] == 1 and got["once"].used and got["once"].share + got["turns"].share == pytest.approx(1, abs=1e-7)


def test_bounds_in_deviations(spark):
    inf = float("inf")
    x = spark.createDataFrame([(1.0, inf, 3.0, 2.0), (-inf, 10.0, 1.0, 3.0), (0.0, 1.0, 0.0, 0.0), (0.0, 1.0, None, 1.0), (1 / 3, 2 / 3, 0.0, 1.0)], "lo double, hi double, mu double, sigma double")
    lo, hi = interpret.sigma_bounds(*map(F.col, ("lo", "hi", "mu", "sigma")))
    assert [tuple(r) for r in x.select(lo, hi).collect()] == [(-1.0, None), (None, 3.0), (None, None), (None, None), (0.33333, 0.66667)]


def test_outcomes_of_segments(spark):
    rows = [(0.5, 0, 0)] * 40 + [(1.5, 1, 1)] * 15 + [(1.5, 1, 0)] * 5 + [(1.5, 0, 1)] * 10 + [(9.0, 1, 1)] * 3
    got = {r.lo_bin: r for r in interpret.segment_outcomes(spark.createDataFrame(rows, "value double, entry int, y int"), [1.0, 2.0]).collect()}
    assert got[0].tp_events == 0 and got[0].tp_rate is None
    assert got[1].tp_events == 18 and got[1].tp_rate == pytest.approx(0.78261) and got[1].tp_lift == pytest.approx(18 / 23 / (28 / 73), abs=1e-4)


def test_pool_in_two_stages(spark):
    x = spark.createDataFrame([("a", 3, 0.5, 0.9, True), ("a", 1, 0.9, 0.9, False), ("a", 2, 0.5, 0.9, False), ("b", 9, 0.95, 0.95, True), ("c", 7, 0.9, 0.9, True)], "family string, id int, mean double, best_mean double, representative boolean")
    got = {(r.family, r.id): (r.stage, r.place) for r in search.stage_pool(x).collect()}
    assert got == {("b", 9): (1, 1), ("a", 3): (1, 2), ("c", 7): (1, 3), ("a", 1): (2, 1), ("a", 2): (2, 2)}


def test_sample_without_near_copies(spark):
    ranking = spark.createDataFrame([(t, i) for i, t in enumerate("ABCDEF")], "ticker string, place int")
    pairs = spark.createDataFrame([("A", "B", 0.99), ("B", "C", 0.99), ("A", "D", 0.95), ("C", "E", 0.96), ("A", "E", 0.97)], "a string, b string, corr double")
    got = {r.ticker: (r.picked, r.duplicate_of) for r in screening.uncorrelated(ranking, pairs, 3).collect()}
    # C is close to B only, which was not taken; E is close to two, A was taken first; F comes too late
    assert got == {"A": (True, None), "B": (False, "A"), "C": (True, None), "D": (True, None), "E": (False, None), "F": (False, None)}
    assert {r.ticker: r.duplicate_of for r in screening.uncorrelated(ranking, pairs, 9).collect()}["E"] == "A"
    assert screening.uncorrelated(ranking.limit(0), pairs).collect() == []


def test_held_ticker_by_hand(spark):
    rows = [("A", i, dt.datetime(2024, 1, 1, i), o, c) for i, (o, c) in enumerate([(100.0, 90.0), (90.0, 120.0), (120.0, 110.0)])]
    bars = spark.createDataFrame(rows, "ticker string, idx int, ts timestamp, open double, close double")
    r = engine.hold_summary(bars).first()
    buy, sell = 100 * 1.0002, 110 * 0.9998
    q = 1000 / (buy * 1.0001)
    end = 1000 + q * (sell - buy) - q * 1e-4 * (sell + buy)
    assert r.end_capital == pytest.approx(end) and r.return_pct == pytest.approx((end / 1000 - 1) * 100)
    assert (r.trades, r.benchmark_trades, r.profit_factor, r.capital_depleted, r.result_mode) == (0, 1, None, False, "HODL_FALLBACK_NO_MODEL_TRADES")
    marks = [m.equity for m in engine.equity(bars, engine.hold_ledger(bars)).orderBy("seq").collect()]
    assert len(marks) == 5 and marks[0] == pytest.approx(1000 - q * buy * 1e-4) and marks[-1] == pytest.approx(end)
    first, top = marks[1], marks[2]
    assert r.max_drawdown_pct == pytest.approx(max((1000 - first) / 1000, (top - min(marks[3:])) / top) * 100)


def test_losses_beyond_the_capital(spark):
    s = "ticker string, t0 int, p double, passes boolean, size double, net_return double, flat_from int"
    x = spark.createDataFrame([("A", 0, 0.6, True, 1.0, -1.5, 1), ("B", 0, 0.6, True, 0.5, -1.5, 1), ("B", 2, 0.1, False, 1.0, -1.5, 3)], s)
    got = {(r.ticker, r.t0): (r.uncovered, r.capital_after) for r in engine.replay(x, ["ticker"]).collect()}
    assert got == {("A", 0): (500.0, 0.0), ("B", 0): (0.0, 250.0), ("B", 2): (None, None)}


def records_of(spark, nulls, seconds=(("A", 10.0), ("B", 1.0), ("C", 1.0), ("Z", None))):
    accepted = spark.createDataFrame([("A", 0, "flat", "feature:7", 4, 3, 0.02), ("A", 1, "hierarchical", "family:f", 3, 3, 0.05), ("B", 0, "flat", "feature:9", 2, 2, 0.01)], "ticker string, outer_fold int, arm string, unit string, rotations long, wins long, median double")
    rotated = spark.createDataFrame([("A", 0, "flat", 7, "f", 0.09, 0.03), ("A", 0, "flat", 8, "f", 9.0, 0.0), ("A", 1, "hierarchical", 3, "f", 0.05, None), ("A", 1, "hierarchical", 4, "f", 0.05, 0.03)], "ticker string, outer_fold int, arm string, picked int, family string, discovery_gain double, confirm_delta double")
    n = spark.createDataFrame(nulls, "kind string, ticker string, outer_fold int, arm string, verdict string, p_mc double, final_p_lower_bound double")
    out = records.ticker_records(spark.createDataFrame(list(seconds), "ticker string, seconds double"), accepted, n, rotated, 45, {"optimism": 1.0, "instability": 1.0, "complexity": 0.1, "cost": 0.01})
    return {r.ticker: r for r in out.collect()}


def test_a_record_by_hand(spark):
    full, early = ("passed", 0.04, None), ("rejected_early", None, 0.1176)
    got = records_of(spark, [("a1", "A", 0, "flat", *full), ("a2", "A", 0, "flat", *full), ("b", "A", 0, "flat", *full), ("a1", "A", 1, "hierarchical", *early), ("a1", "B", 0, "flat", *early)])
    a = got["A"]
    assert (a.status, a.selected, a.n_selected, a.rejected_features, a.selection_mode, a.n_rejected_by_null) == ("resolved", ["feature:7"], 1, 44, "flat", 1)
    assert a.confirmation_win_rate == 0.75 and a.outer_delta == 0.02 and a.optimism == pytest.approx(0.06)
    assert a.j == pytest.approx(0.02 - 0.06 - 0.25 - 0.1 - 0.1)
    assert [(p.unit, p.p, p.basis) for p in a.max_null_p] == [("feature:7", 0.04, records.FULL)]
    assert (got["B"].status, got["B"].stop_reason, got["B"].j) == ("resolved_empty", "no unit exceeded the procedure-level null", None)
    assert (got["C"].status, got["C"].stop_reason) == ("resolved_empty", "cross-fit accepted nothing") and got["Z"].status == "absent"


def test_records_without_sensitivity_nulls_or_any(spark):
    got = records_of(spark, [("a1", "A", 0, "flat", "passed", 0.02, None), ("a1", "A", 1, "hierarchical", "passed", 0.02, None)])
    assert got["A"].status == "resolved_conditional" and got["A"].n_selected == 2 and got["A"].optimism == pytest.approx((0.06 + 0.02) / 2)
    assert got["B"].status == "resolved_empty"  # another null was run, so this one counts as not exceeded
    assert {k: r.status for k, r in records_of(spark, []).items()} == {"A": "screening_only", "B": "screening_only", "C": "resolved_empty", "Z": "absent"}
