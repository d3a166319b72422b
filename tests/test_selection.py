"""Splits, rotations and outer evaluation, against plain loops and values worked out by hand."""

from __future__ import annotations

import math
import random

import pytest

from tidebar.operators import selection


def test_overlapping_splits_equal_plain_sums(spark):
    rng = random.Random(6)
    trades = [(rng.choice("AB"), rng.choice([1, 2, None]), rng.randint(0, 60), rng.randint(0, 10) / 10, rng.uniform(-0.1, 0.1)) for _ in range(700)]
    trades += [("A", 1, None, 0.5, 0.1), ("A", 1, 5, None, 0.1), ("A", 1, 5, 0.5, None), ("Z", 1, 5, 0.5, 0.1)]
    splits = [(t, c, k, lo, lo + width, theta, theta + k / 100) for t in "AB" for c in (1, 2, None) for k, (lo, width) in enumerate([(0, 20), (10, 30), (10, 30), (59, 9), (70, 5), (30, 0)]) for theta in (0.2, 0.5, 0.9)]
    kind = "ticker string, config int, t0 int, p double, net double"
    got = selection.split_grid(spark.createDataFrame(trades, kind).repartition(4), spark.createDataFrame(splits, "ticker string, config int, fold int, lo int, hi int, theta double, cut double"), ["ticker", "config"])
    of = {tuple(r)[:7]: (r.growth, r.trades) for r in got.collect()}
    assert set(of) <= set(splits) and {s[:2] for s in splits if s[1] is not None} == {s[:2] for s in of if s[1] is not None}
    for s, (growth, n) in of.items():
        t, c, _, lo, hi, _, cut = s
        nets = [x[4] for x in trades if x[0] == t and x[1] == c and x[2] is not None and x[3] is not None and x[4] is not None and lo <= x[2] < hi and x[3] >= cut]
        assert n == len(nets) and growth == pytest.approx(sum(map(math.log1p, nets)), abs=1e-9)


GRID = "ticker string, outer_fold int, candidate int, family string, formula string, fold int, theta double, growth double, trades int"


def grid_of(spark, growths: dict) -> object:
    """One point for each candidate, or several: {candidate: {theta: [growth of each fold]}}."""
    rows = [("A", 0, c, f"f{(c or 0) % 2}", f"rolling_mean(c,{(c or 1) * 10})", k, t, g, 30) for c, by in growths.items() for t, gs in by.items() for k, g in enumerate(gs) if g is not None]
    return spark.createDataFrame(rows, GRID)


def test_rotations_by_hand(spark):
    growths = {None: {0.5: [0.1, 0.1, 0.1, 0.1]}, 1: {0.5: [0.5, 0.1, 0.1, 0.1]}, 2: {0.5: [0.2, 0.2, 0.2, 0.2]}, 4: {0.5: [0.21, 0.2, 0.2, 0.2]}}
    got = {(r.rotation, r.arm): r for r in selection.rotations(grid_of(spark, growths)).collect()}
    assert len(got) == 8
    # without fold 0, candidates 2 and 4 tie at a gain of 0.1: the smaller id; with it, 1 gains 0.4 / 3
    assert (got[0, "flat"].picked, got[0, "flat"].confirm_delta) == (2, pytest.approx(0.1))
    assert got[1, "flat"].picked == 1 and got[1, "flat"].confirm_delta == pytest.approx(0.0) and got[1, "flat"].discovery_gain == pytest.approx(0.4 / 3)
    assert got[0, "hierarchical"].family == "f0" and got[0, "hierarchical"].picked == 2
    assert got[1, "hierarchical"].family == "f1" and got[1, "hierarchical"].picked == 1
    kept = selection.rotations(grid_of(spark, growths).selectExpr("*", "1 AS rotation_", "2 AS gain", "3 AS rest")).collect()
    assert len(kept) == 8


def test_confirmation_uses_the_point_of_discovery(spark):
    # fold 3 alone likes theta 0.2; discovery on the others must not see that
    growths = {None: {0.2: [0.0, 0.0, 0.0, 0.0], 0.5: [0.0] * 4, 0.8: [0.0] * 4}, 1: {0.2: [0.0, 0.0, 0.0, 9.0], 0.5: [0.2, 0.2, 0.2, -0.5], 0.8: [0.0] * 4}}
    got = {(r.rotation, r.arm): r for r in selection.rotations(grid_of(spark, growths)).collect()}
    assert got[3, "flat"].confirm_delta == pytest.approx(-0.5) and got[3, "flat"].discovery_gain == pytest.approx(0.2)


def test_a_missing_model_and_a_missing_core(spark):
    growths = {None: {0.5: [0.1, 0.1, 0.1]}, 1: {0.5: [0.3, 0.3, None]}}
    got = {(r.rotation, r.arm): r for r in selection.rotations(grid_of(spark, growths)).collect()}
    assert got[2, "flat"].confirm_delta is None and got[0, "flat"].confirm_delta == pytest.approx(0.2)
    assert selection.rotations(grid_of(spark, {1: {0.5: [0.1, 0.2]}})).collect() == []
    assert selection.rotations(spark.createDataFrame([], GRID)).collect() == []


def test_replayed_verdicts(spark):
    rot = spark.createDataFrame([("A", 0, r, "flat", 7, "f", d) for r, d in enumerate([0.1, 0.2, -0.1])] + [("B", 0, 0, "flat", 7, "f", 0.5)], "ticker string, outer_fold int, rotation int, arm string, picked int, family string, confirm_delta double")
    stored = spark.createDataFrame([("A", 0, "flat", None), ("B", 0, "flat", "feature:7"), ("C", 0, "flat", "feature:1")], "ticker string, outer_fold int, arm string, accepted string")
    got = {r.ticker: (r.unit, r.accepted_before, r.accepted_after, r.changed) for r in selection.verdict_replay(stored, rot).collect()}
    assert got == {"A": ("feature:7", False, True, True), "B": (None, True, False, True), "C": (None, True, False, True)}


def test_outer_evaluation_by_hand(spark):
    inner = [("A", c, 0, f, t, g, 30) for c, by in {0: {0.2: 0.1, 0.5: 0.3, 0.8: 0.1}, 5: {0.2: 0.9, 0.5: 0.1, 0.8: 0.2}}.items() for t, g in by.items() for f in (0, 1)]
    outer = [("A", c, 0, None, t, g, n) for c, t, g, n in ((0, 0.2, 7.0, 1), (0, 0.5, 0.05, 0), (0, 0.8, 7.0, 1), (5, 0.2, 0.4, 3), (5, 0.5, -0.2, 2), (5, 0.8, 7.0, 1))]
    grid = spark.createDataFrame(inner + outer, "ticker string, config int, outer_fold int, fold int, theta double, growth double, trades int")
    arms = spark.createDataFrame([("A", 0, "core", 0, None), ("A", 0, "greedy", 5, 0.7), ("A", 0, "best_single", 5, None), ("B", 1, "core", 0, None)], "ticker string, outer_fold int, arm string, config int, inner_gain double")
    got = {r.ticker: r for r in selection.outer_evaluation(grid, arms).collect()}
    a = got["A"]
    assert (a.core_q, a.core_growth, a.greedy_q, a.greedy_growth, a.best_single_growth) == (0.5, 0.05, 0.2, 0.4, 0.4)
    assert a.delta == pytest.approx(0.35) and a.optimism_gap == pytest.approx(0.35) and a.informative
    assert a.delta_features_only == pytest.approx(-0.25)  # the greedy features at the core's point
    assert got["B"].delta is None and not got["B"].informative and got["B"].core_q is None
