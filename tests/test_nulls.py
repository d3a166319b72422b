"""The conditional null and the sequential test, against plain numpy and values worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest

from tidebar.operators import nulls, search


def brute(t0, x, y, folds, embargo, least, alphas):
    """alpha, error and fitted values of one ticker, straight from the definition."""
    edges = [i * len(x) // folds for i in range(folds + 1)]
    parts = [np.arange(edges[i], edges[i + 1]) for i in range(folds)]
    train = [np.flatnonzero((t0 < t0[p[0]] - embargo) | (t0 > t0[p[-1]] + embargo)) if len(p) else np.arange(0) for p in parts]

    def filled(rows):
        own = y[rows].copy()
        for j in range(y.shape[1]):
            some = own[~np.isnan(own[:, j]), j]
            own[np.isnan(own[:, j]), j] = some.mean() if len(some) else 0.0
        return own

    def model(rows, alpha):
        mu, sd = x[rows].mean(0), x[rows].std(0) + 1e-12
        z, target = (x[rows] - mu) / sd, filled(rows)
        slopes = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (target - target.mean(0)))
        return lambda v: (v - mu) / sd @ slopes + target.mean(0)

    best, least_error = None, np.inf
    for a in alphas:
        errors = [np.nanmean((model(tr, a)(x[te]) - y[te]) ** 2) for te, tr in zip(parts, train, strict=True) if len(tr) >= least and len(te) and not np.isnan(y[te]).all()]
        if errors and np.mean(errors) < least_error:
            best, least_error = a, np.mean(errors)
    fitted = np.zeros_like(y)
    for te, tr in zip(parts, train, strict=True):
        fitted[te] = model(tr, best)(x[te]) if len(tr) >= least else filled(tr).mean(0) if len(tr) else 0.0
    return best, least_error, fitted


@pytest.mark.parametrize("embargo", [3, 60, 2000])
def test_cross_fitted_ridge_equals_its_definition(spark, embargo):
    rng = np.random.Generator(np.random.PCG64(3))
    rows, want = [], {}
    for ticker, n, scale in (("A", 403, 1.0), ("B", 120, 1e4), ("C", 7, 1.0)):
        t0 = np.sort(rng.choice(3000, n, replace=False))
        x = rng.normal(size=(n, 4)) * [1, 5, 0.01, scale] + [0, 100, 1e4, 3]
        x[:, 2] = 7.0 if ticker == "B" else x[:, 2]  # a column that stands still
        y = x @ rng.normal(size=(4, 3)) * 0.1 + rng.normal(size=(n, 3))
        y[rng.random((n, 3)) < 0.1] = np.nan
        if ticker == "B":
            y[:, 2] = np.nan
        want[ticker] = t0, y, *brute(t0, x, y, 5, embargo, 50, nulls.ALPHAS)
        rows += [(ticker, int(t), *map(float, v), *(None if np.isnan(e) and k else float(e) for k, e in enumerate(w))) for t, v, w in zip(t0, x, y, strict=True)]
    rows += [(None, 1, *[0.0] * 7), ("A", None, *[0.0] * 7), ("A", 5000, None, *[0.0] * 6)]
    names = [f"x{i}" for i in range(4)], [f"y{i}" for i in range(3)]
    frame = spark.createDataFrame(rows, "ticker string, t0 int, " + ", ".join(f"{c} double" for c in [*names[0], *names[1]])).selectExpr("*", "1 AS fold", "2 AS n", "3 AS b").repartition(5)
    fit = nulls.ridge_crossfit(frame, *names, embargo=embargo)
    got = fit.collect()
    assert len(got) == sum(len(w[0]) for w in want.values())
    for ticker, (t0, y, alpha, error, fitted) in want.items():
        own = sorted((r for r in got if r.ticker == ticker), key=lambda r: r.t0)
        assert [r.t0 for r in own] == t0.tolist() and {r.alpha for r in own} == {alpha}
        np.testing.assert_allclose([r.fitted for r in own], fitted, rtol=1e-6, atol=1e-6)
        for r, e, f in zip(own, y, fitted, strict=True):
            assert [v is None for v in r.residual] == np.isnan(e).tolist()
            assert [v for v in r.residual if v is not None] == pytest.approx((e - f)[~np.isnan(e)].tolist(), abs=1e-5)
    s = {r.ticker: r for r in nulls.ridge_summary(fit, 3).collect()}
    for ticker, (_, y, alpha, error, fitted) in want.items():
        assert s[ticker].alpha == alpha and s[ticker].nan_columns == np.isnan(y).any(0).sum()
        if alpha is not None:
            assert s[ticker].recon_mse == pytest.approx(error, rel=1e-6)
        assert s[ticker].residual_share == pytest.approx(np.nansum(np.nanvar((y - fitted)[:, ~np.isnan(y).all(0)], axis=0)) / np.nansum(np.nanvar(y[:, ~np.isnan(y).all(0)], axis=0)), abs=1e-4)


def test_rows_are_numbered_over_stretches(spark):
    x = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'A' ELSE 'B' END AS ticker", "cast(id AS int) AS t0").repartition(7)
    got = nulls.numbered(x).collect()
    for t, keep in (("A", lambda i: i % 3 == 0), ("B", lambda i: i % 3 > 0)):
        assert [(r.t0, r.position, r.n) for r in sorted(got, key=lambda r: r.t0) if r.ticker == t] == [(i, k, sum(map(keep, range(5000)))) for k, i in enumerate(filter(keep, range(5000)))]


def test_conditional_null_puts_back_fitted_values(spark):
    fit = spark.createDataFrame([("A", 1, [1.0, 2.0], [0.5, None], [1.5, None]), ("A", 2, [10.0, 20.0], [-0.5, 3.0], [9.5, 23.0])], "ticker string, t0 int, fitted array<double>, residual array<double>, optional array<double>")
    moved = spark.createDataFrame([("A", 1, 2), ("A", 2, 1)], "ticker string, t0 int, src_t0 int")
    out = nulls.conditional_null(fit, moved)
    assert {r.t0: r.rebuilt for r in out.collect()} == {1: [0.5, 5.0], 2: [10.5, None]}  # missing values move along
    assert nulls.marginal_drift(out, 2).first().marginal_drift == pytest.approx((abs(5.0 - 4.0) + 0) / 2)


def units(values, **more):
    return [(k, "A", v) for k, v in enumerate(values)]


def state_after(spark, batches, statistic=0.5):
    state = nulls.begun(spark.createDataFrame([("A", statistic), ("Z", 1.0)], "ticker string, statistic double"), ["ticker"])
    for b in batches:
        state = nulls.advanced(state, spark.createDataFrame(b, "permutation int, ticker string, t double"), ["ticker"])
    return {r.ticker: r for r in nulls.verdicts(state, ["ticker"]).collect()}


def test_sequential_verdicts(spark):
    quiet = units([0.1] * 50)
    passed = state_after(spark, [quiet])["A"]
    assert (passed.verdict, passed.permutations_executed, passed.p_mc) == ("passed", 50, round(1 / 51, 6))
    assert passed.final_p_lower_bound is None
    short = state_after(spark, [units([0.9, 0.1])])
    assert (short["A"].verdict, short["A"].exceedances, short["A"].p_mc) == ("incomplete", 1, None)
    assert (short["Z"].verdict, short["Z"].permutations_executed) == ("incomplete", 0)
    loud = state_after(spark, [units([0.9, 0.1, 0.5, 0.9, None, 0.9, 0.9] + [0.9] * 43)])["A"]
    assert (loud.verdict, loud.permutations_executed, loud.exceedances, loud.final_p_lower_bound) == ("rejected_early", 7, 5, round(6 / 51, 6))
    assert loud.null_max == 0.9 and loud.null_median == 0.9
    four = state_after(spark, [units([0.9] * 4 + [0.1] * 46)])["A"]
    assert (four.verdict, four.p_mc) == ("passed", round(5 / 51, 6))


def test_replayed_and_late_batches_change_nothing(spark):
    x = units([0.9, 0.1, 0.9, 0.9, 0.1, 0.9, 0.1, 0.9, 0.1])
    whole = state_after(spark, [x])["A"]
    assert whole.verdict == "rejected_early" and whole.permutations_executed == 8
    for batches in ([x[:4], x[:4], x[2:]], [x[5:], x[:5], x], [x[1::2], x[::2], x[3:6]]):
        assert state_after(spark, batches)["A"] == whole
    gap = state_after(spark, [x[:3] + x[4:]])["A"]  # the fourth is not there yet
    assert (gap.verdict, gap.permutations_executed) == ("incomplete", 3)
    assert state_after(spark, [x[:2], [(0, "A", 0.0), (1, "A", 9.0)], x])["A"] == whole  # what came first counts


def test_displacement_and_repeated_draws(spark):
    observed = spark.createDataFrame([("A", 0.5)], "ticker string, statistic double")
    kind = "permutation int, ticker string, t double, index_hash string, displaced int, n_blocks int"
    after = lambda rows: nulls.verdicts(nulls.advanced(nulls.begun(observed, ["ticker"]), spark.createDataFrame(rows, kind), ["ticker"]), ["ticker"]).collect()
    assert after([(0, "A", 0.1, "h0", 6, 8), (1, "A", 0.1, "h1", 5, 8)])[0].min_displaced_fraction == 0.625
    with pytest.raises(Exception, match="drawn twice"):
        after([(0, "A", 0.1, "h0", 6, 8), (1, "A", 0.1, "h0", 5, 8)])


def test_reorderings_move_half_or_fail(spark):
    x = search.blocks(spark.createDataFrame([(t, i * 10) for t, n in (("A", 30), ("B", 4)) for i in range(n)], "ticker string, t0 int"), 10)
    order = search.orders(x, 42, 1)
    for r in search.draws(order).collect():
        assert r.displaced * 2 >= r.n_blocks and r.n_blocks == {"A": 30, "B": 4}[r.ticker] and len(r.index_hash) == 16
    alone = search.blocks(spark.createDataFrame([("A", 0)], "ticker string, t0 int"), 10)
    with pytest.raises(Exception, match="no reordering moves enough"):
        search.orders(alone, 42, 1).collect()


def test_segment_reordering_keeps_segments(spark):
    times = spark.createDataFrame([("A", i) for i in range(0, 400, 3)], "ticker string, t0 int")
    x = search.grouped_blocks(times, 24, 4)
    of = {r.t0: r.segment for r in x.collect()}
    moved = search.permuted(x, search.orders(x, 1, 1)).collect()
    assert all(of[r.t0] == of[r.src_t0] for r in moved) and any(r.t0 != r.src_t0 for r in moved)
    p = search.draws(search.orders(x, 1, 1)).first()
    assert p.segments == 4 and sum(p.blocks_per_segment) == p.n_blocks and 2 * p.displaced >= p.n_blocks


def test_short_spans_have_segments_of_one_bar(spark):
    x = search.macro_segments(spark.createDataFrame([("A", 10), ("A", 11)], "ticker string, t0 int"), 4)
    assert {r.t0: r.segment for r in x.collect()} == {10: 0, 11: 1}
