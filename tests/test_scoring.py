"""Fitted scores against their objective's own optimum, and weights by hand."""

from __future__ import annotations

import numpy as np
import pytest

from tidebar.operators import scoring


def frame(spark, x: np.ndarray, y: np.ndarray, w: np.ndarray):
    rows = [("A", i, *map(float, r), float(k), float(v)) for i, (r, k, v) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "ticker string, t0 int, a double, b double, y double, weight double")


def test_logistic_is_the_optimum_of_its_objective(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, [1, 5], (300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.2, -0.3] + 0.4)))).astype(float)
    w = rng.uniform(0.2, 1, 300)
    d = frame(spark, x, y, w)
    got = np.array([r.p for r in scoring.logistic(d, d, ["a", "b"]).orderBy("t0").collect()])
    # weighted mean log-loss and 0.01 / 2 times the squares of the coefficients of standardised features
    mean = (w[:, None] * x).sum(0) / w.sum()
    dev = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w**2).sum() / w.sum()))
    z = np.column_stack([np.ones(300), x / dev])
    beta = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        ridge = np.array([0, 0.01, 0.01])
        gradient = z.T @ (w * (p - y)) / w.sum() + ridge * beta
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(ridge), gradient)
    assert np.abs(got - 1 / (1 + np.exp(-z @ beta))).max() < 2e-3


def test_boosted_trees_learn_what_no_line_separates(spark):
    x = np.array([(a, b) for a in (0, 1) for b in (0, 1)] * 30, float)
    y = (x[:, 0] != x[:, 1]).astype(float)
    d = frame(spark, x, y, np.linspace(0.9, 1.1, len(y)))
    got = [r.p for r in scoring.boosted(d, d, ["a", "b"], trees=5).orderBy("t0").collect()]
    assert all((p > 0.5) == (k == 1) for p, k in zip(got, y, strict=True)) and all(0 < p < 1 for p in got)


def test_class_balance_and_hessian_by_hand(spark):
    d = spark.createDataFrame([(1.0, 1.0, 0.5), (1.0, 2.0, 0.5), (0.0, 6.0, 0.25)], "y double, weight double, p double")
    assert scoring.class_balance(d).first().pos_weight == 2.0
    assert scoring.hessian_total(d).first().hessian == pytest.approx(0.75 + 6 * 0.1875)
