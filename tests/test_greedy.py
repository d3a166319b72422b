"""Family-first selection against refitting every model on its rows; draws and pruning against plain loops."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest

from tidebar.operators import greedy
from tidebar.operators.greedy import Gates

CANDIDATES = [(11, "a1", "a", "mean(c, 5)"), (12, "a2", "a", "mean(c, 50)"), (13, "a3", "a", "mean(c, 9)"), (21, "b1", "b", "std(c, 10)"), (31, "n1", "n", "min(c, 3)"), (32, "n2", "n", "max(c, 3)")]
FOLDS = [(k, 0, 150 + 100 * k, 160 + 100 * k, 260 + 100 * k) for k in range(4)]  # fold, train from, to, validation from, to


def table(seed: int, n: int = 560, strength: float = 1.0):
    rng = np.random.Generator(np.random.PCG64(seed))
    c, a, b = rng.normal(size=(3, n))
    x = {"core": c + 50, "a1": a + 0.4 * rng.normal(size=n), "a2": a + 0.38 * rng.normal(size=n), "a3": a + 0.42 * rng.normal(size=n), "b1": b * 0.01, "n1": rng.normal(size=n), "n2": rng.normal(size=n)}
    y = 0.5 * c + strength * a + strength * 0.6 * b + rng.normal(size=n)
    return x, y


def brute(x, y, gates: Gates):
    """The search with a least-squares fit of every model on the rows of every fold."""
    t = np.arange(len(y))

    def score(names):
        out = []
        for _, a, b, lo, hi in FOLDS:
            tr, te = (t >= a) & (t < b), (t >= lo) & (t < hi)
            design = lambda m: np.column_stack([np.ones(m.sum()), *(x[n][m] for n in names)])
            w = np.linalg.lstsq(design(tr), y[tr], rcond=None)[0]
            out.append(1 - ((y[te] - design(te) @ w) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
        return out

    share = lambda p, q: sum(b > a for a, b in zip(p, q)) / len(p)
    of, fam = {i: n for i, n, _, _ in CANDIDATES}, {i: f for i, _, f, _ in CANDIDATES}
    size = {11: 5, 12: 50, 13: 9, 21: 10, 31: 3, 32: 3}
    base = score(["core"])
    alone = {i: score(["core", of[i]]) for i in of}
    gains = {i: np.mean(s) - np.mean(base) for i, s in alone.items()}
    live = [i for i in of if gains[i] >= gates.feature_gain and share(base, alone[i]) >= gates.fold_share]
    families = {f: [i for i in live if fam[i] == f] for f in dict.fromkeys(fam[i] for i in live)}
    heads = {}
    for f, ids in families.items():
        best = max(ids, key=lambda i: (gains[i], -i))
        deltas = [q - p for p, q in zip(base, alone[best])]
        se = statistics.stdev(deltas) / math.sqrt(len(deltas))
        heads[f] = min((i for i in ids if gains[i] >= gains[best] - se), key=lambda i: (size[i], i))
    taken, pen, now, won = [], np.mean(base), base, []

    def attempt(i):
        nonlocal taken, pen, now
        s = score(["core", *(of[k] for k in taken), of[i]])
        p = np.mean(s) - gates.penalty * (len(taken) + 1)
        if len(taken) < gates.most and p > pen + 1e-6 and share(now, s) >= gates.fold_share:
            taken, pen, now = [*taken, i], p, s
            return True
        return False

    for f in sorted(heads, key=lambda f: -max(gains[i] for i in families[f])):
        if attempt(heads[f]):
            won.append(f)
    for f in won:
        for i in sorted((i for i in families[f] if i != heads[f]), key=lambda i: -gains[i])[: gates.family_cap]:
            attempt(i)
    return (sorted(taken) if np.mean(now) >= np.mean(base) + gates.final_gain else []), np.mean(base), np.mean(now), won


@pytest.mark.parametrize("gates", [Gates(), Gates(penalty=0.0, family_cap=1), Gates(most=1), Gates(feature_gain=0.0, penalty=-0.01, most=9)])
def test_selection_equals_refitting(spark, gates):
    rows, want = [], {}
    for k, strength in (("A", 1.0), ("B", 0.3), ("C", 0.0)):
        x, y = table(ord(k), strength=strength)
        want[k] = brute(x, y, gates)
        rows += [(k, i, *(float(v[i]) for v in x.values()), float(y[i])) for i in range(len(y))]
    names = list(x)
    rows += [("A", 5, *[None] * len(names), 1.0), ("A", None, *[0.0] * len(names), 1.0), ("A", -3, *[9.0] * len(names), 99.0), ("Z", 5, *[0.0] * len(names), 1.0)]
    frame = spark.createDataFrame(rows, "ticker string, t0 int, " + ", ".join(f"{n} double" for n in names) + ", y double").selectExpr("*", "1 AS part", "2 AS s").repartition(4)
    folds = [(k, f, role, lo, hi) for k in "ABCX" for f, a, b, c, d in FOLDS for role, lo, hi in (("train", a, b), ("val", c, d))]
    got = greedy.family_first(frame, ["core"], spark.createDataFrame(CANDIDATES, "id int, feature string, family string, formula string"), spark.createDataFrame(folds, "ticker string, fold int, role string, lo int, hi int"), gates=gates, ridge=0.0)
    got = {r.ticker: r for r in got.collect()}
    assert set(got) == set(want)
    for k, (selected, base, best, won) in want.items():
        assert got[k].selected == selected and got[k].families == won
        assert got[k].base == pytest.approx(base, abs=1e-8) and got[k].best == pytest.approx(best, abs=1e-8)
        assert got[k].stage == ("auto_selected" if selected else "core_only")
    assert want["A"][0] and (gates.feature_gain == 0 or got["C"].stop_reason == "no_candidate_passed_marginal_gates")


def test_the_register_equals_refitting(spark):
    x, y = table(5)
    t = np.arange(len(y))

    def score(names):
        out = []
        for _, a, b, lo, hi in FOLDS:
            tr, te = (t >= a) & (t < b), (t >= lo) & (t < hi)
            design = lambda m: np.column_stack([np.ones(m.sum()), *(x[n][m] for n in names)])
            w = np.linalg.lstsq(design(tr), y[tr], rcond=None)[0]
            out.append(1 - ((y[te] - design(te) @ w) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
        return np.array(out)

    frame = spark.createDataFrame([("A", i, *(float(v[i]) for v in x.values()), float(y[i])) for i in range(len(y))], "ticker string, t0 int, " + ", ".join(f"{n} double" for n in x) + ", y double")
    folds = spark.createDataFrame([("A", f, role, lo, hi) for f, a, b, c, d in FOLDS for role, lo, hi in (("train", a, b), ("val", c, d))], "ticker string, fold int, role string, lo int, hi int")
    got = {(r.kind, r.unit): r for r in greedy.utility_register(frame, ["core"], spark.createDataFrame(CANDIDATES, "id int, feature string, family string, formula string"), folds, ridge=0.0).collect()}
    base = score(["core"])
    want = {("core", "core"): []} | {("single", str(i)): [n] for i, n, _, _ in CANDIDATES} | {("family", f): [n for _, n, g, _ in CANDIDATES if g == f] for f in "abn"}
    for unit, names in want.items():
        own = score(["core", *names])
        assert got[unit].gain == pytest.approx((own - base).mean(), abs=1e-8) and got[unit].fold_share == (own > base).mean()
    best = max((i for i, _, f, _ in CANDIDATES if f == "a"), key=lambda i: got["single", str(i)].gain)
    assert got["family", "a"].best_member == best and got["family", "a"].best_member_gain == got["single", str(best)].gain
    assert got["greedy", "greedy"].members == brute(x, y, Gates())[0] and len(got) == 11


def test_thin_and_flat_tickers(spark):
    candidates = spark.createDataFrame([(1, "x", "f", "c")], "id int, feature string, family string, formula string")
    folds = spark.createDataFrame([(k, 0, role, lo, hi) for k in "AB" for role, lo, hi in (("train", 0, 20), ("val", 20, 24))], "ticker string, fold int, role string, lo int, hi int")
    rows = [("A", i, float(i % 5), float(i % 3)) for i in range(24)] + [("B", i, float(i % 5), 1.0) for i in range(24)]
    got = {r.ticker: r for r in greedy.family_first(spark.createDataFrame(rows, "ticker string, t0 int, x double, y double"), [], candidates, folds).collect()}
    assert got["A"].stage == "thin" and got["A"].selected == []
    assert got["B"].stage == "no_valid_folds" and got["B"].base is None


def test_draws_stay_within_the_space(spark):
    space = [{"name": "depth", "low": 2, "high": 4, "whole": True}, {"name": "rate", "low": 0.01, "high": 0.3, "log": True}, {"name": "child", "low": 0.1, "high": 0.2, "relative": True}]
    x = spark.range(600).selectExpr("'A' AS ticker", "cast(id AS int) AS trial", "10.0D AS hessian")
    rows = greedy.drawn(x, space, 1).collect()
    assert {r.depth for r in rows} == {2, 3, 4} and all(0.01 <= r.rate <= 0.3 and 0.1 <= r.child_relative < 0.2 and r.child == pytest.approx(10 * r.child_relative) for r in rows)
    assert statistics.median(r.rate for r in rows) == pytest.approx(math.sqrt(0.01 * 0.3), rel=0.2)
    assert [tuple(r) for r in greedy.drawn(x, space, 1).collect()] == [tuple(r) for r in rows] != [tuple(r) for r in greedy.drawn(x, space, 2).collect()]


def study(trials, startup, warmup):
    done, out = [], {}
    for t, scores in sorted(trials.items()):
        stop = None
        for s in range(len(scores)):
            there = [d[s] for d in done if len(d) > s]
            if len(done) >= startup and s >= warmup and there and max(scores[: s + 1]) < statistics.median(there):
                stop = s
                break
        out[t] = ("failed", 0, None) if not scores else ("complete", len(scores), scores[-1]) if stop is None else ("pruned", stop + 1, scores[stop])
        if scores and stop is None:
            done.append(scores)
    ends = [(-v[2], t) for t, v in out.items() if v[0] == "complete"]
    return {t: (*v, bool(ends) and t == min(ends)[1]) for t, v in out.items()}


@pytest.mark.parametrize(("startup", "warmup"), [(5, 0), (2, 1), (0, 0), (1, 9)])
def test_pruning_equals_one_trial_after_the_other(spark, startup, warmup):
    rng = random.Random(7)
    studies = {k: {t: [round(rng.gauss(0, 1), 1) for _ in range(rng.choice([1, 4, 4, 4]))] for t in range(40)} for k in "AB"} | {"C": {0: [1.0, 1.0], 1: [1.0, 1.0]}}
    rows = [(k, t, s, v) for k, trials in studies.items() for t, scores in trials.items() for s, v in enumerate(scores)]
    got = greedy.pruned(spark.createDataFrame(rows, "ticker string, trial int, step int, score double").repartition(3), ["ticker"], startup, warmup).collect()
    for k, trials in studies.items():
        assert {r.trial: (r.state, r.steps_run, r.score, r.best) for r in got if r.ticker == k} == study(trials, startup, warmup)
