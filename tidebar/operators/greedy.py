"""Searches: forward selection, family by family, over normal equations, and draws of parameters with median pruning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.folds import running
from tidebar.operators.search import complexity

#: Sums that a task keeps before it sends them on.
KEPT_SUMS = 500


@dataclass(frozen=True)
class Gates:
    """Fixed values by default: what a feature must gain alone, the cost of each further one, the share of folds it must win, the final gain, how many may be taken, variants tried of an accepted family, least rows to judge by."""

    feature_gain: float = 0.008
    penalty: float = 0.004
    fold_share: float = 0.5
    final_gain: float = 0.005
    most: int = 6
    family_cap: int = 3
    least_rows: int = 8


def _one_se(members: list[dict]) -> tuple[list[int], int]:
    """The ids within one standard error of the best member's mean, and the best."""
    best = min(members, key=lambda v: (-v["mean"], v["id"]))
    deltas = np.array([d for d in best["deltas"] if d is not None])
    se = deltas.std(ddof=1) / np.sqrt(len(deltas)) if len(deltas) > 1 else 0.0
    return [v["id"] for v in members if v["mean"] >= best["mean"] - se], best["id"]


class Scores:
    """What a subset of features explains of each fold's validation rows, by models fitted to its training rows: both read off sums of products."""

    def __init__(self, training: list[np.ndarray], validation: list[np.ndarray], ridge: float):
        self.training, self.validation, self.ridge = training, validation, ridge

    def of(self, columns: list[int]) -> list[float | None]:
        """1 less the squared error over that of the mean, by fold; null where a fold cannot tell. Products are of (1, features, target)."""
        at, out = [0, *columns], []
        for g, v in zip(self.training, self.validation, strict=True):
            rows, total = v[0, 0], v[-1, -1] - (v[0, -1] ** 2 / v[0, 0] if v[0, 0] else 0.0)
            if rows < 1 or total <= 1e-12 or g[0, 0] < len(at) + 1:
                out.append(None)
                continue
            own = g[np.ix_(at, at)]
            # strengths are relative to each column's spread; the intercept has none
            strength = self.ridge * np.maximum(np.diag(own) - g[0, at] ** 2 / g[0, 0], 0.0)
            strength[1:] += 1e-12 * np.maximum(np.diag(own)[1:], 1e-300)
            b = np.linalg.solve(own + np.diag(strength), g[at, -1])
            error = v[-1, -1] - 2 * b @ v[at, -1] + b @ v[np.ix_(at, at)] @ b
            out.append(float(1 - error / total))
        return out


def _mean(folds: list[float | None]) -> float | None:
    some = [f for f in folds if f is not None]
    return float(np.mean(some)) if some else None


def _won(base: list[float | None], own: list[float | None]) -> float:
    both = [(b, c) for b, c in zip(base, own, strict=True) if b is not None and c is not None]
    return sum(c > b for b, c in both) / len(both) if both else 0.0


def walk(scores: Scores, core: list[int], candidates: list[dict], gates: Gates) -> dict:
    """One ticker's search. candidates: id, column, family, simplicity (sorts), by id."""
    column = {c["id"]: c["column"] for c in candidates}
    base = scores.of(core)
    base_mean = _mean(base)
    found = {"selected": [], "base": base_mean, "best": base_mean, "gain": 0.0, "families": [], "stage": "core_only"}
    if base_mean is None:
        return found | {"stage": "no_valid_folds", "stop_reason": "no_valid_baseline"}
    if sum(v[0, 0] for v in scores.validation) < gates.least_rows:
        return found | {"stage": "thin", "stop_reason": "baseline_below_least_rows"}
    survivors: dict[str, list[dict]] = {}
    for c in candidates:
        folds = scores.of([*core, c["column"]])
        mean = _mean(folds)
        if mean is not None and mean - base_mean >= gates.feature_gain and _won(base, folds) >= gates.fold_share:
            deltas = [None if a is None or b is None else a - b for a, b in zip(folds, base, strict=True)]
            survivors.setdefault(c["family"], []).append(c | {"mean": mean - base_mean, "deltas": deltas})
    simple = {c["id"]: (c["simplicity"], c["id"]) for c in candidates}
    heads = {f: min(_one_se(vs)[0], key=simple.__getitem__) for f, vs in survivors.items()}
    order = sorted(heads, key=lambda f: (-max(v["mean"] for v in survivors[f]), heads[f]))
    state = {"taken": [], "pen": base_mean, "folds": base}

    def taken(i: int) -> bool:
        folds = scores.of([*core, *(column[t] for t in state["taken"]), column[i]])
        mean = _mean(folds)
        if mean is None:
            return False
        pen = mean - gates.penalty * (len(state["taken"]) + 1)
        if pen <= state["pen"] + 1e-6 or _won(state["folds"], folds) < gates.fold_share:
            return False
        state.update(taken=[*state["taken"], i], pen=pen, folds=folds)
        return True

    full = lambda: len(state["taken"]) >= gates.most
    stop = None
    accepted: list[str] = []
    for f in order:
        if full():
            stop = "max_select_reached"
            break
        if taken(heads[f]):
            accepted.append(f)
    for f in accepted if stop is None else []:
        for v in sorted((v for v in survivors[f] if v["id"] != heads[f]), key=lambda v: (-v["mean"], v["id"]))[: gates.family_cap]:
            if full():
                stop = "max_select_reached"
                break
            taken(v["id"])
        if stop:
            break
    stop = stop or ("pool_exhausted" if heads else "no_candidate_passed_marginal_gates")
    best = _mean(state["folds"]) if state["taken"] else base_mean
    applied = bool(state["taken"]) and best >= base_mean + gates.final_gain
    if state["taken"] and not applied:
        stop = "final_subset_below_min_gain"
    return found | {"selected": sorted(state["taken"]) if applied else [], "best": best, "gain": best - base_mean if applied else 0.0, "families": accepted, "stage": "auto_selected" if applied else "core_only", "stop_reason": stop}


def ladder(scores: Scores, core: list[int], candidates: list[dict], gates: Gates) -> list[dict]:
    """One ticker's register: the core, every candidate alone, every family whole, and what the search takes, each with its gain over the core and its share of folds won."""
    base = scores.of(core)
    base_mean = _mean(base)
    if base_mean is None:
        return []

    def row(kind: str, name: str, members: list[dict]) -> dict:
        folds = scores.of([*core, *(c["column"] for c in members)])
        mean = _mean(folds)
        gain = None if mean is None else mean - base_mean
        share = _won(base, folds)
        return {"kind": kind, "unit": name, "members": [c["id"] for c in members], "gain": gain, "fold_share": share, "passes": gain is not None and gain >= gates.feature_gain and share >= gates.fold_share}

    singles = [row("single", str(c["id"]), [c]) for c in candidates]
    gain = {r["members"][0]: r["gain"] for r in singles}
    families = []
    for name in sorted({c["family"] for c in candidates}):
        members = [c for c in candidates if c["family"] == name]
        told = [c["id"] for c in members if gain[c["id"]] is not None]
        best = min(told, key=lambda i: (-gain[i], i)) if told else None
        families.append(row("family", name, members) | {"best_member": best, "best_member_gain": gain.get(best)})
    taken = walk(scores, core, candidates, gates)["selected"]
    return [row("core", "core", []), *singles, *families, row("greedy", "greedy", [c for c in candidates if c["id"] in taken])]


def family_first(rows: DataFrame, core: list[str], candidates: DataFrame, folds: DataFrame, target: str = "y", gates: Gates = Gates(), ridge: float = 1e-6) -> DataFrame:
    """ticker, selected, base, best, gain, families, stage, stop_reason: the features that a ticker's target needs beside the core.

    rows: ticker, t0, features, target. candidates: id, feature (a column of rows), family, formula; a small list. folds: ticker, fold, role (train, val), lo, hi
    (lo <= t0 < hi). Each candidate is tried alone; those that clear the gates compete by family, first the simplest within one standard error of each
    family's best, in order of the families' best gains, then the variants of accepted families. No model sees the
    rows again: products of all columns are summed once for each stretch between two borders of folds, in one pass, and a subset's fit and error on any fold are read off
    sums of them. Rows with a missing value are left out; a ticker without rows or folds has none.
    """
    kind = {"selected": "array<long>", "base": "double", "best": "double", "gain": "double", "families": "array<string>", "stage": "string", "stop_reason": "string"}
    return _by_ticker(rows, core, candidates, folds, target, ridge, lambda *x: [walk(*x, gates)], kind)


def utility_register(rows: DataFrame, core: list[str], candidates: DataFrame, folds: DataFrame, target: str = "y", gates: Gates = Gates(), ridge: float = 1e-6) -> DataFrame:
    """ticker, kind (core, single, family, greedy), unit, members, gain, fold_share, passes, best_member, best_member_gain: what each candidate, each family as a whole and the searched subset add to the core. Inputs as for family_first(...); a ticker whose core cannot be scored has no rows."""
    kind = {"kind": "string", "unit": "string", "members": "array<long>", "gain": "double", "fold_share": "double", "passes": "boolean", "best_member": "long", "best_member_gain": "double"}
    return _by_ticker(rows, core, candidates, folds, target, ridge, lambda *x: ladder(*x, gates), kind)


_ARROW = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _by_ticker(rows: DataFrame, core: list[str], candidates: DataFrame, folds: DataFrame, target: str, ridge: float, report: Callable[[Scores, list[int], list[dict]], list[dict]], kind: dict[str, str]) -> DataFrame:
    """ticker and the report's columns: products summed by stretch, then one small search for each ticker."""
    listed = sorted((r.asDict() for r in candidates.select("id", "feature", "family", complexity(F.col("formula")).alias("simplicity")).collect()), key=lambda c: c["id"])
    names = [*core, *[c["feature"] for c in listed]]
    m = len(names) + 2
    known = [{"id": c["id"], "family": c["family"], "simplicity": tuple(c["simplicity"]), "column": len(core) + 1 + i} for i, c in enumerate(listed)]
    borders = folds.groupBy("ticker").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("lo", "hi"))))).alias("_edges"))
    v = F.array(*[F.col(c).cast("double") for c in [*names, target]])
    x = rows.select("ticker", "t0", v.alias("v")).where("t0 IS NOT NULL").where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e))).join(borders, "ticker")
    x = x.select("ticker", F.size(F.filter("_edges", lambda e: e <= F.col("t0"))).alias("part"), "v")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held], pa.int32()), pa.array([s.ravel().tolist() for s in held.values()], pa.list_(pa.float64()))], ["ticker", "part", "s"])

        for batch in batches:
            values = np.column_stack([np.ones(batch.num_rows), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, m - 1)])
            tickers, of = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            key = of.astype(np.int64) << 32 | batch.column(1).to_numpy()
            for k in np.unique(key):
                own = values[key == k]
                at = str(tickers[k >> 32]), int(k & 0xFFFFFFFF)
                held[at] = held.get(at, 0.0) + own.T @ own
            if len(held) > KEPT_SUMS:
                yield sent()
                held = {}
        if held:
            yield sent()

    def search(key: tuple, sums: pa.Table, splits: pa.Table) -> pa.Table:
        """One ticker: as many products as stretches and tasks, and its folds."""
        types = {"ticker": "string"} | kind
        if not sums.num_rows:
            return pa.table({n: pa.array([], _ARROW[t]) for n, t in types.items()})
        edges = sorted({*splits.column("lo").to_pylist(), *splits.column("hi").to_pylist()})
        parts = np.zeros((len(edges) + 1, m, m))
        np.add.at(parts, sums.column("part").to_numpy(), np.array(sums.column("s").to_pylist()).reshape(-1, m, m))
        roles = {r["fold"]: {} for r in splits.to_pylist()}
        for r in splits.to_pylist():
            between = parts[edges.index(r["lo"]) + 1 : edges.index(r["hi"]) + 1].sum(axis=0)
            roles[r["fold"]][r["role"]] = roles[r["fold"]].get(r["role"], 0.0) + between
        both = [r for _, r in sorted(roles.items()) if len(r) == 2]
        out = report(Scores([r["train"] for r in both], [r["val"] for r in both], ridge), list(range(1, len(core) + 1)), known)
        return pa.table({n: pa.array([key[0].as_py() if n == "ticker" else o.get(n) for o in out], _ARROW[t]) for n, t in types.items()})

    sums = x.mapInArrow(gather, "ticker string, part int, s array<double>")
    splits = folds.select("ticker", "fold", "role", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    return sums.groupBy("ticker").cogroup(splits.groupBy("ticker")).applyInArrow(search, ", ".join(f"{n} {t}" for n, t in ({"ticker": "string"} | kind).items()))


def drawn(trials: DataFrame, space: list[dict], seed: int) -> DataFrame:
    """trials with a column for each parameter of the space, drawn by a hash of seed, ticker, trial and name.

    trials: ticker, trial, hessian. space: name, low, high, and if wanted whole (both ends included), log, or relative (the draw counts in units of hessian; the draw itself is kept as <name>_relative).
    """
    out = {}
    for p in space:
        digits = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), "ticker", F.col("trial").cast("string"), F.lit(p["name"]))), 1, 13)
        u = F.conv(digits, 16, 10).cast("long") / float(2**52)
        low, high = float(p["low"]), float(p["high"])
        if p.get("whole"):
            value: Column = (F.floor(u * (high - low + 1)) + F.lit(int(low))).cast("int")
        elif p.get("log"):
            value = F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))
        else:
            value = F.lit(low) + u * (high - low)
        if p.get("relative"):
            out[f"{p['name']}_relative"], value = value, value * F.col("hessian")
        out[p["name"]] = value
    return trials.withColumns(out)


def pruned(steps: DataFrame, keys: list[str], startup: int = 5, warmup: int = 0) -> DataFrame:
    """keys, trial, state (complete, pruned, failed), steps_run, score, best: which trials of a study run to their end.

    steps: keys, trial, step (from 0), score so far. Trials are taken in order. At each step from `warmup` on, once `startup` trials have completed, a trial goes on only if
    its best score so far is not below the median of the completed trials' scores at that step. A trial without steps failed; the best
    is the completed trial with the highest last score, the first of equal ones. A study's trials, not its rows, are one ordered pass.
    """
    scores = F.transform(F.array_sort(F.collect_list(F.struct("step", "score"))), lambda s: s["score"])
    each = steps.groupBy(*keys, "trial").agg(scores.alias("scores"))

    def median(at: Column, done: Column) -> Column:
        there = F.array_sort(F.filter(F.transform(done, lambda d: F.get(d["scores"], at)), lambda v: v.isNotNull()))
        n = F.size(there)
        return (F.get(there, F.floor((n - 1) / 2).cast("int")) + F.get(there, F.floor(n / 2).cast("int"))) / 2

    def step(state: Column, row: Column) -> Column:
        own, done = row["scores"], state["done"]
        below = lambda i: F.coalesce(F.array_max(F.slice(own, F.lit(1), i + 1)) < median(i, done), F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i >= warmup) & below(i))
        stop = F.when((F.size(done) >= startup) & (F.size(own) > 0), F.get(at, F.lit(0)))
        ends = stop.isNull() & (F.size(own) > 0)
        return F.struct(F.when(ends, F.array_append(done, F.struct(own.alias("scores")))).otherwise(done).alias("done"), stop.alias("stop"))

    start = {"done": None, "stop": None}
    kind = "`done`: array<struct<scores: array<double>>>, `stop`: int"
    x = running(each, keys, ["trial"], start, kind, lambda s, r: step(F.struct(F.coalesce(s["done"], F.array().cast("array<struct<scores: array<double>>>")).alias("done")), r))
    stop = F.col("state.stop")
    state = F.when(F.size("scores") == 0, "failed").when(stop.isNotNull(), "pruned").otherwise("complete")
    run = F.coalesce(stop + 1, F.size("scores"))
    y = x.select(*keys, "trial", state.alias("state"), run.alias("steps_run"), F.get("scores", run - 1).alias("score"))
    first = F.min(F.when(F.col("state") == "complete", F.struct((-F.col("score")).alias("s"), "trial"))).over(Window.partitionBy(*keys))["trial"]
    return y.withColumn("best", F.coalesce(F.col("trial") == first, F.lit(False)))
