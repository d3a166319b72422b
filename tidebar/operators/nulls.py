"""Null runs: the conditional residual null with its cross-fitted ridge, and a sequential test that stops early."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.sources.stores import kept

#: Strengths of the ridge that are tried, folds, embargo in bars, least rows to fit on.
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
FOLDS, EMBARGO, LEAST_ROWS = 5, 35, 50
#: Permutations of a full test, and the exceedances with which it can no longer pass.
PERMUTATIONS, FUTILITY = 50, 5
#: Rows of a ticker are numbered in stretches of this many bars.
STRETCH = 1024
#: Sums that a task keeps before it sends them on.
KEPT_SUMS = 2_000


def numbered(rows: DataFrame, order: str = "t0") -> DataFrame:
    """rows with `position` (from 0) and `n` of their ticker; stretches are numbered side by side and then moved by the rows before them."""
    x = rows.withColumn("_stretch", F.floor(F.col(order) / STRETCH))
    by = Window.partitionBy("ticker")
    counts = x.groupBy("ticker", "_stretch").agg(F.count(F.lit(1)).alias("_k")).select("ticker", "_stretch", (F.sum("_k").over(by.orderBy("_stretch")) - F.col("_k")).alias("_before"), F.sum("_k").over(by).alias("n"))
    place = F.row_number().over(Window.partitionBy("ticker", "_stretch").orderBy(order)) - 1
    return x.withColumn("_place", place).join(counts, ["ticker", "_stretch"]).withColumn("position", F.col("_place") + F.col("_before")).drop("_stretch", "_place", "_before")


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What normal equations need of some rows: n, x, xx', and by target its number, sum, and the x and xy of rows that have it."""
    has = ~np.isnan(y)
    filled = np.where(has, y, 0.0)
    return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel(), has.sum(0), filled.sum(0), (x.T @ has).ravel(), (x.T @ filled).ravel()])


def _solved(s: np.ndarray, p: int, q: int, alphas: tuple[float, ...], least: int) -> np.ndarray:
    """alphas x targets x (intercept, p slopes) from the sums of the training rows."""
    out = np.zeros((len(alphas), q, p + 1))
    n, sx, sxx, ny, sy, sxh, sxy = np.split(s, np.cumsum([1, p, p * p, q, q, p * q]))
    n = n[0]
    mean_y = np.divide(sy, ny, out=np.zeros(q), where=ny > 0)
    out[:, :, 0] = mean_y
    if n < max(least, 1):
        return out
    mean = sx / n
    cov = sxx.reshape(p, p) - n * np.outer(mean, mean)
    some = (np.diag(cov) > 1e-12 * np.diag(sxx.reshape(p, p))).astype(float)  # a column that stands still has no slope
    dev = np.where(some > 0, np.sqrt(np.maximum(np.diag(cov) / n, 0.0)) + 1e-12, 1.0)
    gram = cov / np.outer(dev, dev) * np.outer(some, some)
    # a missing target stands at its mean, so only rows that have it add to the right side
    right = (sxy.reshape(p, q) - mean_y * sxh.reshape(p, q)) / dev[:, None] * some[:, None]
    for i, a in enumerate(alphas):
        slopes = np.linalg.solve(gram + a * np.eye(p), right) / dev[:, None]
        out[i, :, 1:] = slopes.T
        out[i, :, 0] = mean_y - mean @ slopes
    return out


def _predicted(b: Column, x: Column, p: int) -> Column:
    return F.transform(b, lambda w: F.aggregate(F.zip_with(F.slice(w, 2, p), x, lambda c, v: c * v), F.element_at(w, 1), lambda s, v: s + v))


def ridge_crossfit(rows: DataFrame, core: list[str], optional: list[str], folds: int = FOLDS, embargo: int = EMBARGO, least: int = LEAST_ROWS, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """ticker, t0, fold, alpha, recon_mse, optional, fitted, residual: what the core features explain of the optional ones, by models that never saw the row or its neighbours.

    A ticker's rows are cut into contiguous folds of equal number; the model of a fold learns from the rows farther than `embargo`
    bars from it. alpha is the ticker's strength with the least mean error of reconstruction over its folds, the smallest of equal ones; no outcome enters.
    A row belongs to the training rows of several folds: sums are kept by which folds it is outside of, in one pass, and
    a fold's normal equations add those that leave it out. Missing optional values (null, NaN) count with the column's mean where the model learns, not at
    all in the error, and stay null in the residual. A fold with fewer than `least` training rows gets their means, a ticker
    with such folds only has a null alpha. Rows without ticker, t0 or a core value are left out.
    """
    p, q = len(core), len(optional)
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    x = rows.select("ticker", "t0", F.array(*[real(c) for c in core]).alias("x"), F.array(*[real(c) for c in optional]).alias("y"))
    x = x.where(F.col("ticker").isNotNull() & F.col("t0").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    x = numbered(kept(x)).withColumn("fold", F.floor(((F.col("position") + 1) * folds - 1) / F.col("n")).cast("int"))
    edges = x.groupBy("ticker", "fold").agg(F.min("t0").alias("lo"), F.max("t0").alias("hi"), F.count(F.lit(1)).alias("k"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(p)])
    # every column is taken less its mean, so that sums of squares lose no digits
    per = edges.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("fold", (F.col("lo") - embargo).alias("lo"), (F.col("hi") + embargo).alias("hi")))).alias("near"), F.array(*[F.sum(f"s{i}") / F.sum("k") for i in range(p)]).alias("center"))
    x = x.join(per, "ticker").withColumn("x", F.zip_with("x", "center", lambda a, b: a - b))
    inside = F.aggregate("near", F.lit(0), lambda m, r: m + F.when((F.col("t0") >= r["lo"]) & (F.col("t0") <= r["hi"]), F.pow(F.lit(2.0), r["fold"]).cast("int")).otherwise(0))
    x = kept(x.withColumn("outside", inside).select("ticker", "t0", "fold", "outside", "x", "y"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held], pa.int32()), pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))], ["ticker", "outside", "s"])

        for batch in batches:
            wide = lambda c, n: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)  # noqa: B023, E731
            xs, ys = wide(2, p), wide(3, q)
            names, of = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            outside = batch.column(1).to_numpy()
            key = of.astype(np.int64) << 32 | outside
            for k in np.unique(key):
                own = key == k
                at = str(names[k >> 32]), int(k & 0xFFFFFFFF)
                held[at] = held.get(at, 0.0) + _sums(xs[own], ys[own])
            if len(held) > KEPT_SUMS:
                yield sent()
                held = {}
        if held:
            yield sent()

    def solve(group: pa.Table) -> pa.Table:
        """One ticker's sums, as many as ways to lie near folds and tasks that have some."""
        outside, sums = group.column("outside").to_numpy(), np.array(group.column("s").to_pylist())
        found = []
        for k in range(folds):
            training = sums[(outside >> k) & 1 == 0].sum(axis=0) if len(sums) else sums
            found.append((int(training[0]), _solved(training, p, q, alphas, least).tolist()))
        ticker = group.column("ticker")[0].as_py()
        return pa.table({"ticker": [ticker] * folds, "fold": pa.array(range(folds), pa.int32()), "n_train": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.list_(pa.list_(pa.list_(pa.float64()))))})

    sums = x.select("ticker", "outside", "x", "y").mapInArrow(gather, "ticker string, outside int, s array<double>")
    models = kept(sums.groupBy("ticker").applyInArrow(solve, "ticker string, fold int, n_train long, b array<array<array<double>>>"))
    x = x.join(models, ["ticker", "fold"])
    missed = lambda i: F.aggregate(F.zip_with(_predicted(F.get("b", F.lit(i)), F.col("x"), p), "y", lambda f, y: F.coalesce((f - y) * (f - y), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    cells = F.sum(F.size(F.filter("y", lambda v: v.isNotNull())))
    errors = x.where(F.col("n_train") >= least).groupBy("ticker", "fold").agg(cells.alias("cells"), *[F.sum(missed(i)).alias(f"e{i}") for i in range(len(alphas))]).where("cells > 0")
    means = errors.groupBy("ticker").agg(F.array(*[F.avg(F.col(f"e{i}") / F.col("cells")) for i in range(len(alphas))]).alias("mse"))
    best = means.select("ticker", F.array_min("mse").alias("recon_mse"), (F.array_position("mse", F.array_min("mse")) - 1).cast("int").alias("i"))
    x = x.join(best, "ticker", "left").withColumn("fitted", _predicted(F.get("b", F.coalesce("i", F.lit(0))), F.col("x"), p))
    strength = F.get(F.array(*[F.lit(a) for a in alphas]), F.col("i"))
    return x.select("ticker", "t0", "fold", strength.alias("alpha"), "recon_mse", F.col("y").alias("optional"), "fitted", F.zip_with("y", "fitted", lambda y, f: y - f).alias("residual"))


def ridge_summary(fit: DataFrame, columns: int) -> DataFrame:
    """ticker, alpha, recon_mse, residual_share, nan_columns of ridge_crossfit(...): the share of the optional columns' variance that the core leaves."""
    var = lambda c: [F.var_pop(F.get(c, F.lit(i))) for i in range(columns)]
    total = lambda vs: sum((F.coalesce(v, F.lit(0.0)) for v in vs), F.lit(0.0))
    gaps = sum((F.max(F.get("optional", F.lit(i)).isNull().cast("int")) for i in range(columns)), F.lit(0))
    x = fit.groupBy("ticker").agg(F.first("alpha").alias("alpha"), F.round(F.first("recon_mse"), 8).alias("recon_mse"), total(var("residual")).alias("r"), total(var("optional")).alias("o"), gaps.alias("nan_columns"))
    return x.select("ticker", "alpha", "recon_mse", F.round(F.when(F.col("o") > 0, F.col("r") / F.col("o")).otherwise(1.0), 4).alias("residual_share"), "nan_columns")


def conditional_null(fit: DataFrame, moved: DataFrame) -> DataFrame:
    """ticker, t0, rebuilt, optional: the fitted part in its place and the residual of the row that a permutation puts there. moved: ticker, t0, src_t0."""
    source = fit.select("ticker", F.col("t0").alias("src_t0"), F.col("residual").alias("_other"))
    x = fit.join(moved, ["ticker", "t0"]).join(source, ["ticker", "src_t0"])
    return x.select("ticker", "t0", F.zip_with("fitted", "_other", lambda f, r: f + r).alias("rebuilt"), "optional")


def marginal_drift(rebuilt: DataFrame, columns: int) -> DataFrame:
    """ticker, marginal_drift: by how much the columns' deviations differ from the original ones, on average over the columns that have any."""
    dev = lambda c, i: F.stddev_pop(F.get(c, F.lit(i)))
    gaps = F.filter(F.array(*[F.abs(dev("rebuilt", i) - dev("optional", i)) for i in range(columns)]), lambda v: v.isNotNull())
    return rebuilt.groupBy("ticker").agg(gaps.alias("g")).select("ticker", (F.aggregate("g", F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("g"), F.lit(0))).alias("marginal_drift"))


_UNIT = "array<struct<permutation:int,t:double,index_hash:string,displaced:double>>"


def begun(observed: DataFrame, keys: list[str]) -> DataFrame:
    """State of sequential tests that have seen nothing: keys, statistic, seen. observed: keys, statistic."""
    return observed.select(*keys, F.col("statistic").cast("double").alias("statistic"), F.array().cast(_UNIT).alias("seen"))


def advanced(state: DataFrame, batch: DataFrame, keys: list[str], most: int = PERMUTATIONS) -> DataFrame:
    """The state after a batch of finished permutations: keys, permutation (from 0), t (null: nothing was comparable), and if there are such columns index_hash, displaced, n_blocks.

    Batches may come in any order, overlap, or come again: a permutation counts once, with the value it came with first (in one batch: the
    least). A test's state is bounded by its permutations; those beyond `most` and those of unknown keys are not kept.
    """
    has = lambda c, kind: (F.col(c) if c in batch.columns else F.lit(None)).cast(kind)
    moved = has("displaced", "double") / F.nullif(has("n_blocks", "double"), F.lit(0.0))
    new = batch.where((F.col("permutation") >= 0) & (F.col("permutation") < most)).groupBy(*keys, F.col("permutation").cast("int").alias("permutation"))
    new = new.agg(F.min(F.struct(F.col("t").cast("double").alias("t"), has("index_hash", "string").alias("index_hash"), moved.alias("displaced"))).alias("v"))
    new = new.groupBy(*keys).agg(F.collect_list(F.struct("permutation", "v.t", "v.index_hash", "v.displaced")).cast(_UNIT).alias("_new"))
    known = F.transform("seen", lambda u: u["permutation"])
    fresh = F.filter(F.coalesce("_new", F.array().cast(_UNIT)), lambda u: ~F.array_contains(known, u["permutation"]))
    return state.join(new, keys, "left").select(*keys, "statistic", F.array_sort(F.concat("seen", fresh)).alias("seen"))


def verdicts(state: DataFrame, keys: list[str], most: int = PERMUTATIONS, futility: int = FUTILITY) -> DataFrame:
    """keys, verdict, permutations_executed, exceedances, p_mc, final_p_lower_bound, null_max, null_median, min_displaced_fraction.

    Permutations count from 0 up to the first that is missing. With `futility` of them at or above the statistic the test ends there,
    rejected_early, and only a lower bound of its p is known; after `most` without that it has passed; else it is incomplete.
    A permutation drawn twice, by its hash, is an error: the draws would not be independent.
    """
    x = state.withColumn("run", F.filter("seen", lambda u, i: u["permutation"] == i))
    hashes = F.filter(F.transform("run", lambda u: u["index_hash"]), lambda h: h.isNotNull())
    again = F.size(hashes) > F.size(F.array_distinct(hashes))
    x = x.withColumn("run", F.when(again, F.raise_error(F.lit("a permutation was drawn twice")).cast(_UNIT)).otherwise(F.col("run")))
    x = x.withColumn("hits", F.transform(F.filter("run", lambda u: u["t"] >= F.col("statistic")), lambda u: u["permutation"]))
    stopped = F.get("hits", F.lit(futility - 1)) + 1
    x = x.withColumns({"n": F.coalesce(stopped, F.size("run")), "b": F.least(F.size("hits"), F.lit(futility))})
    x = x.withColumn("null", F.array_sort(F.filter(F.transform(F.slice("run", F.lit(1), F.col("n")), lambda u: u["t"]), lambda t: t.isNotNull())))
    m = F.size("null")
    middle = (F.get("null", F.floor((m - 1) / 2).cast("int")) + F.get("null", F.floor(m / 2).cast("int"))) / 2
    p = F.round((F.col("b") + 1) / (most + 1), 6)
    early, full = F.col("b") >= futility, F.size("run") >= most
    verdict = F.when(early, "rejected_early").when(full, "passed").otherwise("incomplete")
    return x.select(
        *keys, verdict.alias("verdict"), F.col("n").alias("permutations_executed"), F.col("b").alias("exceedances"), F.when(~early & full, p).alias("p_mc"), F.when(early, p).alias("final_p_lower_bound"),
        F.array_max("null").alias("null_max"), F.when(m > 0, middle).alias("null_median"), F.round(F.array_min(F.transform("run", lambda u: u["displaced"])), 4).alias("min_displaced_fraction"),
    )
