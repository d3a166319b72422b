"""Queries of the null runs: the conditional residual null and sequential verdicts, on inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import features as X
from tidebar.operators import nulls as N
from tidebar.operators import search as R
from tidebar.operators import trades as T
from tidebar.plans.catalog_analysis import _BASE, _SEG, orders_sql, verdict_sql
from tidebar.plans.catalog_bars import hourly, rounded
from tidebar.sources import bars as B
from tidebar.sources import stores

CORE, OPTIONAL = ["log_return_5", "rsi_14"], ["macd_hist", "vol_regime"]


def _fit(spark, d):
    f = X.core(hourly(spark, d))
    gaps = F.when(F.col("idx") % 7 > 0, F.col("vol_regime_6_12")).alias("vol_regime")
    x = T.candidates(f).select("ticker", "t0").join(f.select("ticker", F.col("idx").alias("t0"), *CORE, "macd_hist", gaps), ["ticker", "t0"])
    return N.ridge_crossfit(x, CORE, OPTIONAL)


def _wide(x, *columns):
    return [F.get(c, F.lit(i)).alias(f"{c}_{i + 1}") for c in columns for i in range(len(OPTIONAL))]


def conditional_fit(spark, d):
    x = _fit(spark, d)
    return rounded(x.select("ticker", "t0", "fold", "alpha", *_wide(x, "fitted", "residual")), ["alpha", *[f"{c}_{i}" for c in ("fitted", "residual") for i in (1, 2)]])


def conditional_summary(spark, d):
    x = N.ridge_summary(_fit(spark, d), 2)
    return x.withColumn("residual_share", F.round("residual_share", 3) + 0.0).withColumn("recon_mse", F.round("recon_mse", 6) + 0.0)


def conditional_null(spark, d):
    fit = stores.kept(_fit(spark, d))
    x = R.grouped_blocks(fit.select("ticker", "t0"), 24, 4)
    y = N.conditional_null(fit, R.permuted(x, R.orders(x, 42, 1)))
    return rounded(y.select("ticker", "t0", *_wide(y, "rebuilt")), ["rebuilt_1", "rebuilt_2"])


def conditional_null_provenance(spark, d):
    """What was drawn, and by how much the columns' deviations drift."""
    fit = stores.kept(_fit(spark, d))
    x = R.grouped_blocks(fit.select("ticker", "t0"), 24, 4)
    order = stores.kept(R.orders(x, 42, 1))
    y = R.draws(order).join(N.marginal_drift(N.conditional_null(fit, R.permuted(x, order)), 2), "ticker")
    return rounded(y.select("ticker", "displaced", "n_blocks", "segments", "index_hash", "marginal_drift"), ["marginal_drift"])


_UNITS = ["o_orderpriority AS ticker", "o_orderstatus AS arm", "cast(o_custkey % 53 AS int) AS permutation", "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_totalprice END AS t"]


def sequential_null(spark, d):
    """Tests that went on in four batches, of which the third repeats the first; each batch knows its units' highest value."""
    keys = ["ticker", "arm"]
    x = B.read(spark, d, "orders").selectExpr(*_UNITS).where("NOT (ticker LIKE '1%' AND arm = 'P' AND permutation = 7)").groupBy(*keys, "permutation").agg(F.max("t").alias("t"))
    observed = x.groupBy(*keys).agg((F.max("t") * F.when(F.col("arm") == "F", 0.7).otherwise(0.97)).alias("statistic"))
    state = N.begun(observed, keys)
    for part in ("permutation % 3 = 1", "permutation % 3 = 0", "permutation % 3 = 1", "permutation % 3 <> 0"):
        state = N.advanced(state, x.where(part), keys)
    return rounded(N.verdicts(state, keys).drop("min_displaced_fraction"), ["p_mc", "final_p_lower_bound", "null_max", "null_median"])


def _ridge(n: int) -> str:
    """The slopes for target n by the inverse of a 2 x 2 matrix."""
    det = "((a + al) * (d + al) - b * b)"
    return f"CASE WHEN n < 50 THEN 0 ELSE ((d + al) * p{n} - b * q{n}) / {det} END AS u{n}, CASE WHEN n < 50 THEN 0 ELSE ((a + al) * q{n} - b * p{n}) / {det} END AS v{n}"


def _fit_sql(base: str) -> str:
    return f"""{base}, rws AS (SELECT c.ticker, t0, f.log_return_5 AS x1, f.rsi_14 AS x2, f.macd_hist AS y1, CASE WHEN idx % 7 > 0 THEN vol_regime_6_12 END AS y2 FROM cand c JOIN core f ON f.ticker = c.ticker AND f.idx = c.t0 WHERE f.log_return_5 IS NOT NULL AND f.rsi_14 IS NOT NULL),
fld AS (SELECT *, ((pos + 1) * 5 - 1) // n_all AS fold FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY t0) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n_all FROM rws)),
reg AS (SELECT ticker, fold AS k, min(t0) - 35 AS lo, max(t0) + 35 AS hi FROM fld GROUP BY ALL),
trn AS (SELECT fld.*, k FROM fld JOIN reg ON reg.ticker = fld.ticker AND NOT t0 BETWEEN lo AND hi),
ms AS (SELECT ticker, k, count(*) AS n, avg(x1) AS m1, stddev_pop(x1) + 1e-12 AS s1, avg(x2) AS m2, stddev_pop(x2) + 1e-12 AS s2, coalesce(avg(y1), 0) AS b1, coalesce(avg(y2), 0) AS b2 FROM trn GROUP BY ALL),
z AS (SELECT ticker, k, n, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, coalesce(y1 - b1, 0) AS w1, coalesce(y2 - b2, 0) AS w2 FROM trn JOIN ms USING (ticker, k)),
g AS (SELECT ticker, k, n, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS d, sum(z1 * w1) AS p1, sum(z2 * w1) AS q1, sum(z1 * w2) AS p2, sum(z2 * w2) AS q2 FROM z GROUP BY ALL),
cf AS (SELECT ticker, k AS fold, al, {_ridge(1)}, {_ridge(2)} FROM g, (SELECT unnest([0.1, 1.0, 10.0, 100.0, 1000.0])::DOUBLE AS al)),
pr AS (SELECT fld.ticker, t0, fld.fold, al, n, y1, y2, coalesce(b1 + u1 * (x1 - m1) / s1 + v1 * (x2 - m2) / s2, 0) AS f1, coalesce(b2 + u2 * (x1 - m1) / s1 + v2 * (x2 - m2) / s2, 0) AS f2
  FROM fld LEFT JOIN ms ON ms.ticker = fld.ticker AND ms.k = fld.fold LEFT JOIN cf ON cf.ticker = fld.ticker AND cf.fold = fld.fold),
er AS (SELECT ticker, fold, al, (coalesce(sum((f1 - y1) * (f1 - y1)), 0) + coalesce(sum((f2 - y2) * (f2 - y2)), 0)) / (count(y1) + count(y2)) AS e FROM pr WHERE n >= 50 GROUP BY ALL HAVING count(y1) + count(y2) > 0),
bs AS (SELECT * FROM (SELECT ticker, al, avg(e) AS mse, row_number() OVER (PARTITION BY ticker ORDER BY avg(e), al) AS k FROM er GROUP BY ticker, al) WHERE k = 1),
fit AS (SELECT pr.ticker, t0, fold, bs.al AS alpha, mse, y1, y2, f1, f2, y1 - f1 AS r1, y2 - f2 AS r2 FROM pr LEFT JOIN bs ON bs.ticker = pr.ticker WHERE pr.al IS NULL OR pr.al = coalesce(bs.al, 0.1))"""


_MOVED = orders_sql(_SEG.replace("FROM cand", "FROM fit")).replace(_BASE, _fit_sql(_BASE), 1)
_REBUILT = f"{_MOVED}, reb AS (SELECT m.ticker, m.t0, a.f1 + s.r1 AS rebuilt_1, a.f2 + s.r2 AS rebuilt_2, a.y1, a.y2 FROM moved m JOIN fit a ON a.ticker = m.ticker AND a.t0 = m.t0 JOIN fit s ON s.ticker = m.ticker AND s.t0 = m.src_t0)"

ORACLES = {
    "conditional_fit": f"""{_fit_sql(_BASE)} SELECT ticker, t0, fold::INT AS fold, alpha, round(f1, 6) + 0.0 AS fitted_1, round(f2, 6) + 0.0 AS fitted_2, round(r1, 6) + 0.0 AS residual_1, round(r2, 6) + 0.0 AS residual_2 FROM fit""",
    "conditional_summary": f"""{_fit_sql(_BASE)} SELECT ticker, max(alpha) AS alpha, round(max(mse), 6) + 0.0 AS recon_mse, round(CASE WHEN coalesce(var_pop(y1), 0) + coalesce(var_pop(y2), 0) > 0 THEN (coalesce(var_pop(r1), 0) + coalesce(var_pop(r2), 0)) / (coalesce(var_pop(y1), 0) + coalesce(var_pop(y2), 0)) ELSE 1 END, 3) + 0.0 AS residual_share,
      (bool_or(y1 IS NULL)::INT + bool_or(y2 IS NULL)::INT)::INT AS nan_columns FROM fit GROUP BY ticker""",
    "conditional_null": f"{_REBUILT} SELECT ticker, t0, round(rebuilt_1, 6) + 0.0 AS rebuilt_1, round(rebuilt_2, 6) + 0.0 AS rebuilt_2 FROM reb",
    "conditional_null_provenance": f"""{_REBUILT}, dr AS (SELECT ticker, (abs(stddev_pop(rebuilt_1) - stddev_pop(y1)) + abs(stddev_pop(rebuilt_2) - stddev_pop(y2))) / 2 AS d FROM reb GROUP BY ticker)
      SELECT ticker, displaced, n_blocks, segments, index_hash, round(d, 6) + 0.0 AS marginal_drift FROM drawn JOIN dr USING (ticker)""",
    "sequential_null": f"""WITH n AS (SELECT ticker, arm, permutation, max(t) AS t FROM (SELECT {", ".join(_UNITS)} FROM orders) WHERE NOT (ticker LIKE '1%' AND arm = 'P' AND permutation = 7) GROUP BY ALL),
      s AS (SELECT ticker, arm, max(t) * CASE WHEN arm = 'F' THEN 0.7 ELSE 0.97 END AS statistic FROM n GROUP BY ticker, arm), {verdict_sql(["ticker", "arm"])}""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
