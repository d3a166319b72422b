"""Queries of the searches, on inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions.rolling import by
from tidebar.operators import features as X
from tidebar.operators import greedy as Y
from tidebar.plans.catalog_bars import hourly, rounded
from tidebar.sources import bars as B

CORE = ["log_return_1", "rsi_14"]
CANDIDATES = [
    (101, "close_z_score_20", "distance", "zscore(c, 20)"), (102, "dist_to_sma_20", "distance", "c / mean(c, 20) - 1"), (103, "dist_to_sma_50", "distance", "c / mean(c, 50) - 1"), (110, "volume_z_score_20", "volume", "zscore(v, 20)"),
    (120, "realized_volatility_20", "volatility", "std(r, 20)"), (121, "bollinger_bandwidth", "volatility", "4 * std(c, 20) / mean(c, 20)"), (130, "ma_slope_4", "slope", "mean(c, 4) / shift(mean(c, 4), 1) - 1"), (131, "ma_slope_10", "slope", "mean(c, 10) / shift(mean(c, 10), 1) - 1"),
]


def _search(spark, d):
    """The next hour's return of each kind of event, features for it, and walk-forward folds."""
    f = X.core(hourly(spark, d))
    x = f.select("ticker", F.col("idx").alias("t0"), *CORE, *[c[1] for c in CANDIDATES], F.lead("log_return_1").over(by()).alias("y"))
    ends = x.groupBy("ticker").agg(F.max("t0").alias("last"))
    edge = lambda i: F.floor(F.col("last") * (i + 1) / 5).cast("int")
    fold = F.explode(F.array(*[F.lit(i) for i in range(4)]))
    cut = ends.withColumn("fold", fold)
    train = cut.select("ticker", "fold", F.lit("train").alias("role"), F.lit(0).alias("lo"), F.greatest(F.lit(1), edge(F.col("fold")) - 5).alias("hi"))
    val = cut.select("ticker", "fold", F.lit("val").alias("role"), edge(F.col("fold")).alias("lo"), (edge(F.col("fold") + 1) + 1).alias("hi"))
    return x, CORE, spark.createDataFrame(CANDIDATES, "id int, feature string, family string, formula string"), train.unionByName(val)


def family_first_search(spark, d):
    return rounded(Y.family_first(*_search(spark, d)), ["base", "best", "gain"])


def utility_register(spark, d):
    return rounded(Y.utility_register(*_search(spark, d)), ["gain", "fold_share", "best_member_gain"])


SPACE = [{"name": "depth", "low": 2, "high": 8, "whole": True}, {"name": "rate", "low": 0.01, "high": 0.3, "log": True}, {"name": "subsample", "low": 0.5, "high": 1.0}, {"name": "min_child", "low": 0.001, "high": 0.1, "log": True, "relative": True}]


def trial_draws(spark, d):
    """Thirty trials for each brand, the least weight of a child in units of its prices' spread."""
    x = B.read(spark, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.round(F.stddev_pop("p_retailprice"), 6).alias("hessian"))
    x = x.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return rounded(Y.drawn(x, SPACE, 42), ["rate", "subsample", "min_child", "min_child_relative"])


_STEPS = ["l_returnflag AS ticker", "l_linestatus AS arm", "cast(l_suppkey % 30 AS int) AS trial", "l_linenumber % 4 AS step", "l_discount - l_tax AS v"]


def median_pruning(spark, d):
    x = B.read(spark, d, "lineitem").selectExpr(*_STEPS).groupBy("ticker", "arm", "trial", "step").agg(F.round(F.avg("v"), 9).alias("score"))
    whole = x.groupBy("ticker", "arm", "trial").agg(F.max("step").alias("last"), F.count(F.lit(1)).alias("n")).where("last + 1 = n").select("ticker", "arm", "trial")
    return rounded(Y.pruned(x.join(whole, ["ticker", "arm", "trial"]), ["ticker", "arm"], 5, 1), ["score"])


def _unit(name: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', '42', ticker, trial::VARCHAR, '{name}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_BELOW = "list_max(scores[1 : i + 1]) < list_aggregate([x.scores[i + 1] FOR x IN done IF x.scores[i + 1] IS NOT NULL], 'median')"

ORACLES = {
    "trial_draws": f"""WITH x AS (SELECT ticker, hessian, t::INT AS trial FROM (SELECT p_brand AS ticker, round(stddev_pop(p_retailprice), 6) AS hessian FROM part GROUP BY p_brand), range(30) r(t))
      SELECT ticker, hessian, trial, floor({_unit("depth")} * 7 + 2)::INT AS depth, round(exp(ln(0.01) + {_unit("rate")} * (ln(0.3) - ln(0.01))), 6) + 0.0 AS rate, round(0.5 + {_unit("subsample")} * 0.5, 6) + 0.0 AS subsample,
        round(exp(ln(0.001) + {_unit("min_child")} * (ln(0.1) - ln(0.001))), 6) + 0.0 AS min_child_relative, round(exp(ln(0.001) + {_unit("min_child")} * (ln(0.1) - ln(0.001))) * hessian, 6) + 0.0 AS min_child FROM x""",
    "median_pruning": f"""WITH RECURSIVE x AS (SELECT ticker, arm, trial, step, round(avg(v), 9) AS score FROM (SELECT {", ".join(_STEPS)} FROM lineitem) GROUP BY ALL),
      e AS (SELECT ticker, arm, trial, list(score ORDER BY step) AS scores FROM x GROUP BY ALL HAVING max(step) + 1 = count(*)), n AS (SELECT *, row_number() OVER (PARTITION BY ticker, arm ORDER BY trial) AS k FROM e),
      w AS (SELECT ticker, arm, 0::BIGINT AS k, NULL::INT AS trial, [] ::STRUCT(scores DOUBLE[])[] AS done, NULL::BIGINT AS stop, 0::BIGINT AS len, NULL::DOUBLE[] AS scores FROM (SELECT DISTINCT ticker, arm FROM e)
        UNION ALL SELECT ticker, arm, k, trial, CASE WHEN stop IS NULL THEN list_append(done, {{'scores': scores}}) ELSE done END, stop, len(scores), scores FROM (
          SELECT n.ticker, n.arm, n.k, n.trial, n.scores, w.done, CASE WHEN len(w.done) >= 5 THEN list_min([i FOR i IN range(1, len(n.scores)) IF {_BELOW.replace("scores[1", "n.scores[1").replace("FOR x IN done", "FOR x IN w.done")}]) END AS stop FROM w JOIN n ON n.ticker = w.ticker AND n.arm = w.arm AND n.k = w.k + 1)),
      r AS (SELECT ticker, arm, trial, CASE WHEN stop IS NULL THEN 'complete' ELSE 'pruned' END AS state, coalesce(stop + 1, len)::INT AS steps_run, scores[coalesce(stop + 1, len)] AS score FROM w WHERE k > 0)
      SELECT ticker, arm, trial, state, steps_run, round(score, 6) + 0.0 AS score, coalesce(trial = arg_max(CASE WHEN state = 'complete' THEN trial END, CASE WHEN state = 'complete' THEN (score, -trial) END) OVER (PARTITION BY ticker, arm), false) AS best FROM r""",
}

QUERIES = {name: globals()[name] for name in ["family_first_search", "utility_register", *ORACLES]}
