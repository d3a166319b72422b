"""Queries of the feature language, the streaming roll-up and fitted scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions import dsl
from tidebar.operators import features as X
from tidebar.operators import scoring
from tidebar.operators import trades as T
from tidebar.plans import sql as S
from tidebar.plans.catalog_bars import hourly, rounded
from tidebar.plans.catalog_trades import NAMES
from tidebar.sources import stores
from tidebar.streaming import bars as stream
from tidebar.streaming import recurrences as live

PROPOSED = "zscore(log(c / shift(c, 1)), 20) - clip(rank(v, 10), 0.2, 0.8)"


def dsl_feature(spark, d):
    return rounded(dsl.feature(hourly(spark, d), PROPOSED, "proposed"), ["proposed"])


def dsl_smoothed_range(spark, d):
    return rounded(dsl.feature(hourly(spark, d), "ewm((h - l) / c, 5)", "smoothed"), ["smoothed"])


def streaming_bars(spark, d):
    return rounded(stream.replayed(spark, f"{d}/events.parquet"), ["open", "high", "low", "close", "volume"])


def live_recurrences(spark, d):
    """Bars that arrive in three parts, the second of which brings some of the first again."""
    b = stores.kept(hourly(spark, d))
    return rounded(live.replayed(b, ["idx < 60", "idx >= 50 AND idx < 300", "idx >= 300"]), ["atr_14", "rsi_14"])


def _events(spark, d):
    bars = hourly(spark, d)
    f = X.core(bars)
    trades = T.simulated(bars, T.candidates(f))
    rows = trades.join(f.select("ticker", F.col("idx").alias("t0"), *NAMES), ["ticker", "t0"]).join(T.uniqueness(trades), ["ticker", "t0"])
    return rows.withColumn("y", (F.col("net_return") > 0).cast("double")).dropna(subset=NAMES)


def logistic_scores(spark, d):
    """Fitted before bar 480 with purging, scored from there on."""
    x = _events(spark, d)
    return scoring.logistic(T.purged(x, F.lit(480)), x.where("t0 >= 480"), NAMES)


def boosted_scores(spark, d):
    x = _events(spark, d)
    return scoring.boosted(T.purged(x, F.lit(480)), x.where("t0 >= 480"), NAMES, trees=5)


def class_balance(spark, d):
    return rounded(scoring.class_balance(_events(spark, d).withColumn("weight", F.lit(1.0))), ["pos_weight"])


QUERIES = {"dsl_feature": dsl_feature, "dsl_smoothed_range": dsl_smoothed_range, "streaming_bars": streaming_bars, "live_recurrences": live_recurrences, "logistic_scores": logistic_scores, "boosted_scores": boosted_scores, "class_balance": class_balance}

ORACLES = {
    "dsl_feature": f"""WITH {S.BARS_1H}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY idx)) AS r FROM bars),
      k AS (SELECT *, list(volume) OVER w10 AS v10, {S.zscore("r", 20, "NULL")} AS z FROM r {S.windows(10, 20)})
      SELECT ticker, idx, round(z - CASE WHEN len(v10) = 10 THEN greatest(0.2, least(0.8, len(list_filter(v10, lambda e: e <= volume)) / 10.0)) END, 6) + 0.0 AS proposed FROM k""",
    "dsl_smoothed_range": f"""WITH RECURSIVE {S.BARS_1H}, e AS (SELECT ticker, idx, (high - low) / close AS y FROM bars WHERE idx = 0
      UNION ALL SELECT b.ticker, b.idx, 2.0 / 3 * y + 1.0 / 3 * (high - low) / close FROM e JOIN bars b ON b.ticker = e.ticker AND b.idx = e.idx + 1)
      SELECT ticker, idx, CASE WHEN idx >= 4 THEN round(y, 6) END AS smoothed FROM e""",
    "live_recurrences": f"{S.core_features(S.BARS_1H)} SELECT ticker, ts, idx::BIGINT + 1 AS n, round(atr, 6) + 0.0 AS atr_14, round(rsi_14, 6) + 0.0 AS rsi_14 FROM core",
    "streaming_bars": f"WITH {S.BARS_1H} SELECT ticker, ts, {S.rounded(['open', 'high', 'low', 'close', 'volume'])} FROM bars",
}
