"""Causal indicators as window expressions. A value needs its full window of past bars, else it is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.rolling import back, by, full, last, ratio, sample_kurtosis, sample_skew, zscore
from tidebar.operators.recurrences import with_recurrences

EPS = 1e-9
#: Names of the core features in order.
CORE = (
    "direction log_return_1 log_return_5 log_return_20 close_z_score_20 dist_to_sma_20 dist_to_sma_50 sma_20_sma_50_ratio volume_z_score_20 atr_pct_14 "
    "realized_volatility_20 rsi_14 bollinger_percent_b bollinger_bandwidth macd_line macd_signal macd_hist"
).split()
OPT_IN = "ma_slope_10 ma_slope_4 vol_regime_6_12".split()
OPTIONAL = (
    "momentum_60 return_120 gap_open_z20 close_position_in_range high_low_range_pct volume_trend_5_20 obv_z20 atr_ratio_5_20 dist_to_high_252 "
    "drawdown_from_max_60 ret_skew_20 ret_kurt_20 up_streak_10 rsi_2 dist_to_sma_200 williams_r_14 stoch_k_14 dist_to_sma_10 down_streak_10 reversal_2d dist_from_low_20 mr_dist_atr_20"
).split()


def _log_return(k: int) -> Column:
    return F.ln(F.col("close") / back("close", k))


def core(bars: DataFrame) -> DataFrame:
    """ticker, idx, ts, the core and opt-in features, atr (absolute)."""
    c = F.col("close")
    b = with_recurrences(bars)
    b = b.withColumns({f"log_return_{k}": _log_return(k) for k in (1, 5, 20)} | {f"sma_{n}": full(F.avg, c, n) for n in (4, 10, 20, 50)} | {"dev_20": full(F.stddev_pop, c, 20)})
    width = 4 * F.col("dev_20")
    low = F.col("sma_20") - 2 * F.col("dev_20")
    rv = lambda n: full(F.stddev_pop, "log_return_1", n) * n**0.5
    return b.select(
        "ticker", "idx", "ts", F.signum("log_return_5").alias("direction"), "log_return_1", "log_return_5", "log_return_20",
        zscore(c, 20).alias("close_z_score_20"), (c / F.col("sma_20") - 1).alias("dist_to_sma_20"), (c / F.col("sma_50") - 1).alias("dist_to_sma_50"),
        (F.col("sma_20") / F.col("sma_50") - 1).alias("sma_20_sma_50_ratio"), zscore("volume", 20).alias("volume_z_score_20"),
        (100 * F.col("atr_14") / c).alias("atr_pct_14"), rv(20).alias("realized_volatility_20"), "rsi_14",
        F.when(width == 0, 0.5).otherwise((c - low) / F.when(width != 0, width)).alias("bollinger_percent_b"), (width / F.col("sma_20")).alias("bollinger_bandwidth"),
        "macd_line", "macd_signal", "macd_hist",
        ratio(F.col("sma_10") - back("sma_10", 1), back("sma_10", 1)).alias("ma_slope_10"), ratio(F.col("sma_4") - back("sma_4", 1), back("sma_4", 1)).alias("ma_slope_4"),
        ratio(rv(6), rv(12)).alias("vol_regime_6_12"), F.col("atr_14").alias("atr"),
    )


def session(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """ticker, idx, day_range_pos_session, session_pos: place in the day's range and hours so far."""
    local = F.from_utc_timestamp("ts", zone)
    day = Window.partitionBy("ticker", "day").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    b = bars.withColumn("day", F.to_date(local))
    low, high = F.min("low").over(day), F.max("high").over(day)
    end = F.from_utc_timestamp(F.col("ts") + F.expr("INTERVAL 1 HOUR"), zone)
    minutes = F.hour(end) * 60 + F.minute(end)
    return b.select("ticker", "idx", F.when(high - low > 0, (F.col("close") - low) / F.when(high > low, high - low)).otherwise(0.5).alias("day_range_pos_session"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (minutes - 570) / 390)).alias("session_pos"))


def _streak(sign: int, n: int = 10) -> Column:
    """Length of the current run of changes with this sign, at most n, over n."""
    broken = F.max(F.when(F.coalesce(F.signum("change") != sign, F.lit(True)), F.col("idx"))).over(by().rowsBetween(Window.unboundedPreceding, 0))
    return F.least(F.col("idx") - broken, F.lit(n)) / n


def optional(bars: DataFrame) -> DataFrame:
    """ticker, idx and OPTIONAL."""
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    b = with_recurrences(bars)
    b = b.withColumns({"r1": _log_return(1), "change": c - back("close", 1), "gap": F.col("open") / back("close", 1) - 1})
    b = b.withColumn("obv", F.sum(F.coalesce(F.signum("change"), F.lit(0.0)) * F.col("volume")).over(by().rowsBetween(Window.unboundedPreceding, 0)))
    high14, low14 = full(F.max, h, 14), full(F.min, lo, 14)
    out = {
        "momentum_60": _log_return(60), "return_120": _log_return(120), "gap_open_z20": zscore("gap", 20, None),
        "close_position_in_range": F.when(h == lo, 0.5).otherwise((c - lo) / F.when(h != lo, h - lo)), "high_low_range_pct": 100 * (h - lo) / c,
        "volume_trend_5_20": ratio(full(F.avg, "volume", 5), full(F.avg, "volume", 20)) - 1, "obv_z20": zscore("obv", 20, None),
        "atr_ratio_5_20": ratio(F.col("atr_5"), F.col("atr_20")), "dist_to_high_252": c / full(F.max, h, 252) - 1, "drawdown_from_max_60": c / full(F.max, c, 60) - 1,
        "ret_skew_20": sample_skew(F.col("r1"), 20), "ret_kurt_20": sample_kurtosis(F.col("r1"), 20), "up_streak_10": _streak(1), "rsi_2": F.col("rsi_2"),
        "dist_to_sma_200": c / full(F.avg, c, 200) - 1,
        "williams_r_14": F.when(high14 == low14, -50.0).otherwise(-100 * (high14 - c) / F.when(high14 != low14, high14 - low14)),
        "stoch_k_14": F.when(high14 == low14, 50.0).otherwise(100 * (c - low14) / F.when(high14 != low14, high14 - low14)),
        "dist_to_sma_10": c / full(F.avg, c, 10) - 1, "down_streak_10": _streak(-1), "reversal_2d": -_log_return(2), "dist_from_low_20": c / full(F.min, lo, 20) - 1,
        "mr_dist_atr_20": ratio(c - full(F.avg, c, 20), F.col("atr_14")),
    }
    return b.select("ticker", "idx", *[out[k].alias(k) for k in OPTIONAL])


def market(bars: DataFrame) -> DataFrame:
    """ticker, idx, xas_mkt_lead_ret_1, xas_rs_mkt_20: against the equal-weight mean of all other tickers."""
    r = bars.select("ticker", "idx", "ts", _log_return(1).alias("r"))
    total = r.groupBy("ts").agg(F.sum("r").alias("s"), F.count("r").alias("n"))
    x = r.join(total, "ts").withColumn("ref", F.when((F.col("n") > 1) & F.col("r").isNotNull(), (F.col("s") - F.col("r")) / F.when(F.col("n") > 1, F.col("n") - 1)))
    return x.select("ticker", "idx", back("ref", 1).alias("xas_mkt_lead_ret_1"), (full(F.sum, "r", 20) - full(F.sum, "ref", 20)).alias("xas_rs_mkt_20"))


def asof_many(left: DataFrame, rights: dict[str, DataFrame], left_time: str, right_time: str, key: str = "ticker") -> DataFrame:
    """left with a struct for each of rights, by its name: the latest row of it at or before left's time, exact matches included.

    All sides are sorted together once; right rows come first at equal times and the whole row is carried, so
    a null inside the latest row stays null.
    """
    kinds = {name: r.select(F.struct(*r.columns).alias("_row")).schema["_row"].dataType for name, r in rights.items()}
    own = {c: left.schema[c].dataType for c in left.columns}
    none = lambda kind: F.lit(None).cast(kind)
    both = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), *[none(k).alias(f"_r_{n}") for n, k in kinds.items()], *[F.col(c).alias(f"_l_{c}") for c in left.columns])
    for name, r in rights.items():
        rows = [(F.struct(*r.columns) if n == name else none(k)).alias(f"_r_{n}") for n, k in kinds.items()]
        both = both.unionAll(r.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *rows, *[none(t).alias(f"_l_{c}") for c, t in own.items()]))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({n: F.last(f"_r_{n}", ignorenulls=True).over(w) for n in kinds}).where("_side = 1")
    return both.select(*[F.col(f"_l_{c}").alias(c) for c in left.columns], *kinds)


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, key: str = "ticker") -> DataFrame:
    """left with the struct `context` of the latest right row at or before its time, exact matches included."""
    return asof_many(left, {"context": right}, left_time, right_time, key)


def _nan_mean(*values: Column) -> Column:
    """Mean of those that are not null; null without any."""
    some = F.filter(F.array(*values), lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(some), F.lit(0)))


#: The contexts' suffixes.
CONTEXTS = ("1d", "1w")


def projected(hourly: DataFrame, contexts: dict[str, DataFrame]) -> DataFrame:
    """Hourly core features, and for each context the core features of its latest bar that was finished at the hour's end.

    Columns are named <feature>_<context>; available_at_<context> says since when that bar was known.
    """
    x = hourly.withColumn("decision_ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    x = asof_many(x, {f"_at_{k}": c.select("ticker", "available_at", *CORE) for k, c in contexts.items()}, "decision_ts", "available_at")
    known = {f"{c}_{k}": F.col(f"_at_{k}.{c}") for k in contexts for c in ["available_at", *CORE]}
    return x.withColumns(known).drop("decision_ts", *[f"_at_{k}" for k in contexts])


def multi_timeframe(x: DataFrame) -> DataFrame:
    """The projections of an hour onto day and week, and what the timeframes say together."""
    signs = lambda c: _nan_mean(*[F.signum(F.col(c + s)) for s in ("", *[f"_{k}" for k in CONTEXTS])])
    day_range = F.col("atr_pct_14_1d")
    return x.select(
        "ticker", "idx", "ts", *[f"{c}_{k}" for k in CONTEXTS for c in ["available_at", *CORE]],
        signs("log_return_5").alias("momentum_alignment_multi"), ((F.col("rsi_14") - F.col("rsi_14_1d")) / 100).alias("rsi_spread_1h_1d"),
        (F.col("atr_pct_14") / F.when(F.abs(day_range) > EPS, day_range)).alias("volatility_ratio_1h_1d"), signs("macd_hist").alias("macd_hist_alignment_multi"),
        (F.log1p("dist_to_sma_20_1d") / (F.col("realized_volatility_20") + 1e-12)).alias("xtf_zscore_1h_vs_1d"), signs("dist_to_sma_20").alias("price_vs_sma_alignment_multi"),
    )
