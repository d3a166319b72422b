"""Queries on bars, their quality, and indicators; each with the same question in DuckDB's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.operators import features as X
from tidebar.plans import sql as S
from tidebar.sources import bars as B
from tidebar.sources import stores


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.hourly_from_events(B.read(spark, sf_dir, "events"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.daily_from_lineitem(B.read(spark, sf_dir, "lineitem"))


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """6 decimals: sums may be taken in another order elsewhere. Adding 0 turns -0 into 0."""
    return df.withColumns({n: F.round(n, 6) + 0.0 for n in names})


OHLCV = ["open", "high", "low", "close", "volume"]


def bars_1h(spark, d):
    return rounded(hourly(spark, d).select("ticker", "idx", "ts", *OHLCV), OHLCV)


def bars_1d(spark, d):
    return rounded(daily(spark, d).select("ticker", "idx", "ts", *OHLCV), OHLCV)


def bars_session_daily(spark, d):
    return rounded(B.daily(hourly(spark, d)).withColumn("session", F.col("session").cast("string")).select("ticker", "session", *OHLCV, "available_at", "parts"), OHLCV)


def bars_weekly(spark, d):
    return rounded(B.weekly(B.daily(hourly(spark, d))).select("ticker", "week", *OHLCV, "available_at", "days"), OHLCV)


SESSIONS = f"""{S.BARS_1H}, s AS (
  SELECT ticker, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS session, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
    sum(volume) AS volume, max(ts) + INTERVAL 1 HOUR AS available_at, count(*) AS parts FROM bars GROUP BY 1, 2)"""


def source_quality(spark, d):
    """Rules broken, on a copy of the bars with every seventh row spoilt in one way or another."""
    b = hourly(spark, d)
    k, first = F.col("idx") % 42, F.min("ts").over(Window.partitionBy("ticker"))
    spoilt = {
        "high": F.when(k == 7, F.col("low") - 1).otherwise(F.col("high")), "open": F.when(k == 14, -F.col("open")).otherwise(F.col("open")),
        "volume": F.when(k == 21, F.lit(float("nan"))).when(k == 22, F.lit(float("inf"))).otherwise(F.col("volume")), "ts": F.when(k == 28, F.lit(None)).when(k == 35, first).otherwise(F.col("ts")),
    }
    return B.quality(b.withColumns(spoilt).withColumn("position", F.col("idx")))


SOURCE_QUALITY = f"""WITH {S.BARS_1H}, spoilt AS (
  SELECT ticker, idx, CASE WHEN idx % 42 = 28 THEN NULL WHEN idx % 42 = 35 THEN min(ts) OVER (PARTITION BY ticker) ELSE ts END AS ts, CASE WHEN idx % 42 = 14 THEN -open ELSE open END AS open,
    CASE WHEN idx % 42 = 7 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN idx % 42 = 21 THEN 'nan'::DOUBLE WHEN idx % 42 = 22 THEN 'infinity'::DOUBLE ELSE volume END AS volume FROM bars),
l AS (SELECT *, lag(ts) OVER (PARTITION BY ticker ORDER BY idx) AS before, count(*) OVER (PARTITION BY ticker, ts ORDER BY idx) AS seen FROM spoilt)
SELECT ticker, count(*) AS bars, count(*) FILTER (ts IS NULL) AS null_ts, count(*) FILTER (ts IS NOT NULL AND seen > 1) AS duplicate_ts, count(*) FILTER (ts < before) AS descending_ts,
  count(*) FILTER (least(open, high, low, close) <= 0) AS bad_price, count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (high < greatest(open, close)) AS high_below_body,
  count(*) FILTER (low > least(open, close)) AS low_above_body, count(*) FILTER (NOT isfinite(volume) OR volume < 0) AS bad_volume FROM l GROUP BY ticker"""


def universe(spark, d):
    return B.universe(hourly(spark, d))


def core_features_1h(spark, d):
    return rounded(X.core(hourly(spark, d)), X.CORE + X.OPT_IN + ["atr"])


def core_features_1d(spark, d):
    return rounded(X.core(daily(spark, d)), X.CORE + X.OPT_IN + ["atr"])


def session_features(spark, d):
    return rounded(X.session(hourly(spark, d)), ["day_range_pos_session", "session_pos"])


SESSION_FEATURES = f"""WITH {S.BARS_1H}, l AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et FROM bars),
r AS (SELECT *, min(low) OVER s AS lo, max(high) OVER s AS hi FROM l WINDOW s AS (PARTITION BY ticker, et::DATE ORDER BY idx))
SELECT ticker, idx, round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END, 6) AS day_range_pos_session,
  round(greatest(0.0, least(1.0, (hour(et + INTERVAL 1 HOUR) * 60 + minute(et + INTERVAL 1 HOUR) - 570) / 390.0))::DOUBLE, 6) AS session_pos FROM r"""


def optional_features(spark, d):
    return rounded(X.optional(daily(spark, d)), X.OPTIONAL)


def _atr(n: int) -> str:
    return S.ATR.replace("atr AS", f"atr{n} AS").replace("FROM atr JOIN", f"FROM atr{n} JOIN").replace("atr.", f"atr{n}.").replace("BETWEEN 13", f"BETWEEN {n - 1}").replace("idx = 13", f"idx = {n - 1}").replace("* 13 +", f"* {n - 1} +").replace("/ 14", f"/ {n}")


RSI_2 = S.RSI.replace("wilder", "wilder2").replace("rsi AS", "rsi2 AS").replace("13.0 / 14", "1.0 / 2").replace("/ 14", "/ 2").replace("idx < 14", "idx < 2").replace("rsi_14", "rsi_2")
OPTIONAL_FEATURES = f"""WITH RECURSIVE {S.BARS_1D}, {S.TR}, {_atr(5)}, {_atr(14)}, {_atr(20)}, {S.CHANGES}, {RSI_2},
x AS (
  SELECT d.*, a5.v AS a5, a14.v AS a14, a20.v AS a20, rsi_2, ln(close / lag(close) OVER w) AS r1, open / lag(close) OVER w - 1 AS gap,
    sum(coalesce(sign(ch), 0) * volume) OVER w AS obv,
    idx - max(CASE WHEN ch > 0 THEN NULL ELSE idx END) OVER w AS up, idx - max(CASE WHEN ch < 0 THEN NULL ELSE idx END) OVER w AS down
  FROM d LEFT JOIN atr5 a5 USING (ticker, idx) LEFT JOIN atr14 a14 USING (ticker, idx) LEFT JOIN atr20 a20 USING (ticker, idx) LEFT JOIN rsi2 USING (ticker, idx) WINDOW w AS (PARTITION BY ticker ORDER BY idx)),
y AS (SELECT *, {S.full("max", "high", 14)} AS h14, {S.full("min", "low", 14)} AS l14, {S.full("min", "r1", 20)} AS rmin, {S.full("max", "r1", 20)} AS rmax FROM x {S.windows(14, 20)}),
z AS (SELECT ticker, idx, ln(close / lag(close, 60) OVER w) AS momentum_60, ln(close / lag(close, 120) OVER w) AS return_120, {S.zscore("gap", 20, "NULL")} AS gap_open_z20,
  CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END AS close_position_in_range, 100 * (high - low) / close AS high_low_range_pct,
  ({S.full("avg", "volume", 5)}) / nullif({S.full("avg", "volume", 20)}, 0) - 1 AS volume_trend_5_20, {S.zscore("obv", 20, "NULL")} AS obv_z20, a5 / a20 AS atr_ratio_5_20,
  close / ({S.full("max", "high", 252)}) - 1 AS dist_to_high_252, close / ({S.full("max", "close", 60)}) - 1 AS drawdown_from_max_60,
  CASE WHEN rmin IS NULL THEN NULL WHEN rmin = rmax THEN 0 ELSE skewness(r1) OVER w20 END AS ret_skew_20, CASE WHEN rmin IS NULL THEN NULL WHEN rmin = rmax THEN -3 ELSE kurtosis(r1) OVER w20 END AS ret_kurt_20,
  least(up, 10) / 10.0 AS up_streak_10, rsi_2, close / ({S.full("avg", "close", 200)}) - 1 AS dist_to_sma_200,
  CASE WHEN h14 = l14 THEN -50 ELSE -100 * (h14 - close) / (h14 - l14) END AS williams_r_14, CASE WHEN h14 = l14 THEN 50 ELSE 100 * (close - l14) / (h14 - l14) END AS stoch_k_14,
  close / ({S.full("avg", "close", 10)}) - 1 AS dist_to_sma_10, least(down, 10) / 10.0 AS down_streak_10, -ln(close / lag(close, 2) OVER w) AS reversal_2d,
  close / ({S.full("min", "low", 20)}) - 1 AS dist_from_low_20, (close - ({S.full("avg", "close", 20)})) / nullif(a14, 0) AS mr_dist_atr_20
  FROM y {S.windows(5, 10, 20, 60, 200, 252)})
SELECT ticker, idx, {S.rounded(X.OPTIONAL)} FROM z"""


def market_features(spark, d):
    return rounded(X.market(hourly(spark, d)), ["xas_mkt_lead_ret_1", "xas_rs_mkt_20"])


MARKET_FEATURES = f"""WITH {S.BARS_1H}, r AS (SELECT ticker, idx, ts, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY idx)) AS r FROM bars),
m AS (SELECT *, CASE WHEN count(r) OVER t > 1 AND r IS NOT NULL THEN (sum(r) OVER t - r) / (count(r) OVER t - 1) END AS ref FROM r WINDOW t AS (PARTITION BY ts))
SELECT ticker, idx, round(lag(ref) OVER w, 6) + 0.0 AS xas_mkt_lead_ret_1, round(({S.full("sum", "r", 20)}) - ({S.full("sum", "ref", 20)}), 6) + 0.0 AS xas_rs_mkt_20 FROM m {S.windows(20)}"""

MULTI = ["momentum_alignment_multi", "rsi_spread_1h_1d", "volatility_ratio_1h_1d", "macd_hist_alignment_multi", "xtf_zscore_1h_vs_1d", "price_vs_sma_alignment_multi"]


def multi_timeframe(spark, d):
    b = stores.kept(hourly(spark, d))
    day = stores.kept(B.daily(b))
    series = {"1d": day.withColumn("ts", F.col("session").cast("timestamp")), "1w": B.weekly(day).withColumn("ts", F.col("available_at"))}
    contexts = {k: X.core(B.indexed(x.select("ticker", "ts", "open", "high", "low", "close", "volume", "available_at"))).join(x.select("ticker", "ts", "available_at"), ["ticker", "ts"]) for k, x in series.items()}
    return rounded(X.multi_timeframe(X.projected(X.core(b), contexts)), PROJECTED + MULTI)


PROJECTED = [f"{c}_{k}" for k in X.CONTEXTS for c in X.CORE]


def _sign_mean(name: str) -> str:
    return f"list_avg(list_filter([sign(c.{name}), sign(day.{name}), sign(wk.{name})], lambda v: v IS NOT NULL))"


def _renamed(text: str, suffix: str) -> str:
    """The tables of a WITH clause by other names."""
    return re.sub(r"\b(bars|tr|atr|d|wilder|rsi|fast|macd|x|core)(?= AS \(|\.)|(?<=FROM )(bars|tr|atr|d|wilder|rsi|fast|macd|x)\b|(?<=JOIN )(bars|tr|atr|d|wilder|rsi|fast|macd|x)\b", lambda m: m.group(0) + suffix, text)


_OTHERS = S.core_features("bars AS (SELECT 1)").removeprefix("WITH RECURSIVE bars AS (SELECT 1), ")
MULTI_TIMEFRAME = (
    S.core_features(S.BARS_1H)
    + ", "
    + SESSIONS.removeprefix(f"{S.BARS_1H}, ")
    + """, bars_d AS (SELECT ticker, session::TIMESTAMP AS ts, open, high, low, close, volume, available_at, (row_number() OVER (PARTITION BY ticker ORDER BY session) - 1)::INT AS idx FROM s),
weeks AS (SELECT ticker, first(open ORDER BY session) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY session) AS close, sum(volume) AS volume, max(available_at) AS available_at FROM s GROUP BY ticker, isoyear(session), weekofyear(session)),
bars_w AS (SELECT *, available_at AS ts, (row_number() OVER (PARTITION BY ticker ORDER BY available_at) - 1)::INT AS idx FROM weeks), """
    + _renamed(_OTHERS, "_d") + ", " + _renamed(_OTHERS, "_w")
    + f""", day AS (SELECT c.*, available_at FROM core_d c JOIN bars_d b USING (ticker, idx)), wk AS (SELECT c.*, available_at FROM core_w c JOIN bars_w b USING (ticker, idx)),
j AS (SELECT c.ticker, c.idx, c.ts, day.available_at AS available_at_1d, wk.available_at AS available_at_1w, {", ".join(f"{t}.{n} AS {n}_{k}" for k, t in zip(X.CONTEXTS, ("day", "wk")) for n in X.CORE)},
  {_sign_mean("log_return_5")} AS momentum_alignment_multi, (c.rsi_14 - day.rsi_14) / 100 AS rsi_spread_1h_1d, c.atr_pct_14 / CASE WHEN abs(day.atr_pct_14) > 1e-9 THEN day.atr_pct_14 END AS volatility_ratio_1h_1d,
  {_sign_mean("macd_hist")} AS macd_hist_alignment_multi, ln(1 + day.dist_to_sma_20) / (c.realized_volatility_20 + 1e-12) AS xtf_zscore_1h_vs_1d, {_sign_mean("dist_to_sma_20")} AS price_vs_sma_alignment_multi
  FROM (SELECT *, ts + INTERVAL 1 HOUR AS decision FROM core) c ASOF LEFT JOIN day ON c.ticker = day.ticker AND c.decision >= day.available_at ASOF LEFT JOIN wk ON c.ticker = wk.ticker AND c.decision >= wk.available_at)
SELECT ticker, idx, ts, available_at_1d, available_at_1w, {S.rounded(PROJECTED + MULTI)} FROM j"""
)

QUERIES = {
    "bars_1h": bars_1h, "bars_1d": bars_1d, "bars_session_daily": bars_session_daily, "bars_weekly": bars_weekly, "source_quality": source_quality, "universe": universe,
    "core_features_1h": core_features_1h, "core_features_1d": core_features_1d, "session_features": session_features, "optional_features": optional_features,
    "market_features": market_features, "multi_timeframe": multi_timeframe,
}

_CORE = S.rounded(X.CORE + X.OPT_IN + ["atr"])
ORACLES = {
    "bars_1h": f"WITH {S.BARS_1H} SELECT ticker, idx, ts, {S.rounded(OHLCV)} FROM bars",
    "bars_1d": f"WITH {S.BARS_1D} SELECT ticker, idx, ts, {S.rounded(OHLCV)} FROM bars",
    "bars_session_daily": f"WITH {SESSIONS} SELECT ticker, session::VARCHAR AS session, {S.rounded(OHLCV)}, available_at, parts FROM s",
    "bars_weekly": f"""WITH {SESSIONS} SELECT ticker, isoyear(session)::VARCHAR || '-' || lpad(weekofyear(session)::VARCHAR, 2, '0') AS week, round(first(open ORDER BY session), 6) AS open, round(max(high), 6) AS high,
      round(min(low), 6) AS low, round(last(close ORDER BY session), 6) AS close, sum(volume) AS volume, max(available_at) AS available_at, count(*) AS days FROM s GROUP BY 1, 2""",
    "source_quality": SOURCE_QUALITY,
    "universe": "SELECT DISTINCT event_type AS ticker FROM events WHERE value > 0",
    "core_features_1h": f"{S.core_features(S.BARS_1H)} SELECT ticker, idx, ts, {_CORE} FROM core",
    "core_features_1d": f"{S.core_features(S.BARS_1D)} SELECT ticker, idx, ts, {_CORE} FROM core",
    "session_features": SESSION_FEATURES,
    "optional_features": OPTIONAL_FEATURES,
    "market_features": MARKET_FEATURES,
    "multi_timeframe": MULTI_TIMEFRAME,
}
