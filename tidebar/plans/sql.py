"""DuckDB text that several oracles share."""

from __future__ import annotations

BARS_1H = """bars AS (
  SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, ts) AS close, count(*)::DOUBLE AS volume,
    (row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('hour', ts)) - 1)::INT AS idx
  FROM events WHERE value > 0 GROUP BY event_type, date_trunc('hour', ts))"""

BARS_1D = """bars AS (
  SELECT l_returnflag AS ticker, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, first(p ORDER BY l_orderkey, l_linenumber, p) AS open, max(p) AS high, min(p) AS low,
    last(p ORDER BY l_orderkey, l_linenumber, p) AS close, sum(l_quantity) AS volume,
    (row_number() OVER (PARTITION BY l_returnflag ORDER BY date_trunc('day', l_shipdate)) - 1)::INT AS idx
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0)
  GROUP BY l_returnflag, date_trunc('day', l_shipdate))"""


def windows(*sizes: int, by: str = "ticker", order: str = "idx") -> str:
    """A WINDOW clause with w (whole past) and w<n> (last n rows)."""
    base = f"w AS (PARTITION BY {by} ORDER BY {order})"
    return "WINDOW " + ", ".join([base, *[f"w{n} AS (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes]])


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg}({x}) OVER w{n} END"


def zscore(x: str, n: int, flat: str = "0") -> str:
    return f"CASE WHEN count({x}) OVER w{n} < {n} THEN NULL WHEN min({x}) OVER w{n} = max({x}) OVER w{n} THEN {flat} ELSE ({x} - avg({x}) OVER w{n}) / nullif(stddev_pop({x}) OVER w{n}, 0) END"


ATR = """atr AS (
  SELECT ticker, idx, seed AS v FROM (
    SELECT ticker, idx, avg(tr) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS seed FROM tr) WHERE idx = 13
  UNION ALL
  SELECT tr.ticker, tr.idx, (atr.v * 13 + tr.tr) / 14 FROM atr JOIN tr ON tr.ticker = atr.ticker AND tr.idx = atr.idx + 1)"""
TR = """tr AS (
  SELECT ticker, idx, greatest(high - low, abs(high - coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY idx), close)),
    abs(low - coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY idx), close))) AS tr FROM bars)"""
CHANGES = "d AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY idx) AS ch FROM bars)"
RSI = """wilder AS (
  SELECT ticker, idx, greatest(ch, 0) AS up, greatest(-ch, 0) AS down FROM d WHERE idx = 1
  UNION ALL
  SELECT d.ticker, d.idx, 13.0 / 14 * up + greatest(ch, 0) / 14, 13.0 / 14 * down + greatest(-ch, 0) / 14 FROM wilder JOIN d ON d.ticker = wilder.ticker AND d.idx = wilder.idx + 1),
rsi AS (SELECT ticker, idx, CASE WHEN idx < 14 THEN NULL WHEN down > 0 THEN 100 - 100 / (1 + up / down) WHEN up > 0 THEN 100 ELSE 50 END AS rsi_14 FROM wilder)"""
MACD = """fast AS (
  SELECT ticker, idx, close AS f, close AS s, 0.0::DOUBLE AS l, NULL::DOUBLE AS sig FROM bars WHERE idx = 0
  UNION ALL
  SELECT ticker, idx, f, s, f - s, CASE WHEN idx < 25 THEN NULL WHEN idx = 25 THEN f - s ELSE 0.8 * sig + 0.2 * (f - s) END
  FROM (SELECT b.ticker, b.idx, 11.0 / 13 * f + 2.0 / 13 * close AS f, 25.0 / 27 * s + 2.0 / 27 * close AS s, sig FROM fast JOIN bars b ON b.ticker = fast.ticker AND b.idx = fast.idx + 1)),
macd AS (SELECT ticker, idx, CASE WHEN idx >= 25 THEN l END AS macd_line, CASE WHEN idx >= 33 THEN sig END AS macd_signal, CASE WHEN idx >= 33 THEN l - sig END AS macd_hist FROM fast)"""


def core_features(bars: str) -> str:
    """A WITH RECURSIVE clause whose last table is `core`, unrounded."""
    return f"""WITH RECURSIVE {bars}, {TR}, {ATR}, {CHANGES}, {RSI}, {MACD},
x AS (
  SELECT bars.*, atr.v AS atr, rsi_14, macd_line, macd_signal, macd_hist,
    ln(close / lag(close, 1) OVER w) AS log_return_1, ln(close / lag(close, 5) OVER w) AS log_return_5, ln(close / lag(close, 20) OVER w) AS log_return_20,
    {full("avg", "close", 4)} AS sma_4, {full("avg", "close", 10)} AS sma_10, {full("avg", "close", 20)} AS sma_20, {full("avg", "close", 50)} AS sma_50, {full("stddev_pop", "close", 20)} AS dev
  FROM bars LEFT JOIN atr USING (ticker, idx) LEFT JOIN rsi USING (ticker, idx) LEFT JOIN macd USING (ticker, idx) {windows(4, 10, 20, 50)}),
core AS (
  SELECT ticker, idx, ts, sign(log_return_5)::DOUBLE AS direction, log_return_1, log_return_5, log_return_20, {zscore("close", 20)} AS close_z_score_20,
    close / sma_20 - 1 AS dist_to_sma_20, close / sma_50 - 1 AS dist_to_sma_50, sma_20 / sma_50 - 1 AS sma_20_sma_50_ratio, {zscore("volume", 20)} AS volume_z_score_20,
    100 * atr / close AS atr_pct_14, {full("stddev_pop", "log_return_1", 20)} * sqrt(20) AS realized_volatility_20, rsi_14,
    CASE WHEN dev = 0 THEN 0.5 ELSE (close - (sma_20 - 2 * dev)) / (4 * dev) END AS bollinger_percent_b, 4 * dev / sma_20 AS bollinger_bandwidth,
    macd_line, macd_signal, macd_hist, (sma_10 - lag(sma_10) OVER w) / nullif(lag(sma_10) OVER w, 0) AS ma_slope_10, (sma_4 - lag(sma_4) OVER w) / nullif(lag(sma_4) OVER w, 0) AS ma_slope_4,
    ({full("stddev_pop", "log_return_1", 6)} * sqrt(6)) / nullif({full("stddev_pop", "log_return_1", 12)} * sqrt(12), 0) AS vol_regime_6_12, atr
  FROM x {windows(6, 12, 20)})"""


def rounded(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)
