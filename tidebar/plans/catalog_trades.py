"""Queries on events, trades, folds and the capital replay, with a closed-form score; each with DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import engine as E
from tidebar.operators import features as X
from tidebar.operators import trades as T
from tidebar.plans import sql as S
from tidebar.plans.catalog_bars import hourly, rounded

THETA, THETAS, STRENGTH = 0.5, [0.4, 0.45, 0.5, 0.55, 0.6], 0.5
NAMES = ["log_return_5", "close_z_score_20", "rsi_14"]


def _parts(spark, d):
    bars = hourly(spark, d)
    features = X.core(bars)
    events = T.candidates(features)
    return bars, features, events, T.simulated(bars, events)


def _scored(features, trades):
    """A fixed function of the features stands in for a model."""
    z = F.col("direction") * (0.5 * F.col("close_z_score_20") + 0.02 * (F.col("rsi_14") - 50))
    p = F.round(1 / (1 + F.exp(-z)), 6)
    return trades.join(features.select("ticker", F.col("idx").alias("t0"), "close_z_score_20", "rsi_14"), ["ticker", "t0"]).where("close_z_score_20 IS NOT NULL").withColumn("p", p)


def candidate_events(spark, d):
    return rounded(T.candidates(X.core(hourly(spark, d))), ["atr_t0", "width_tp", "width_sl"])


def gated_events(spark, d):
    x = T.candidates(X.core(hourly(spark, d)), floor="realized_volatility_20", floor_k=0.2, trend="macd_hist")
    return x.select("ticker", "t0", "direction")


LEVELS = ["entry_fill", "exit_fill", "net_return", "target_level", "stop_level", "width_pct"]


def simulated_trades(spark, d):
    return rounded(_parts(spark, d)[3], LEVELS)


def label_weights(spark, d):
    _, _, _, trades = _parts(spark, d)
    y = trades.select("ticker", "t0", (F.col("net_return") > 0).cast("int").alias("y"))
    return rounded(T.uniqueness(trades).join(y, ["ticker", "t0"]), ["weight"])


def training_matrix(spark, d):
    bars, features, _, trades = _parts(spark, d)
    bound = F.lit(480)
    x = T.purged(trades, bound).join(features.select("ticker", F.col("idx").alias("t0"), "ts", *NAMES), ["ticker", "t0"])
    ok = F.when(F.greatest(*[F.col(n).isNull().cast("int") for n in NAMES]) == 1, "nan")
    out = x.withColumn("dropped", ok).where("dropped IS NULL").join(T.uniqueness(trades), ["ticker", "t0"])
    setup = F.concat_ws(":", "ticker", F.col("t0").cast("string"), F.col("direction").cast("string"))
    cols = out.select(setup.alias("setup_id"), "ts", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("decision_ts"), *NAMES, "target_level", "stop_level", "width_pct", "market_exit_reason", "net_return", (F.col("net_return") > 0).cast("int").alias("y"), "weight")
    return rounded(cols, [*NAMES, "target_level", "stop_level", "width_pct", "net_return", "weight"])


def walk_forward_folds(spark, d):
    return T.folds(T.candidates(X.core(hourly(spark, d))))


def fold_average_precision(spark, d):
    _, features, events, trades = _parts(spark, d)
    x = T.folds(events).where("role = 'val'").join(_scored(features, trades), ["ticker", "t0"]).withColumn("y", (F.col("net_return") > 0).cast("int"))
    return rounded(T.average_precision(x, ["ticker", "fold"]), ["average_precision"])


def train_statistics(spark, d):
    return rounded(T.train_stats(X.core(hourly(spark, d)), NAMES, F.col("idx") < 480), ["mu", "sigma"])


def pooled_statistics(spark, d):
    return rounded(T.train_stats(X.core(hourly(spark, d)), NAMES, F.col("idx") < 480, pooled=True), ["mu", "sigma"])


def sequence_windows(spark, d):
    x = T.sequences(X.core(hourly(spark, d)), NAMES, 60)
    total = F.aggregate("seq", F.lit(0.0), lambda a, r: a + r[0].cast("double"))
    return x.select("ticker", "idx", F.size("seq").alias("steps"), (F.round(total, 4) + 0.0).alias("sum_first"))


def _ledger(spark, d, strength=None, thetas=None):
    bars, features, _, trades = _parts(spark, d)
    x = _scored(features, trades).withColumn("size", E.kelly(F.col("p"), strength))
    keys = ["ticker"]
    if thetas:
        x, keys = x.withColumn("theta", F.explode(F.array(*[F.lit(t) for t in thetas]))), ["ticker", "theta"]
    x = x.withColumn("passes", F.col("p") >= (F.col("theta") if thetas else F.lit(THETA)))
    return bars, trades, E.replay(x, keys), x


def capital_replay(spark, d):
    _, trades, r, _ = _ledger(spark, d)
    x = r.where("fate = 'entered'").join(trades, ["ticker", "t0"])
    return rounded(x.select("ticker", "trade_id", "t0", "direction", "p", "entry_fill", "exit_idx", "exit_fill", "market_exit_reason", "capital_before", "capital_after"), ["entry_fill", "exit_fill", "capital_before", "capital_after"])


def kelly_replay(spark, d):
    r = _ledger(spark, d, STRENGTH)[2]
    return rounded(r.where("fate = 'entered'").select("ticker", "trade_id", "t0", "capital_after"), ["capital_after"])


SUMMARY = ["end_capital", "gross_profit", "gross_loss", "profit_factor", "return_pct", "uncovered_total", "uncovered_max"]


def replay_summary(spark, d):
    _, trades, r, _ = _ledger(spark, d)
    return rounded(E.summary(r, trades), SUMMARY)


def equity_drawdown(spark, d):
    bars, trades, r, x = _ledger(spark, d)
    points = E.equity(bars, r.where("fate = 'entered'").join(x.drop("p"), ["ticker", "t0"]))
    return rounded(E.drawdown(points), ["max_drawdown_pct"])


def buy_and_hold(spark, d):
    return rounded(E.hold(hourly(spark, d)), ["end_capital", "return_pct"])


def hold_fallback(spark, d):
    return rounded(E.hold_summary(hourly(spark, d)), ["end_capital", "return_pct", "max_drawdown_pct"])


def hold_marks(spark, d):
    return rounded(E.equity(hourly(spark, d), E.hold_ledger(hourly(spark, d))).select("ticker", "event_type", "bar_index", "equity"), ["equity"])


def _grid(spark, d):
    bars, features, events, trades = _parts(spark, d)
    x = _scored(features, trades).join(T.folds(events).where("role = 'val'").select("ticker", "t0", "fold"), ["ticker", "t0"])
    x = x.withColumns({"theta": F.explode(F.array(*[F.lit(t) for t in THETAS])), "size": F.lit(1.0)}).withColumn("passes", F.col("p") >= F.col("theta"))
    r = E.replay(x, ["ticker", "theta", "fold"])
    done = F.col("fate") == "entered"
    return r.groupBy("ticker", "theta", "fold").agg(F.coalesce(F.sum(F.when(done, F.ln(F.greatest(F.col("capital_after"), F.lit(1e-9)) / F.col("capital_before")))), F.lit(0.0)).alias("growth"), F.sum(done.cast("int")).alias("n"))


def operating_grid(spark, d):
    return rounded(_grid(spark, d), ["growth"])


def operating_point(spark, d):
    g = _grid(spark, d).groupBy("ticker", "theta").agg(F.array_sort(F.collect_list(F.struct("fold", "growth", F.col("n").cast("int").alias("n")))).alias("f"))
    g = g.select("ticker", "theta", F.lit(None).cast("double").alias("lambda"), F.lit("both").alias("direction"), F.col("f.growth").alias("fold_growth"), F.col("f.n").alias("fold_trades"))
    return rounded(E.operating_point(g, ["ticker"], least_trades=2).drop("lambda", "direction"), ["log_growth", "se"])


def quantile_cut(spark, d):
    _, features, events, trades = _parts(spark, d)
    x = T.folds(events).where("role = 'train'").join(_scored(features, trades), ["ticker", "t0"])
    out = x.groupBy("ticker", "fold").agg(F.percentile("p", F.array(*[F.lit(q) for q in (0.75, 0.88, 0.96)])).alias("q"), F.count(F.lit(1)).alias("n"))
    return rounded(out.select("ticker", "fold", "n", F.col("q")[0].alias("q75"), F.col("q")[1].alias("q88"), F.col("q")[2].alias("q96")), ["q75", "q88", "q96"])


BASE = f"""{S.core_features(S.BARS_1H)},
cand AS (
  SELECT ticker, idx AS t0, sign(log_return_5)::INT AS direction, atr AS atr_t0, atr * 2.0 AS width_tp, atr * 1.0 AS width_sl, realized_volatility_20 AS rv, macd_hist, log_return_5 AS mom
  FROM (SELECT *, max(idx) OVER (PARTITION BY ticker) AS last FROM core) WHERE idx < last AND log_return_5 IS NOT NULL AND log_return_5 <> 0 AND atr IS NOT NULL AND atr > 1e-9),
fills AS (
  SELECT c.*, b.open * (1 + direction * 2e-4) AS entry_fill, e.end_idx, least(t0 + 24, e.end_idx) AS t_sched
  FROM cand c JOIN bars b ON b.ticker = c.ticker AND b.idx = t0 + 1 JOIN (SELECT ticker, max(idx) AS end_idx FROM bars GROUP BY ticker) e ON e.ticker = c.ticker),
levels AS (SELECT *, entry_fill + direction * width_tp AS target_level, entry_fill - direction * width_sl AS stop_level FROM fills),
hits AS (
  SELECT l.ticker, l.t0, min(b.idx) AS hit FROM levels l JOIN bars b ON b.ticker = l.ticker AND b.idx BETWEEN t0 + 1 AND t_sched - 1
  WHERE direction * (b.close - target_level) >= 0 OR direction * (b.close - stop_level) <= 0 GROUP BY ALL),
sim AS (
  SELECT l.*, t0 + 1 AS t_fill, coalesce(hit + 1, t_sched) AS exit_idx, CASE WHEN hit IS NULL THEN s.close ELSE n.open END * (1 - direction * 2e-4) AS exit_fill,
    CASE WHEN hit IS NULL THEN CASE WHEN t_sched = end_idx THEN 'OOS_END_FORCED_EXIT' ELSE 'TIME_BARRIER' END
      WHEN direction * (h.close - target_level) >= 0 AND NOT direction * (h.close - stop_level) <= 0 THEN 'TARGET_TRIGGER' ELSE 'STOP_TRIGGER' END AS market_exit_reason,
    CASE WHEN hit IS NULL THEN 'scheduled' ELSE 'condition' END AS exit_kind
  FROM levels l LEFT JOIN hits USING (ticker, t0) JOIN bars s ON s.ticker = l.ticker AND s.idx = t_sched
  LEFT JOIN bars h ON h.ticker = l.ticker AND h.idx = hit LEFT JOIN bars n ON n.ticker = l.ticker AND n.idx = hit + 1),
trades AS (
  SELECT *, (direction * (exit_fill - entry_fill) - 1e-4 * (entry_fill + exit_fill)) / (entry_fill * (1 + 1e-4)) AS net_return,
    exit_idx + (exit_kind = 'scheduled')::INT AS flat_from, 100 * width_sl / greatest(1e-9, abs(entry_fill)) AS width_pct FROM sim),
span AS (SELECT ticker, t0, unnest(range(t0 + 1, least(t0 + 24, end_idx) + 1)) AS bar FROM trades),
weights AS (SELECT ticker, t0, avg(1.0 / n) AS weight FROM span JOIN (SELECT ticker, bar, count(*) AS n FROM span GROUP BY ALL) USING (ticker, bar) GROUP BY ALL),
scored AS (
  SELECT t.*, round(1 / (1 + exp(-(t.direction * (0.5 * close_z_score_20 + 0.02 * (rsi_14 - 50))))), 6) AS p
  FROM trades t JOIN core ON core.ticker = t.ticker AND core.idx = t.t0 WHERE close_z_score_20 IS NOT NULL),
ends AS (SELECT ticker, min(t0) AS ts, max(t0) AS te FROM cand GROUP BY ticker),
cuts AS (SELECT ticker, i::INT AS fold, trunc(ts + (te + 1 - ts) * i / 5)::INT AS val_lo, trunc(ts + (te + 1 - ts) * (i + 1) / 5)::INT AS val_hi FROM ends, range(1, 5) r(i)),
roles AS (
  SELECT ticker, fold, CASE WHEN t0 >= val_lo AND t0 < val_hi THEN 'val' WHEN t0 + 24 < val_lo - 35 THEN 'train' END AS role, t0, val_lo, val_hi FROM cand JOIN cuts USING (ticker)),
folds AS (
  SELECT ticker, fold, role, t0, val_lo, val_hi FROM roles WHERE role IS NOT NULL
  QUALIFY count(*) FILTER (role = 'val') OVER (PARTITION BY ticker, fold) >= 5 AND count(*) FILTER (role = 'train') OVER (PARTITION BY ticker, fold) >= 10)"""


def _chain(source: str, keys: str) -> str:
    """Taken trades of `source` (keys, t0, flat_from, r), one after the other."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ka = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{source},
nxt AS (SELECT {ka}, a.t0, min(b.t0) AS n FROM ev a JOIN ev b ON {on} AND b.t0 >= a.flat_from GROUP BY ALL),
steps AS (SELECT ev.*, n FROM ev LEFT JOIN nxt USING ({keys}, t0)),
chain AS (
  SELECT {keys}, t0, n, r, flat_from, 1 AS trade_id, 1000.0::DOUBLE AS capital_before, 1000.0 * (1 + greatest(r, -1)) AS capital_after FROM steps
  WHERE ({keys}, t0) IN (SELECT ({keys}, min(t0)) FROM ev GROUP BY {keys})
  UNION ALL
  SELECT {", ".join(f"b.{k}" for k in keys.split(", "))}, b.t0, b.n, b.r, b.flat_from, trade_id + 1, capital_after, capital_after * (1 + greatest(b.r, -1))
  FROM chain a JOIN steps b ON {on} AND b.t0 = a.n WHERE capital_after > 0)"""


EV = f"ev AS (SELECT ticker, t0, flat_from, net_return AS r FROM scored WHERE p >= {THETA})"
EV_KELLY = f"ev AS (SELECT * FROM (SELECT ticker, t0, flat_from, net_return * least(greatest({STRENGTH} * (p - (1 - p) / 2), 0.0), 1.0) AS r, {STRENGTH} * (p - (1 - p) / 2) AS f FROM scored WHERE p >= {THETA}) WHERE f > 0)"
GRID = """ev AS (SELECT s.ticker, theta, fold, t0, flat_from, net_return AS r FROM scored s JOIN folds USING (ticker, t0), (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6])::DOUBLE AS theta) WHERE role = 'val' AND p >= theta)"""
ALL_KEYS = """cells AS (SELECT DISTINCT s.ticker, theta, fold FROM scored s JOIN folds USING (ticker, t0), (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6])::DOUBLE AS theta) WHERE role = 'val'),
grid AS (SELECT ticker, theta, fold, coalesce(sum(ln(greatest(capital_after, 1e-9) / capital_before)), 0) AS growth, count(chain.t0) AS n FROM cells LEFT JOIN chain USING (ticker, theta, fold) GROUP BY ALL)"""
POINT = """pts AS (SELECT ticker, theta, sum(growth) AS log_growth, sum(n)::INT AS trades, count(*) AS k, coalesce(stddev_samp(growth), 0) / sqrt(count(*)) AS own_se FROM grid GROUP BY ALL),
flags AS (SELECT *, bool_or(trades >= 2) OVER t AS floor_met, min(theta) OVER t AS lo, max(theta) OVER t AS hi, row_number() OVER (PARTITION BY ticker ORDER BY trades DESC, log_growth DESC, theta DESC) AS most FROM pts WINDOW t AS (PARTITION BY ticker)),
pool AS (SELECT *, max(log_growth) OVER (PARTITION BY ticker) AS gmax FROM flags WHERE CASE WHEN floor_met THEN trades >= 2 ELSE most = 1 END),
se AS (SELECT ticker, arg_max(own_se, theta) AS se FROM pool WHERE log_growth >= gmax - 1e-12 GROUP BY ticker),
plateau AS (SELECT *, theta IN (lo, hi) AS theta_boundary, count(*) OVER (PARTITION BY ticker) AS plateau_size FROM pool JOIN se USING (ticker) WHERE log_growth >= gmax - se - 1e-12)
SELECT ticker, theta, round(log_growth, 6) + 0.0 AS log_growth, trades, floor_met AS trade_floor_met, false AS fold_spread_relaxed, theta_boundary, round(se, 6) AS se, plateau_size
FROM plateau QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY theta_boundary, theta DESC) = 1"""

QUERIES = {
    "candidate_events": candidate_events, "gated_events": gated_events, "simulated_trades": simulated_trades, "label_weights": label_weights, "training_matrix": training_matrix,
    "walk_forward_folds": walk_forward_folds, "fold_average_precision": fold_average_precision, "train_statistics": train_statistics, "pooled_statistics": pooled_statistics,
    "sequence_windows": sequence_windows, "capital_replay": capital_replay, "kelly_replay": kelly_replay, "replay_summary": replay_summary, "equity_drawdown": equity_drawdown,
    "buy_and_hold": buy_and_hold, "hold_fallback": hold_fallback, "hold_marks": hold_marks, "operating_grid": operating_grid, "operating_point": operating_point, "quantile_cut": quantile_cut,
}

_LONG = "SELECT ticker, unnest(['log_return_5', 'close_z_score_20', 'rsi_14']) AS feature, unnest([log_return_5, close_z_score_20, rsi_14]) AS v FROM core WHERE idx < 480"
HELD = f"""WITH {S.BARS_1H}, e AS (SELECT ticker, min(idx) AS first, max(idx) AS last, arg_min(open, idx) * (1 + 2e-4) AS buy, arg_max(close, idx) * (1 - 2e-4) AS sell FROM bars GROUP BY ticker), h AS (SELECT *, 1000 / (buy * (1 + 1e-4)) AS q FROM e),
f AS (SELECT *, 1000 + q * (sell - buy) - q * 1e-4 * (sell + buy) AS capital_after FROM h),
pts AS (SELECT ticker, 0 AS seq, 'entry_fee_mark' AS event_type, first AS bar_index, greatest(0, 1000 - q * buy * 1e-4) AS equity, capital_after FROM f
  UNION ALL SELECT f.ticker, idx - first + 1, 'held_close_mark', idx, greatest(0, 1000 + q * (close * (1 - 2e-4) - buy) - q * buy * 1e-4 - q * close * (1 - 2e-4) * 1e-4), capital_after FROM f JOIN bars USING (ticker)
  UNION ALL SELECT ticker, 1000000, 'exit_fill', last, capital_after, capital_after FROM f)"""

ORACLES = {
    "candidate_events": f"{BASE} SELECT ticker, t0, direction, {S.rounded(['atr_t0', 'width_tp', 'width_sl'])} FROM cand",
    "gated_events": f"{BASE} SELECT ticker, t0, direction FROM cand WHERE abs(mom) >= 0.2 * rv AND sign(macd_hist) = direction",
    "simulated_trades": f"{BASE} SELECT ticker, t0, direction, t_fill, exit_idx, market_exit_reason, exit_kind, flat_from, end_idx, {S.rounded(LEVELS)} FROM trades",
    "label_weights": f"{BASE} SELECT ticker, t0, round(weight, 6) AS weight, (net_return > 0)::INT AS y FROM weights JOIN trades USING (ticker, t0)",
    "training_matrix": f"""{BASE} SELECT concat_ws(':', t.ticker, t.t0::VARCHAR, t.direction::VARCHAR) AS setup_id, core.ts, core.ts + INTERVAL 1 HOUR AS decision_ts, market_exit_reason, (net_return > 0)::INT AS y,
      {S.rounded([*NAMES, 'target_level', 'stop_level', 'width_pct', 'net_return', 'weight'])}
      FROM trades t JOIN core ON core.ticker = t.ticker AND core.idx = t.t0 JOIN weights w ON w.ticker = t.ticker AND w.t0 = t.t0
      WHERE t.t0 + 59 <= 480 AND log_return_5 IS NOT NULL AND close_z_score_20 IS NOT NULL AND rsi_14 IS NOT NULL""",
    "walk_forward_folds": f"{BASE} SELECT * FROM folds",
    "fold_average_precision": f"""{BASE}, g AS (SELECT ticker, fold, p, sum((net_return > 0)::INT) AS tp, count(*) AS n FROM folds JOIN scored USING (ticker, t0) WHERE role = 'val' GROUP BY ALL),
      c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY ticker, fold) AS all_tp FROM g WINDOW w AS (PARTITION BY ticker, fold ORDER BY p DESC))
      SELECT ticker, fold, round(coalesce(sum(CASE WHEN all_tp > 0 THEN tp / all_tp * ctp / cn END), 0), 6) AS average_precision FROM c GROUP BY ALL""",
    "train_statistics": f"{BASE} SELECT ticker, feature, count(v) AS n, round(coalesce(avg(v), 0), 6) + 0.0 AS mu, round(coalesce(greatest(stddev_pop(v), 1e-8), 1), 6) AS sigma FROM ({_LONG}) GROUP BY ALL",
    "pooled_statistics": f"{BASE} SELECT feature, count(v) AS n, round(coalesce(avg(v), 0), 6) + 0.0 AS mu, round(coalesce(CASE WHEN stddev_pop(v) <= 1e-8 THEN 1 ELSE stddev_pop(v) END, 1), 6) AS sigma FROM ({_LONG}) GROUP BY ALL",
    "sequence_windows": f"""{BASE}, q AS (SELECT ticker, idx, count(CASE WHEN log_return_5 IS NOT NULL AND close_z_score_20 IS NOT NULL AND rsi_14 IS NOT NULL THEN 1 END) OVER w60 AS n, sum(log_return_5::FLOAT::DOUBLE) OVER w60 AS s FROM core {S.windows(60)})
      SELECT ticker, idx, 60 AS steps, round(s, 4) + 0.0 AS sum_first FROM q WHERE n = 60""",
    "capital_replay": f"""{_chain(BASE + ", " + EV, "ticker")} SELECT c.ticker, trade_id, c.t0, direction, p, exit_idx, market_exit_reason, {S.rounded(["entry_fill", "exit_fill", "capital_before", "capital_after"])}
      FROM chain c JOIN scored s ON s.ticker = c.ticker AND s.t0 = c.t0""",
    "kelly_replay": f"{_chain(BASE + ', ' + EV_KELLY, 'ticker')} SELECT ticker, trade_id, t0, round(capital_after, 6) AS capital_after FROM chain",
    "replay_summary": f"""{_chain(BASE + ", " + EV, "ticker")},
      fate AS (SELECT s.ticker, s.t0, p, c.t0 IS NOT NULL AS entered, EXISTS (SELECT 1 FROM chain k WHERE k.ticker = s.ticker AND k.t0 < s.t0 AND s.t0 < k.flat_from) AND NOT halted AS ignored, halted,
        capital_after - capital_before AS net, s.exit_idx - s.t_fill + 1 AS bars_in, market_exit_reason, trade_id, capital_after, CASE WHEN c.t0 IS NOT NULL THEN greatest(0, -capital_before * (1 + s.net_return)) END AS lost FROM (SELECT *, EXISTS (SELECT 1 FROM chain k WHERE k.ticker = z.ticker AND k.t0 < z.t0 AND k.capital_after <= 0) AS halted FROM scored z) s LEFT JOIN chain c ON c.ticker = s.ticker AND c.t0 = s.t0),
      a AS (SELECT ticker, count(*) AS signals_total, count(*) FILTER (entered) AS entered, count(*) FILTER (ignored) AS ignored_while_open, count(*) FILTER (NOT ignored AND NOT halted AND p < {THETA}) AS threshold_rejects,
        0::BIGINT AS not_selected, 0::BIGINT AS simultaneous_tie_skip, coalesce(arg_max(capital_after, trade_id), 1000) AS end_capital, coalesce(sum(net) FILTER (net > 0), 0) AS gross_profit, coalesce(-sum(net) FILTER (net < 0), 0) AS gross_loss,
        count(*) FILTER (net > 0) AS wins, count(*) FILTER (net < 0) AS losses, coalesce(sum(bars_in) FILTER (entered), 0)::BIGINT AS exposure_bars, count(*) FILTER (entered AND market_exit_reason = 'OOS_END_FORCED_EXIT') AS forced_exits,
        round(coalesce(sum(lost), 0), 6) + 0.0 AS uncovered_total, round(coalesce(max(lost), 0), 6) + 0.0 AS uncovered_max, coalesce(bool_or(capital_after <= 0), false) AS capital_depleted FROM fate GROUP BY ticker)
      SELECT * REPLACE (round(end_capital, 6) AS end_capital, round(gross_profit, 6) AS gross_profit, round(gross_loss, 6) AS gross_loss), round(CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss END, 6) AS profit_factor,
        round((end_capital / 1000 - 1) * 100, 6) AS return_pct, CASE WHEN entered = 0 THEN 'HODL_FALLBACK_NO_MODEL_TRADES' WHEN entered = 1 THEN 'ML_ONE_TRADE_LOW_EVIDENCE' ELSE 'ML_MULTI_TRADE' END AS result_mode FROM a""",
    "equity_drawdown": f"""{_chain(BASE + ", " + EV, "ticker")},
      l AS (SELECT s.*, trade_id, capital_before, capital_after, capital_before / (entry_fill * (1 + 1e-4)) AS q FROM chain c JOIN scored s ON s.ticker = c.ticker AND s.t0 = c.t0),
      pts AS (SELECT ticker, trade_id, 0 AS seq, greatest(0, capital_before - q * entry_fill * 1e-4) AS equity FROM l
        UNION ALL SELECT l.ticker, trade_id, b.idx - t_fill + 1, greatest(0, capital_before + direction * q * (b.close * (1 - direction * 2e-4) - entry_fill) - q * entry_fill * 1e-4 - q * b.close * (1 - direction * 2e-4) * 1e-4)
          FROM l JOIN bars b ON b.ticker = l.ticker AND b.idx BETWEEN t_fill AND exit_idx - (exit_kind = 'condition')::INT
        UNION ALL SELECT ticker, trade_id, 1000000, capital_after FROM l),
      k AS (SELECT *, greatest(1000.0, max(equity) OVER (PARTITION BY ticker ORDER BY trade_id, seq ROWS UNBOUNDED PRECEDING)) AS peak FROM pts)
      SELECT ticker, round(max((peak - equity) / greatest(1e-9, peak)) * 100, 6) AS max_drawdown_pct FROM k GROUP BY ticker""",
    "buy_and_hold": f"""WITH {S.BARS_1H}, e AS (SELECT ticker, arg_min(open, idx) * (1 + 2e-4) AS buy, arg_max(close, idx) * (1 - 2e-4) AS sell FROM bars GROUP BY ticker),
      f AS (SELECT ticker, 1000 + 1000 / (buy * (1 + 1e-4)) * (sell - buy - 1e-4 * (sell + buy)) AS end_capital FROM e)
      SELECT ticker, round(end_capital, 6) AS end_capital, round((end_capital / 1000 - 1) * 100, 6) AS return_pct FROM f""",
    "hold_fallback": f"""{HELD} SELECT ticker, round(max(capital_after), 6) AS end_capital, round((max(capital_after) / 1000 - 1) * 100, 6) + 0.0 AS return_pct, round(max((peak - equity) / greatest(1e-9, peak)) * 100, 6) + 0.0 AS max_drawdown_pct, NULL::DOUBLE AS profit_factor, 0 AS trades, 1 AS benchmark_trades,
      100.0::DOUBLE AS time_in_market_pct, max(capital_after) <= 0 AS capital_depleted, 'HODL_FALLBACK_NO_MODEL_TRADES' AS result_mode FROM (SELECT *, greatest(1000.0, max(equity) OVER (PARTITION BY ticker ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS peak FROM pts) GROUP BY ticker""",
    "hold_marks": f"{HELD} SELECT ticker, event_type, bar_index, round(equity, 6) + 0.0 AS equity FROM pts",
    "operating_grid": f"{_chain(BASE + ', ' + GRID, 'ticker, theta, fold')}, {ALL_KEYS} SELECT ticker, theta, fold, round(growth, 6) + 0.0 AS growth, n FROM grid",
    "operating_point": f"{_chain(BASE + ', ' + GRID, 'ticker, theta, fold')}, {ALL_KEYS}, {POINT}",
    "quantile_cut": f"""{BASE} SELECT ticker, fold, count(*) AS n, round(quantile_cont(p, 0.75), 6) AS q75, round(quantile_cont(p, 0.88), 6) AS q88, round(quantile_cont(p, 0.96), 6) AS q96
      FROM folds JOIN scored USING (ticker, t0) WHERE role = 'train' GROUP BY ALL""",
}
