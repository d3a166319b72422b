"""One-position capital replay, and the choice of an operating point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.folds import running
from tidebar.operators.trades import EPS, Costs


def kelly(p: Column, strength: float | None, costs: Costs = Costs(), cap: float = 1.0) -> Column:
    """Share of the capital for a win probability and the barriers' payoff; all of it without a strength."""
    if strength is None:
        return F.lit(1.0)
    b = costs.take / costs.stop
    return F.least(F.greatest(strength * (p - (1 - p) / b), F.lit(0.0)), F.lit(cap))


def replay(scored: DataFrame, keys: list[str], costs: Costs = Costs(), tie: float = 0.0) -> DataFrame:
    """Walk each key's events in time; take the best that passes when flat.

    scored: keys, t0, p, passes (p reaches the threshold), size, net_return, flat_from. Returns every event with
    its fate (entered, ignored_while_open, threshold_rejects, not_selected, simultaneous_tie_skip, after_halt) and, if
    entered, trade_id, capital_before, capital_after and uncovered, the loss beyond the capital. Keys are advanced side by side; one key's events
    are one ordered fold, on the JVM.
    """
    order = Window.partitionBy(*keys, "t0").orderBy("_rank", "size", "net_return", "flat_from")
    good = F.when(F.col("passes"), F.col("p"))
    x = scored.select(*keys, "t0", (-F.col("p")).alias("_rank"), "p", "passes", "size", "net_return", "flat_from")
    x = x.withColumn("_place", F.row_number().over(order))
    best = Window.partitionBy(*keys, "t0")
    x = x.withColumn("_good", F.sort_array(F.collect_list(good).over(best), asc=False))
    tied = (F.size("_good") > 1) & (F.abs(F.get("_good", F.lit(0)) - F.get("_good", F.lit(1))) <= tie)
    alone = F.when(~F.coalesce("passes", F.lit(False)), "threshold_rejects").when(tied, "simultaneous_tie_skip").when((F.col("_place") > 1) | (F.col("size") <= 0), "not_selected").otherwise("entered")
    x = x.withColumn("_alone", alone).drop("_good")

    def step(s: Column, r: Column) -> Column:
        # what holds for a bar's events is what held before the first of them
        first = s["t0"].isNull() | (s["t0"] != r["t0"])
        flat, halted = F.when(first, s["flat"]).otherwise(s["group_flat"]), F.when(first, s["halted"]).otherwise(s["group_halted"])
        fate = F.when(halted, "after_halt").when(r["t0"] < flat, "ignored_while_open").otherwise(r["_alone"])
        enters = fate == "entered"
        capital = F.when(enters, F.greatest(F.lit(0.0), s["capital"] * (1 + F.greatest(r["size"] * r["net_return"], F.lit(-1.0))))).otherwise(s["capital"])
        fields = {
            "t0": r["t0"], "group_flat": flat, "group_halted": halted, "flat": F.when(enters, r["flat_from"]).otherwise(s["flat"]), "halted": s["halted"] | (enters & (capital <= 0)),
            "trade": s["trade"] + enters.cast("int"), "before": s["capital"], "capital": capital, "fate": fate,
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    start = {"t0": None, "group_flat": None, "group_halted": False, "flat": None, "halted": False, "trade": 0, "before": None, "capital": costs.capital, "fate": None}
    kind = "`t0`: int, `group_flat`: int, `group_halted`: boolean, `flat`: int, `halted`: boolean, `trade`: int, `before`: double, `capital`: double, `fate`: string"
    y = running(x, keys, ["t0", "_place"], start, kind, step)
    entered = F.col("state.fate") == "entered"
    return y.select(
        *keys, "t0", "p", F.col("state.fate").alias("fate"), F.when(entered, F.col("state.trade")).alias("trade_id"),
        F.when(entered, F.col("state.before")).alias("capital_before"), F.when(entered, F.col("state.capital")).alias("capital_after"),
        F.when(entered, F.greatest(F.lit(0.0), -F.col("state.before") * (1 + F.col("size") * F.col("net_return")))).alias("uncovered"),
    )


def equity(bars: DataFrame, ledger: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """ticker, trade_id, seq, event_type, bar_index, equity: entry fee, a mark at each held close, the exit."""
    s, size = F.col("direction"), F.col("size")
    q = size * F.col("capital_before") / (F.col("entry_fill") * (1 + costs.fee))
    fee = q * F.col("entry_fill") * costs.fee
    end = F.when(F.col("exit_kind") == "condition", F.col("exit_idx") - 1).otherwise(F.col("exit_idx"))
    entry = ledger.select("ticker", "trade_id", F.lit(0).alias("seq"), F.lit("entry_fee_mark").alias("event_type"), F.col("t_fill").alias("bar_index"), F.greatest(F.lit(0.0), F.col("capital_before") - fee).alias("equity"))
    held = ledger.withColumn("idx", F.explode(F.sequence(F.col("t_fill"), F.greatest(F.col("t_fill"), end)))).where(F.col("idx") <= end).join(bars.select("ticker", "idx", "close"), ["ticker", "idx"])
    worth = F.col("close") * (1 - s * costs.slip)
    marks = held.select("ticker", "trade_id", (F.col("idx") - F.col("t_fill") + 1).alias("seq"), F.lit("held_close_mark").alias("event_type"), F.col("idx").alias("bar_index"), F.greatest(F.lit(0.0), F.col("capital_before") + s * q * (worth - F.col("entry_fill")) - fee - q * worth * costs.fee).alias("equity"))
    out = ledger.select("ticker", "trade_id", F.lit(1 << 20).alias("seq"), F.lit("exit_fill").alias("event_type"), F.col("exit_idx").alias("bar_index"), F.col("capital_after").alias("equity"))
    return entry.unionAll(marks).unionAll(out)


def drawdown(points: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """ticker, max_drawdown_pct over the equity points, from the starting capital on."""
    w = Window.partitionBy("ticker").orderBy("trade_id", "seq").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max("equity").over(w), F.lit(costs.capital))
    return points.withColumn("down", (peak - F.col("equity")) / F.greatest(F.lit(EPS), peak)).groupBy("ticker").agg((F.max("down") * 100).alias("max_drawdown_pct"))


def summary(replayed: DataFrame, trades: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row for each ticker: capital, profit factor, wins, counters."""
    x = replayed.join(trades, ["ticker", "t0"])
    net = F.col("capital_after") - F.col("capital_before")
    fates = ["entered", "ignored_while_open", "threshold_rejects", "not_selected", "simultaneous_tie_skip"]
    gain, loss = F.sum(F.when(net > 0, net)), F.sum(F.when(net < 0, -net))
    inside = F.col("fate") == "entered"
    return x.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("signals_total"), *[F.sum((F.col("fate") == f).cast("int")).alias(f) for f in fates],
        F.coalesce(F.max_by("capital_after", F.col("trade_id")), F.lit(costs.capital)).alias("end_capital"), F.coalesce(gain, F.lit(0.0)).alias("gross_profit"), F.coalesce(loss, F.lit(0.0)).alias("gross_loss"),
        F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias("profit_factor"), F.sum((inside & (net > 0)).cast("int")).alias("wins"), F.sum((inside & (net < 0)).cast("int")).alias("losses"),
        F.sum(F.when(inside, F.col("exit_idx") - F.col("t_fill") + 1).otherwise(0)).alias("exposure_bars"), F.sum((inside & (F.col("market_exit_reason") == "OOS_END_FORCED_EXIT")).cast("int")).alias("forced_exits"),
        F.coalesce(F.sum("uncovered"), F.lit(0.0)).alias("uncovered_total"), F.coalesce(F.max("uncovered"), F.lit(0.0)).alias("uncovered_max"), F.coalesce(F.max(F.col("capital_after") <= 0), F.lit(False)).alias("capital_depleted"),
    ).withColumns({"return_pct": (F.col("end_capital") / costs.capital - 1) * 100, "result_mode": result_mode(F.col("entered"), F.lit(True))})


def result_mode(trades: Column, floor_met: Column) -> Column:
    """The names of the modes; a missed trade floor is decided first."""
    return F.when(~floor_met, "TRAIN_OOF_FLOOR_NOT_MET").when(trades == 0, "HODL_FALLBACK_NO_MODEL_TRADES").when(trades == 1, "ML_ONE_TRADE_LOW_EVIDENCE").otherwise("ML_MULTI_TRADE")


def hold(bars: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """ticker, end_capital, return_pct of buying the first open and selling the last close."""
    x = bars.groupBy("ticker").agg((F.min_by("open", "idx") * (1 + costs.slip)).alias("buy"), (F.max_by("close", "idx") * (1 - costs.slip)).alias("sell"))
    q = costs.capital / (F.col("buy") * (1 + costs.fee))
    end = costs.capital + q * (F.col("sell") - F.col("buy")) - q * costs.fee * (F.col("sell") + F.col("buy"))
    return x.select("ticker", end.alias("end_capital"), ((end / costs.capital - 1) * 100).alias("return_pct"))


def hold_ledger(bars: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The one trade of a ticker whose model made none, in the columns of a ledger: bought at the first open with all capital, sold at the last close. It is a benchmark trade, no model trade."""
    x = bars.groupBy("ticker").agg(F.min("idx").alias("t_fill"), F.max("idx").alias("exit_idx"), (F.min_by("open", "idx") * (1 + costs.slip)).alias("entry_fill"), (F.max_by("close", "idx") * (1 - costs.slip)).alias("exit_fill"))
    q = costs.capital / (F.col("entry_fill") * (1 + costs.fee))
    net = q * (F.col("exit_fill") - F.col("entry_fill")) - q * costs.fee * (F.col("entry_fill") + F.col("exit_fill"))
    return x.select(
        "ticker", F.lit(1).alias("trade_id"), F.lit(1).alias("direction"), F.col("t_fill").alias("t0"), "t_fill", F.lit(-1).alias("trigger_idx"), "exit_idx", "entry_fill", "exit_fill", F.lit(1.0).alias("size"), q.alias("quantity"),
        F.lit("scheduled").alias("exit_kind"), F.lit("HODL_FALLBACK_EXIT").alias("market_exit_reason"), F.lit("ACTIVE").alias("capital_state"), F.lit(costs.capital).alias("capital_before"), net.alias("net_pnl"), F.lit(0.0).alias("uncovered"), (F.lit(costs.capital) + net).alias("capital_after"),
    )


def hold_summary(bars: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """ticker, end_capital, return_pct, max_drawdown_pct and the counts of a held ticker: no model trades, one benchmark trade, no profit factor."""
    ledger = hold_ledger(bars, costs)
    down = drawdown(equity(bars, ledger, costs), costs)
    out = ledger.join(down, "ticker")
    return out.select(
        "ticker", F.col("capital_after").alias("end_capital"), ((F.col("capital_after") / costs.capital - 1) * 100).alias("return_pct"), "max_drawdown_pct", F.lit(None).cast("double").alias("profit_factor"), F.lit(0).alias("trades"), F.lit(1).alias("benchmark_trades"),
        F.lit(100.0).alias("time_in_market_pct"), (F.col("capital_after") <= 0).alias("capital_depleted"), result_mode(F.lit(0), F.lit(True)).alias("result_mode"),
    )


def operating_point(grid: DataFrame, keys: list[str], least_trades: int = 0, least_folds: int = 0, most_share: float = 1.0) -> DataFrame:
    """One grid row for each key.

    grid: keys, theta, lambda (null: none), direction, fold_growth, fold_trades. Points with enough trades, spread over
    folds if any are, compete; of those within one standard error of the best growth, ones inside the range
    of theta are preferred, then higher theta, smaller lambda, both directions. If none has enough trades the
    one with most trades is given and flagged.
    """
    by = Window.partitionBy(*keys)
    lam, way = F.coalesce("lambda", F.lit(0.0)), (F.col("direction") != "both").cast("int")
    g = grid.withColumns({
        "log_growth": F.aggregate("fold_growth", F.lit(0.0), lambda a, x: a + x), "trades": F.aggregate("fold_trades", F.lit(0), lambda a, x: a + x),
        "active": F.size(F.filter("fold_trades", lambda x: x > 0)), "k": F.size("fold_trades"), "tie": F.struct((-F.col("theta")).alias("a"), lam.alias("b"), way.alias("c")),
    })
    g = g.withColumn("share", F.when(F.col("trades") > 0, F.array_max("fold_trades") / F.when(F.col("trades") > 0, F.col("trades"))).otherwise(0.0))
    viable = F.col("trades") >= least_trades
    asked = (F.col("k") >= 2) & F.lit(least_folds > 1 or most_share < 1.0)
    spread = viable & (F.col("active") >= F.least(F.lit(least_folds), F.col("k"))) & (F.col("share") <= most_share + 1e-12)
    g = g.withColumns({"floor_met": F.max(viable.cast("int")).over(by) == 1, "any_spread": F.max(spread.cast("int")).over(by) == 1, "first_theta": F.min("theta").over(by), "last_theta": F.max("theta").over(by)})
    most = F.row_number().over(by.orderBy(F.desc("trades"), F.desc("log_growth"), "tie")) == 1
    g = g.withColumn("in_pool", F.when(~F.col("floor_met"), most).when(asked & F.col("any_spread"), spread).otherwise(viable)).withColumn("relaxed", F.col("floor_met") & asked & ~F.col("any_spread"))
    g = g.where("in_pool").withColumn("g_max", F.max("log_growth").over(by))
    near = F.col("log_growth") >= F.col("g_max") - 1e-12
    mean = F.col("log_growth") / F.col("k")
    dev = F.sqrt(F.aggregate("fold_growth", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.greatest(F.col("k") - 1, F.lit(1)))
    g = g.withColumn("own_se", F.when(F.col("k") > 1, dev / F.sqrt("k")).otherwise(0.0)).withColumn("se", F.min(F.when(near, F.struct("tie", "own_se"))).over(by)["own_se"])
    g = g.where(F.col("log_growth") >= F.col("g_max") - F.col("se") - 1e-12)
    edge = (F.col("theta") == F.col("first_theta")) | (F.col("theta") == F.col("last_theta"))
    g = g.withColumns({"theta_boundary": edge, "plateau_size": F.count(F.lit(1)).over(by)})
    chosen = F.row_number().over(by.orderBy(F.col("theta_boundary").cast("int"), "tie")) == 1
    return g.withColumn("chosen", chosen).where("chosen").select(*keys, "theta", "lambda", "direction", "log_growth", "trades", F.col("floor_met").alias("trade_floor_met"), F.col("relaxed").alias("fold_spread_relaxed"), "theta_boundary", "se", "plateau_size")
