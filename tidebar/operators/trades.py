"""Candidate events, barrier trades, labels and folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.rolling import by

EPS = 1e-9


@dataclass(frozen=True)
class Costs:
    """Fixed values by default: horizon in bars, barrier widths in ATR, costs of each side, embargo."""

    horizon: int = 24
    take: float = 2.0
    stop: float = 1.0
    fee: float = 1e-4
    slip: float = 2e-4
    embargo: int = 35
    capital: float = 1000.0


def candidates(features: DataFrame, costs: Costs = Costs(), momentum: str = "log_return_5", floor: str | None = None, floor_k: float = 0.0, trend: str | None = None) -> DataFrame:
    """ticker, t0, direction, atr_t0, width_tp, width_sl: bars whose momentum has a sign and whose barriers have a width.

    floor: the momentum must reach floor_k times this feature; trend: this feature's sign must agree.
    """
    last = F.max("idx").over(Window.partitionBy("ticker"))
    x = features.withColumn("last", last).where((F.col("idx") < F.col("last")) & F.col(momentum).isNotNull() & F.col("atr").isNotNull() & (F.col(momentum) != 0))
    x = x.where((F.col("atr") * costs.take > EPS) & (F.col("atr") * costs.stop > EPS))
    if floor:
        x = x.where(F.abs(F.col(momentum)) >= floor_k * F.col(floor))
    if trend:
        x = x.where(F.signum(F.col(trend)) == F.signum(F.col(momentum)))
    return x.select("ticker", F.col("idx").alias("t0"), F.signum(F.col(momentum)).cast("int").alias("direction"), F.col("atr").alias("atr_t0"), (F.col("atr") * costs.take).alias("width_tp"), (F.col("atr") * costs.stop).alias("width_sl"))


def simulated(bars: DataFrame, events: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Each event as a trade: closes are held against barriers around the fill; a hit leaves at the next open.

    The bars ahead of each bar come as one bounded array (horizon rows), so there is no range join.
    """
    ahead = F.collect_list(F.struct("idx", "close", F.col("next_open"))).over(by().rowsBetween(1, costs.horizon))
    b = bars.withColumn("next_open", F.lead("open").over(by())).withColumns({"ahead": ahead, "end_idx": F.max("idx").over(Window.partitionBy("ticker"))})
    x = events.join(b.select("ticker", F.col("idx").alias("t0"), "next_open", "ahead", "end_idx"), ["ticker", "t0"])
    s = F.col("direction")
    x = x.withColumn("entry_fill", F.col("next_open") * (1 + s * costs.slip)).withColumn("t_sched", F.least(F.col("t0") + costs.horizon, F.col("end_idx")))
    x = x.withColumns({"target_level": F.col("entry_fill") + s * F.col("width_tp"), "stop_level": F.col("entry_fill") - s * F.col("width_sl")})
    target = lambda c: s * (c - F.col("target_level")) >= 0
    stop = lambda c: s * (c - F.col("stop_level")) <= 0
    x = x.withColumn("hit", F.get(F.filter("ahead", lambda a: (a["idx"] < F.col("t_sched")) & (target(a["close"]) | stop(a["close"]))), F.lit(0)))
    hit = F.col("hit").isNotNull()
    reason = F.when(hit & target(F.col("hit.close")) & ~stop(F.col("hit.close")), "TARGET_TRIGGER").when(hit, "STOP_TRIGGER").when(F.col("t_sched") == F.col("end_idx"), "OOS_END_FORCED_EXIT").otherwise("TIME_BARRIER")
    scheduled = F.get(F.col("ahead"), F.col("t_sched") - F.col("t0") - 1)["close"]
    x = x.withColumns({"exit_idx": F.when(hit, F.col("hit.idx") + 1).otherwise(F.col("t_sched")), "exit_fill": F.when(hit, F.col("hit.next_open")).otherwise(scheduled) * (1 - s * costs.slip), "market_exit_reason": reason, "exit_kind": F.when(hit, "condition").otherwise("scheduled")})
    gain = s * (F.col("exit_fill") - F.col("entry_fill")) - costs.fee * (F.col("entry_fill") + F.col("exit_fill"))
    x = x.withColumns({"t_fill": F.col("t0") + 1, "net_return": gain / (F.col("entry_fill") * (1 + costs.fee)), "flat_from": F.when(hit, F.col("exit_idx")).otherwise(F.col("exit_idx") + 1), "width_pct": 100 * F.col("width_sl") / F.greatest(F.lit(EPS), F.abs("entry_fill"))})
    return x.select("ticker", "t0", "direction", "t_fill", "entry_fill", "exit_idx", "exit_fill", "market_exit_reason", "exit_kind", "net_return", "target_level", "stop_level", "width_pct", "flat_from", "end_idx")


def uniqueness(trades: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """ticker, t0, weight: the mean over a label's bars of one over the number of labels alive there."""
    span = trades.select("ticker", "t0", F.explode(F.sequence(F.col("t0") + 1, F.least(F.col("t0") + costs.horizon, F.col("end_idx")))).alias("bar"))
    alive = span.groupBy("ticker", "bar").agg(F.count(F.lit(1)).alias("alive"))
    return span.join(alive, ["ticker", "bar"]).groupBy("ticker", "t0").agg(F.avg(1 / F.greatest(F.lit(1), F.col("alive"))).alias("weight"))


def purged(events: DataFrame, boundary: Column, costs: Costs = Costs()) -> DataFrame:
    """Events whose label ends, with the embargo, at or before the boundary bar."""
    return events.where(F.col("t0") + costs.horizon + costs.embargo <= boundary)


def folds(events: DataFrame, k: int = 4, costs: Costs = Costs(), least_val: int = 5, least_train: int = 10) -> DataFrame:
    """ticker, fold, role, t0, val_lo: expanding walk-forward folds; a training label ends an embargo before its fold."""
    ends = events.groupBy("ticker").agg(F.min("t0").alias("ts"), F.max("t0").alias("te"))
    edge = lambda i: (F.col("ts") + (F.col("te") + 1 - F.col("ts")) * i / (k + 1)).cast("int")
    cuts = ends.select("ticker", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"), "ts", "te").select("ticker", "fold", edge(F.col("fold")).alias("val_lo"), edge(F.col("fold") + 1).alias("val_hi"))
    x = events.select("ticker", "t0").join(cuts, "ticker")
    val = (F.col("t0") >= F.col("val_lo")) & (F.col("t0") < F.col("val_hi"))
    train = F.col("t0") + costs.horizon < F.col("val_lo") - costs.embargo
    x = x.withColumn("role", F.when(val, "val").when(train, "train")).where("role IS NOT NULL")
    by = Window.partitionBy("ticker", "fold")
    x = x.withColumns({"nv": F.sum((F.col("role") == "val").cast("int")).over(by), "nt": F.sum((F.col("role") == "train").cast("int")).over(by)})
    return x.where((F.col("nv") >= least_val) & (F.col("nt") >= least_train)).select("ticker", "fold", "role", "t0", "val_lo", "val_hi")


def average_precision(scored: DataFrame, keys: list[str], label: str = "y", score: str = "p") -> DataFrame:
    """Tie-grouped: the rows of one score enter the ranking together."""
    g = scored.groupBy(*keys, score).agg(F.sum(label).alias("tp"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"ctp": F.sum("tp").over(w), "cn": F.sum("n").over(w), "all": F.sum("tp").over(Window.partitionBy(*keys))})
    return g.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("all") > 0, F.col("tp") / F.col("all") * F.col("ctp") / F.col("cn"))), F.lit(0.0)).alias("average_precision"))


def train_stats(features: DataFrame, names: list[str], before: Column, pooled: bool = False) -> DataFrame:
    """Mean and deviation of each feature's finite values on the rows before a bound; per ticker, or over all of them.

    Deviations of 1e-8 and below count as 1e-8 for a ticker, as 1 for the pool; without values 0 and 1.
    """
    x = features.where(before)
    long = x.select("ticker", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names])).alias("f")).select("ticker", "f.feature", F.when(F.abs("f.v") < float("inf"), F.col("f.v")).alias("v"))
    dev = F.stddev_pop("v")
    keys = ["feature"] if pooled else ["ticker", "feature"]
    floor = F.when(dev <= 1e-8, 1.0).otherwise(dev) if pooled else F.greatest(dev, F.lit(1e-8))
    return long.groupBy(*keys).agg(F.count("v").alias("n"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mu"), F.coalesce(F.when(F.count("v") > 0, floor), F.lit(1.0)).alias("sigma"))


def normalised(features: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """ticker, idx and the features less their mean, by their deviation; stats: from train_stats(...), per ticker or pooled. A feature that stood still is 0 where it still does."""
    keys = ["ticker"] if "ticker" in stats.columns else []
    of = lambda n, c: F.max(F.when(F.col("feature") == n, F.col(c)))
    wide = stats.groupBy(*keys).agg(*[of(n, c).alias(f"{c}_{n}") for n in names for c in ("mu", "sigma")])
    x = features.join(wide, keys) if keys else features.crossJoin(F.broadcast(wide))  # pooled: one row
    return x.select("ticker", "idx", *[((F.col(n) - F.col(f"mu_{n}")) / F.col(f"sigma_{n}")).alias(n) for n in names])


def sequences(features: DataFrame, names: list[str], length: int) -> DataFrame:
    """ticker, idx, seq (length x features, float): only windows without a null."""
    row = F.array(*[F.col(n).cast("float") for n in names])
    x = features.withColumn("seq", F.collect_list(row).over(by().rowsBetween(1 - length, 0)))
    return x.where((F.size("seq") == length) & F.forall("seq", lambda r: F.forall(r, lambda v: v.isNotNull()))).select("ticker", "idx", "seq")
