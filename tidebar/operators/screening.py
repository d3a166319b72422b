"""Profiles of bar tables, a cascade of filters, and the choice of a sample without near-copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.folds import running
from tidebar.functions.rolling import back


def profile(bars: DataFrame, gap_hours: int = 96, violent: float = 0.35) -> DataFrame:
    """One row for each ticker. Gaps count hour boundaries between bars, not elapsed hours."""
    hours = (F.unix_timestamp(F.date_trunc("hour", "ts")) - F.unix_timestamp(F.date_trunc("hour", back("ts", 1)))) / 3600
    x = bars.withColumns({"gap": hours, "r": F.ln(F.col("close") / back("close", 1))})
    n = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    out = x.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("bars"), F.countDistinct("close").alias("distinct_close"), n(F.col("volume") == 0).alias("zero_volume"), n(F.col("high") == F.col("low")).alias("flat"),
        n(F.col("gap") > gap_hours).alias("gaps"), F.max("gap").cast("long").alias("max_gap_hours"), F.max(F.abs("r")).alias("max_abs_return"), n(F.abs("r") > violent).alias("violent"),
        F.stddev_samp("r").alias("volatility"), F.median(F.col("close") * F.col("volume")).alias("median_turnover"), F.min("close").alias("min_close"), F.max("close").alias("max_close"),
    )
    best = F.max("bars").over(Window.partitionBy())  # one row for each ticker
    return out.withColumns({"coverage": F.round(F.col("bars") / best, 6), "flat_share": F.round(F.col("flat") / F.col("bars"), 6), "resolution": F.round(F.col("distinct_close") / F.col("bars"), 6)})


def nearest_rank(values: str, q: float) -> Column:
    """The sorted value at round(q (n - 1)), halves to even."""
    s = F.array_sort(F.collect_list(values))
    return F.element_at(s, F.bround(q * (F.size(s) - 1), 0).cast("int") + 1)


# What a table must be to be sampled, in the order in which failures are counted.
SAMPLE_RULES = {
    "coverage": "coverage >= 0.99", "gaps": "gaps = 0", "max_gap_hours": "max_gap_hours <= 100", "violent": "violent = 0", "max_abs_return": "max_abs_return <= 0.35", "flat_share": "flat_share <= 0.0052", "resolution": "resolution >= 0.7489",
}


def sample_rules(**other: str) -> list[tuple[str, Column]]:
    """The rules of a sample, some of them replaced by name."""
    return [(k, F.expr(v)) for k, v in (SAMPLE_RULES | other).items()]


def cascade(profiles: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """step, rule, dropped, remaining: each row falls to the first rule that it fails."""
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(i)) for i, (_, ok) in enumerate(rules)], F.lit(len(rules)))
    counts = profiles.groupBy(failed.alias("step")).agg(F.count(F.lit(1)).alias("dropped"))
    names = profiles.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate(rules)], "step int, rule string")
    x = names.join(counts, "step", "left").fillna(0, ["dropped"])
    total = profiles.agg(F.count(F.lit(1)).alias("total"))
    return x.crossJoin(F.broadcast(total)).withColumn("remaining", F.col("total") - F.sum("dropped").over(Window.orderBy("step"))).drop("total")  # one row, and one row for each rule


def correlations(bars: DataFrame, least: int) -> DataFrame:
    """a, b, corr, n over common times; pairs meet at equal times only, one row of each series there."""
    r = bars.withColumn("r", F.ln(F.col("close") / back("close", 1))).where("r IS NOT NULL").select("ticker", "ts", "r")
    a, b = r.select("ts", F.col("ticker").alias("a"), F.col("r").alias("ra")), r.select("ts", F.col("ticker").alias("b"), F.col("r").alias("rb"))
    x = a.join(b, "ts").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("corr"), F.min("ra").alias("la"), F.max("ra").alias("ha"), F.min("rb").alias("lb"), F.max("rb").alias("hb"))
    return x.where((F.col("n") > least) & (F.col("la") < F.col("ha")) & (F.col("lb") < F.col("hb"))).select("a", "b", "n", "corr")


def uncorrelated(ranking: DataFrame, pairs: DataFrame, limit: int = 20, most: float = 0.95) -> DataFrame:
    """ticker, place, duplicate_of, picked: a short ranking (ticker, place) walked from its top; a ticker is taken unless it is too close to one already taken, then it names the first such. After `limit` are taken the others are left."""
    near = pairs.where(F.col("corr") > most)
    either = near.select(F.col("a").alias("ticker"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("ticker"), F.col("a").alias("other")))
    x = ranking.select(F.lit(0).alias("chain"), "place", "ticker").join(either.groupBy("ticker").agg(F.collect_set("other").alias("near")), "ticker", "left")

    def step(state: Column, row: Column) -> Column:
        clash = F.get(F.filter(state["taken"], lambda t: F.array_contains(F.coalesce(row["near"], F.array().cast("array<string>")), t)), F.lit(0))
        takes = clash.isNull() & (F.size(state["taken"]) < limit)
        open_ = F.size(state["taken"]) < limit
        return F.struct(F.when(takes, F.array_append(state["taken"], row["ticker"])).otherwise(state["taken"]).alias("taken"), F.when(open_, clash).alias("clash"), takes.alias("picked"))

    start = F.array().cast("array<string>")
    y = running(x, ["chain"], ["place"], {"taken": None, "clash": None, "picked": None}, "`taken`: array<string>, `clash`: string, `picked`: boolean", lambda s, r: step(F.struct(F.coalesce(s["taken"], start).alias("taken")), r))
    return y.select("ticker", "place", F.col("state.clash").alias("duplicate_of"), F.col("state.picked").alias("picked"))


def digest(names: Column) -> Column:
    return F.sha2(F.array_join(names, "\n"), 256)
