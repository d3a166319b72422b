"""Choosing features by overlapping splits of time: cross-fitted discovery and confirmation, and nested outer evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.operators import reports
from tidebar.operators.engine import operating_point
from tidebar.operators.search import acceptance, one_se


def split_grid(scored: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """splits with `growth` and `trades`: the log growth and number of a configuration's trades that a split's cut lets through.

    scored: keys (what was scored: ticker, configuration), t0, p, net (the return of a trade that leaves the position flat before the
    next). splits: keys, further columns, lo, hi (lo <= t0 < hi), theta, cut (p >= cut). Splits overlap at will: a trade is
    counted in one cell only, between two neighbouring borders of time and two neighbouring cuts of its configuration, and a split adds up its cells. A
    split without trades has growth 0. The number of cells is bounded by the splits. Trades without t0, p or net count nowhere.
    """
    some = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    borders = splits.groupBy(*keys).agg(some(F.array("lo", "hi")).alias("_edges"), some(F.array("cut")).alias("_cuts"))
    upto = lambda c, v: F.size(F.filter(c, lambda e: e <= F.col(v)))
    rows = scored.where("t0 IS NOT NULL AND p IS NOT NULL AND net IS NOT NULL").join(borders, keys)
    cells = rows.groupBy(*keys, upto("_edges", "t0").alias("_part"), upto("_cuts", "p").alias("_level")).agg(F.sum(F.log1p("net")).alias("_growth"), F.count(F.lit(1)).alias("_trades"))
    x = splits.join(borders, keys).withColumns({"_lo": F.array_position("_edges", F.col("lo")), "_hi": F.array_position("_edges", F.col("hi")), "_from": F.array_position("_cuts", F.col("cut"))}).drop("_edges", "_cuts")
    own = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    y = x.alias("s").join(cells.alias("c"), [*own, F.col("_part") >= F.col("_lo"), F.col("_part") < F.col("_hi"), F.col("_level") >= F.col("_from")], "left")
    return y.groupBy(*[F.col(f"s.{c}") for c in splits.columns]).agg(F.coalesce(F.sum("_growth"), F.lit(0.0)).alias("growth"), F.coalesce(F.sum("_trades"), F.lit(0)).cast("int").alias("trades"))


#: The arms of an outer fold.
ARMS = ("core", "best_single", "greedy")


def _held(folds: str) -> tuple[Column, Column]:
    return F.transform(folds, lambda f: f["growth"]).alias("fold_growth"), F.transform(folds, lambda f: f["trades"]).alias("fold_trades")


def rotations(grid: DataFrame, least_trades: int = 0) -> DataFrame:
    """ticker, outer_fold, rotation, arm, picked, family, discovery_gain, confirm_delta, confirm_trades: each fold in turn confirms what the others discover.

    grid: ticker, outer_fold, candidate (null: the core), family, formula, fold, theta, growth, trades, one row for each fold and point. In a rotation
    every candidate's point is chosen on the folds but one, its gain is its mean growth there less the core's, and the one fold measures it at that point. The
    flat arm picks the strongest candidate; the hierarchical one the strongest family and of it the simplest candidate within one standard
    error. Of equals the smallest id wins. Rotations in which the core has no discovery or no confirmation are left out;
    a candidate without a model in the confirming fold has a null delta. The table is folded by candidate and point before it is rotated.
    """
    keys = ["ticker", "outer_fold"]
    g = grid.withColumn("id", F.coalesce("candidate", F.lit(-1)))
    folds = F.array_sort(F.collect_list(F.struct("fold", "growth", "trades")))
    per = g.groupBy(*keys, "id", "theta").agg(F.first("family").alias("family"), F.first("formula").alias("formula"), folds.alias("folds"))
    turns = g.where("id = -1").groupBy(*keys).agg(F.collect_set("fold").alias("turns"))
    x = per.join(turns, keys).withColumn("rotation", F.explode("turns")).withColumn("rest", F.filter("folds", lambda f: f["fold"] != F.col("rotation"))).where(F.size("rest") > 0)
    x = x.select(*keys, "rotation", "id", "theta", "family", "formula", "rest", F.get(F.filter("folds", lambda f: f["fold"] == F.col("rotation")), F.lit(0)).alias("confirm"))
    by = [*keys, "rotation", "id"]
    point = operating_point(x.select(*by, "theta", F.lit(None).cast("double").alias("lambda"), F.lit("both").alias("direction"), *_held("rest")), by, least_trades).select(*by, "theta")
    x = x.join(point, [*by, "theta"])
    base = x.where("id = -1 AND confirm IS NOT NULL").select(*keys, "rotation", F.col("rest").alias("base"), F.col("confirm.growth").alias("base_confirm"))
    mean = lambda c: F.aggregate(F.transform(c, lambda f: f["growth"]), F.lit(0.0), lambda s, v: s + v) / F.size(c)
    own = lambda f: F.get(F.filter("rest", lambda r: r["fold"] == f["fold"]), F.lit(0))["growth"] - f["growth"]
    s = x.where("id >= 0").join(base, [*keys, "rotation"]).select(
        *keys, "rotation", "id", "family", "formula", (mean("rest") - mean("base")).alias("gain"), F.transform("base", own).alias("deltas"),
        (F.col("confirm.growth") - F.col("base_confirm")).alias("delta"), F.col("confirm.trades").alias("confirm_trades"),
    )
    turn = [*keys, "rotation"]
    measured = [F.round("gain", 8).alias("discovery_gain"), F.round("delta", 8).alias("confirm_delta"), "confirm_trades"]
    strongest = s.groupBy(*turn).agg(F.min(F.struct((-F.col("gain")).alias("g"), "id"))["id"].alias("id"))
    flat = s.join(strongest, [*turn, "id"]).select(*turn, F.lit("flat").alias("arm"), F.col("id").alias("picked"), "family", *measured)
    families = s.groupBy(*turn, "family").agg(F.max("gain").alias("g"), F.min("id").alias("first")).groupBy(*turn).agg(F.min(F.struct((-F.col("g")).alias("g"), "first", "family"))["family"].alias("family"))
    inside = s.join(families, [*turn, "family"])
    simple = one_se(inside.select(F.struct(*turn).alias("family"), "id", F.col("gain").alias("mean"), F.col("deltas").alias("folds"), "formula")).where("representative").select("family.*", "id")
    hierarchical = inside.join(simple, [*turn, "id"]).select(*turn, F.lit("hierarchical").alias("arm"), F.col("id").alias("picked"), "family", *measured)
    return flat.unionByName(hierarchical)


def verdict_replay(stored: DataFrame, rotated: DataFrame, **rule: float) -> DataFrame:
    """ticker, outer_fold, arm, unit, accepted_before, accepted_after, changed: the acceptance rule applied again to stored rotations, none of which is measured anew. stored: ticker, outer_fold, arm, accepted (null: nothing was)."""
    keys = ["ticker", "outer_fold", "arm"]
    now = acceptance(rotated, **rule).select(*keys, "unit", F.col("accepted").isNotNull().alias("_after"))
    x = stored.select(*keys, F.col("accepted").isNotNull().alias("_before")).join(now, keys, "full")
    before, after = (F.coalesce(c, F.lit(False)) for c in ("_before", "_after"))
    return x.select(*keys, "unit", before.alias("accepted_before"), after.alias("accepted_after"), (before != after).alias("changed"))


def outer_evaluation(grid: DataFrame, arms: DataFrame, least_trades: int = 0) -> DataFrame:
    """ticker, outer_fold and, for the arms core, best_single and greedy, the inner point, inner and outer growth and outer trades; then delta, optimism_gap, informative, delta_features_only.

    grid: ticker, config, outer_fold, fold (null: the outer window), theta, growth, trades, scored once for every configuration that
    any arm uses, however many use it. arms: ticker, outer_fold, arm, config, inner_gain. An arm's point is chosen on its fold's inner part only and then
    read off the outer window. delta is the greedy arm's outer growth less the core's, each at its own point; delta_features_only holds the greedy arm at
    the core's point. A fold in which neither arm traded says nothing. An arm without an inner point or an outer score has nulls.
    """
    by = ["ticker", "outer_fold", "config"]
    folds = F.array_sort(F.collect_list(F.struct("fold", "growth", "trades")))
    inner = grid.where("fold IS NOT NULL").groupBy(*by, "theta").agg(folds.alias("folds")).select(*by, "theta", F.lit(None).cast("double").alias("lambda"), F.lit("both").alias("direction"), *_held("folds"))
    point = operating_point(inner, by, least_trades).select(*by, F.col("theta").alias("q"), "log_growth")
    outer = grid.where("fold IS NULL").select(*by, "theta", "growth", "trades")
    own = arms.join(point, by, "left").join(outer.withColumnRenamed("theta", "q"), [*by, "q"], "left")
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    names = {"q": "q", "log_growth": "inner", "growth": "growth", "trades": "trades"}
    wide = own.groupBy("ticker", "outer_fold").agg(*[of(a, c).alias(f"{a}_{n}") for a in ARMS for c, n in names.items()], of("greedy", "inner_gain").alias("inner_gain"))
    swapped = arms.where("arm = 'greedy'").join(own.where("arm = 'core'").select("ticker", "outer_fold", F.col("q").alias("core_q")), ["ticker", "outer_fold"])
    swapped = swapped.join(outer.withColumnRenamed("theta", "core_q"), [*by, "core_q"]).select("ticker", "outer_fold", F.col("growth").alias("at_core"))
    x = reports.optimism(wide).join(swapped, ["ticker", "outer_fold"], "left")
    return x.withColumn("delta_features_only", F.round(F.col("at_core") - F.col("core_growth"), 8)).drop("at_core", "inner_gain")
