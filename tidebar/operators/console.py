"""Summaries over a store of sealed results: asset_results (ticker, model, return_pct, hodl_return_pct, profit_factor, trades, model_trades, wins, losses, trade_floor_met, beats_hodl)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY_USD = 1000.0


def overview(results: DataFrame) -> DataFrame:
    ranked = (F.col("model_trades") >= 2) & F.col("profit_factor").isNotNull()
    return results.groupBy("model").agg(
        F.count(F.lit(1)).alias("assets"), F.median("return_pct").alias("median_return"), F.median("hodl_return_pct").alias("median_hodl"),
        F.median(F.when(ranked, F.col("profit_factor"))).alias("median_pf"), F.sum(ranked.cast("int")).alias("pf_assets"), F.sum("beats_hodl").alias("beats"),
        F.avg("beats_hodl").alias("beats_share"), F.sum("trades").alias("trades"),
    )


def payoff(results: DataFrame) -> DataFrame:
    """Median realised payoff ratio, profit factor x losses / wins, and the share of at least 2."""
    x = results.where("profit_factor IS NOT NULL AND wins > 0 AND losses > 0").withColumn("payoff", F.col("profit_factor") * F.col("losses") / F.col("wins"))
    return x.groupBy("model").agg(F.median("payoff").alias("median_payoff"), F.count(F.lit(1)).alias("n"), F.avg((F.col("payoff") >= 2).cast("double")).alias("share_2"))


def basket(results: DataFrame, picked: DataFrame, model: str) -> DataFrame:
    """Money of an equal-weight basket: as executed, by models only, and held."""
    x = results.where(F.col("model") == model).join(picked, "ticker", "left_semi")
    ml = (F.col("model_trades") > 0) & (F.col("trade_floor_met") == 1)
    end = lambda c: ENTRY_USD * (1 + F.col(c) / 100)
    return x.agg(
        F.count(F.lit(1)).alias("assets"), F.sum(end("return_pct")).alias("executed_usd"), F.sum(ml.cast("int")).alias("ml_assets"), F.sum(F.when(ml, end("return_pct"))).alias("ml_usd"),
        F.sum(F.when(F.col("hodl_return_pct").isNotNull(), end("hodl_return_pct"))).alias("hodl_usd"), F.sum(F.when(ml & (F.col("return_pct") > 0), 1).otherwise(0)).alias("ml_winners"),
    )


def overlap(results: DataFrame, left: str, right: str) -> DataFrame:
    """Assets that both models traded: who won, and how often they agree."""
    side = lambda m, p: results.where((F.col("model") == m) & (F.col("model_trades") > 0) & (F.col("trade_floor_met") == 1)).select("ticker", (F.col("return_pct") > 0).alias(p))
    both = side(left, "l").join(side(right, "r"), "ticker")
    n = lambda c: F.sum(c.cast("int"))
    counts = both.agg(F.count(F.lit(1)).alias("both"), n(F.col("l") & F.col("r")).alias("both_win"), n(F.col("l") & ~F.col("r")).alias("left_only"), n(~F.col("l") & F.col("r")).alias("right_only"), n(~F.col("l") & ~F.col("r")).alias("neither"))
    return counts.withColumn("agree_pct", F.bround(100.0 * (F.col("both_win") + F.col("neither")) / F.nullif("both", F.lit(0)), 1)).withColumn("note", win_note(100.0 * F.col("both_win") / F.nullif("both", F.lit(0))))


def win_note(share: Column) -> Column:
    return F.when(share.isNull(), "no common assets").when(share > 50, "above the 50 % line").when(share < 50, "below the 50 % line").otherwise("on the 50 % line")


def trade_buckets(results: DataFrame) -> DataFrame:
    t = F.col("model_trades")
    name = F.when(t == 0, "0").when(t == 1, "1").when(t <= 10, "2-10").when(t <= 50, "11-50").when(t <= 200, "51-200").otherwise("200+")
    return results.groupBy("model", name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram(results: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of a clipped column in equal bins; the last one is closed."""
    x = F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high))
    return results.where(F.col(column).isNotNull()).groupBy("model", F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def health(counts: DataFrame) -> DataFrame:
    """First matching state of each store. counts: found, missing_tables, failed_checks, frozen, assets, expected."""
    state = (
        F.when(~F.col("found"), "NOT FOUND").when(F.col("missing_tables") > 0, "SCHEMA MISMATCH").when(F.col("failed_checks") > 0, "INTEGRITY FAILED")
        .when(~F.coalesce("frozen", F.lit(False)) | ~F.col("assets").eqNullSafe(F.col("expected")), "PARTIAL").otherwise("OK")
    )
    return counts.withColumn("state", state)


def contributions(rows: DataFrame) -> DataFrame:
    """Share of each feature in its asset's gain, largest first, with its rank and its family's share."""
    by = Window.partitionBy("ticker")
    total = F.sum("gain").over(by)
    share = F.when(total > 0, F.col("gain") / total).otherwise(0.0)
    x = rows.withColumn("share", share)
    return x.withColumns({"family_share": F.sum("share").over(Window.partitionBy("ticker", "family")), "rank": F.row_number().over(by.orderBy(F.desc("share"), "feature"))})


def tooltips(features: DataFrame) -> DataFrame:
    return features.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "name"))), lambda s: F.concat_ws(":", s["feature_id"].cast("string"), s["name"])), ",").alias("members"), F.count(F.lit(1)).alias("n"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a stated order, null last; other columns break ties."""
    rest = [F.col(c).asc_nulls_last() for c in [*order, *[c for c in rows.columns if c not in keys and c not in order]]]
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))).where("_place = 1").drop("_place")


def integrity(checks: DataFrame) -> DataFrame:
    """check_name, status, place, passed, total: the checks in order of their names, each with how many of all passed. One row for each check."""
    all_ = Window.partitionBy()
    return checks.select("check_name", "status", F.row_number().over(Window.orderBy("check_name")).alias("place"), F.sum((F.col("status") == "PASS").cast("int")).over(all_).alias("passed"), F.count(F.lit(1)).over(all_).alias("total"))


def drawn_basket(tickers: DataFrame, seed: int, least: int = 5, most: int = 15) -> DataFrame:
    """A basket of least to most tickers drawn by a hash of the seed, which also draws their number; all of them if there are fewer."""
    n = least + int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16) % (most - least + 1)
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), "ticker"))
    return tickers.select("ticker").distinct().orderBy(key, "ticker").limit(n)


def ledger_head(ledger: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """The first trades of each key's ledger, as a report prints them, and how many more there are."""
    by = Window.partitionBy(*keys)
    x = ledger.withColumns({"place": F.row_number().over(by.orderBy("trade_id")), "n": F.count(F.lit(1)).over(by)})
    return x.where(F.col("place") <= most).withColumn("more", F.greatest(F.lit(0), F.col("n") - most)).drop("n")
