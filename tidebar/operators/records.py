"""What a finished search says of each ticker: the survivors of cross-fit and nulls, their evidence, and a score that ranks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.operators.reports import stability

# How a test ended, in words.
FULL, EARLY, NOT_RUN = "fixed budget, 50 permutations", "futility stop: a lower bound, not a fixed-budget p-value", "screening only: procedure null not yet run here"
#: Weights of the ranking score.
WEIGHTS = {"optimism": 1.0, "instability": 0.5, "complexity": 0.004, "cost": 1e-5}


def p_of(verdict: Column, p_mc: Column, bound: Column) -> tuple[Column, Column]:
    """The p value of a null's verdict and its basis; a test that stopped early has a lower bound only."""
    p = F.when(verdict == "passed", p_mc).when(verdict == "rejected_early", bound)
    return p, F.when(verdict.isNull(), NOT_RUN).when(verdict == "passed", FULL).when(verdict == "rejected_early", EARLY).otherwise(verdict)


def survivors(accepted: DataFrame, nulls: DataFrame) -> DataFrame:
    """Each accepted unit with its win rate, gain, primary null, p, basis, standing (accepted, rejected_by_null, screening_only) and stability class.

    accepted: ticker, outer_fold, arm, unit, rotations, wins, median, as cross-fit accepted them. nulls: kind (a1: the primary one, a2, b), ticker, outer_fold, arm, verdict, p_mc, final_p_lower_bound.
    """
    keys = ["ticker", "outer_fold", "arm"]
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = nulls.groupBy(*keys).agg(of("a1", "verdict").alias("verdict"), of("a1", "p_mc").alias("p_mc"), of("a1", "final_p_lower_bound").alias("bound"), (of("a2", "verdict") == "passed").alias("a2"), (of("b", "verdict") == "passed").alias("b"))
    x = accepted.join(wide, keys, "left")
    p, basis = p_of(F.col("verdict"), F.col("p_mc"), F.col("bound"))
    standing = F.when(F.col("verdict").isNull(), "screening_only").when(F.col("verdict") == "passed", "accepted").otherwise("rejected_by_null")
    return x.select(
        *keys, "unit", (F.round(F.col("wins") * 1000 / F.col("rotations")).cast("long") / 1000).alias("confirmation_win_rate"), F.round("median", 6).alias("outer_delta"), "verdict", p.alias("p"), basis.alias("basis"),
        standing.alias("standing"), F.when(standing == "accepted", stability(F.col("a2"), F.col("b"))).alias("stability"),
    )


def optimism_of(held: DataFrame, rotated: DataFrame) -> DataFrame:
    """ticker, optimism: by how much discovery promised more than confirmation gave, on average over the rotations that picked a surviving unit. held: from survivors(...). rotated: ticker, outer_fold, arm, picked, family, discovery_gain, confirm_delta."""
    unit = F.when(F.col("arm") == "flat", F.concat(F.lit("feature:"), F.col("picked").cast("string"))).otherwise(F.concat(F.lit("family:"), F.col("family")))
    x = rotated.withColumn("unit", unit).join(held.where("standing = 'accepted'").select("ticker", "outer_fold", "arm", "unit"), ["ticker", "outer_fold", "arm", "unit"])
    return x.where("confirm_delta IS NOT NULL AND discovery_gain IS NOT NULL").groupBy("ticker").agg(F.avg(F.col("discovery_gain") - F.col("confirm_delta")).alias("optimism"))


def ticker_records(tickers: DataFrame, accepted: DataFrame, nulls: DataFrame, rotated: DataFrame, candidates: int, weights: dict[str, float] | None = None) -> DataFrame:
    """One record for each ticker: status, stop_reason, selection_mode, selected units, rejected features, win rate, gain, p values, evidence counts, J and its parts.

    tickers: ticker, seconds (null: no cross-fit record). A ticker is resolved if a survivor passed all three nulls, conditionally if one passed the primary null only; without any primary null at all, what cross-fit accepted is screening only.
    J ranks survivors and books cost; it decides nothing.
    """
    w = weights or WEIGHTS
    held = survivors(accepted, nulls)
    run = nulls.where("kind = 'a1'").limit(1).select(F.lit(True).alias("with_null"))
    ok = F.col("standing") == "accepted"
    own = lambda c: F.when(ok, F.col(c))
    n = lambda kind: F.count(F.when(F.col("standing") == kind, 1))
    x = held.groupBy("ticker").agg(
        n("accepted").alias("n_accepted"), n("rejected_by_null").alias("n_rejected_by_null"), n("screening_only").alias("n_screening_only"), F.count(F.when(F.col("stability") == "stable", 1)).alias("n_stable"), F.min(own("arm")).alias("selection_mode"),
        F.array_sort(F.collect_set(own("unit"))).alias("selected"), (F.sum(F.round(own("confirmation_win_rate") * 1000).cast("long")) / 1000 / n("accepted")).alias("win"), F.max(own("outer_delta")).alias("outer_delta"),
        F.array_sort(F.collect_list(F.when(ok, F.struct("unit", "arm", "outer_fold", "p", "basis")))).alias("max_null_p"),
    )
    x = tickers.join(x, "ticker", "left").join(optimism_of(held, rotated), "ticker", "left").join(F.broadcast(run), how="left", on=F.lit(True))  # one row at most
    any_ = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    absent, screened = F.col("seconds").isNull(), any_("n_screening_only") & F.col("with_null").isNull()
    status = F.when(absent, "absent").when(any_("n_stable"), "resolved").when(any_("n_accepted"), "resolved_conditional").when(screened, "screening_only").otherwise("resolved_empty")
    reason = (
        F.when(absent, "no cross-fit record").when(any_("n_stable"), "survived all three nulls").when(any_("n_accepted"), "passed the primary null, not every sensitivity null").when(screened, "procedure null not yet run")
        .when(any_("n_rejected_by_null") | any_("n_screening_only"), "no unit exceeded the procedure-level null").otherwise("cross-fit accepted nothing")
    )
    size = F.coalesce(F.size("selected"), F.lit(0))
    j = F.col("outer_delta") - w["optimism"] * F.coalesce("optimism", F.lit(0.0)) - w["instability"] * (1 - F.col("win")) - w["complexity"] * size - w["cost"] * F.col("seconds")
    return x.select(
        "ticker", status.alias("status"), reason.alias("stop_reason"), "selection_mode", F.coalesce("selected", F.array().cast("array<string>")).alias("selected"), F.greatest(size, F.lit(0)).alias("n_selected"), (candidates - F.greatest(size, F.lit(0))).alias("rejected_features"),
        F.round("win", 3).alias("confirmation_win_rate"), "outer_delta", "max_null_p", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_accepted", "n_rejected_by_null", "n_screening_only")],
        F.round(F.when(any_("n_accepted"), F.coalesce("optimism", F.lit(0.0))), 6).alias("optimism"), F.round(F.when(any_("n_accepted"), j), 6).alias("j"),
    )
