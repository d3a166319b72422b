"""Controls, costs, comparisons and registers over the records of finished searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.search import wilson


def at_place(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys, n and, for each name, the value at a place of the sorted values, from 0; places are expressions of n.

    Equal values are counted before they are ordered, so a key's pass holds its different values only.
    """
    by = Window.partitionBy(*keys)
    x = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    x = x.withColumns({"_upto": F.sum("_k").over(by.orderBy(value)), "n": F.sum("_k").over(by)})
    held = lambda p: (p >= F.col("_upto") - F.col("_k")) & (p < F.col("_upto"))
    return x.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(held(p), F.col(value))).alias(name) for name, p in places.items()])


def negative_control(null: DataFrame, keys: list[str], alpha: float = 0.10) -> DataFrame:
    """How often the acceptance contract accepted something where nothing was there. null: keys, t."""
    n = F.col("n")
    spread = at_place(null, keys, "t", {"median_t": F.floor(n / 2), "q90_t": F.floor(F.lit(0.9) * (n - 1))})
    x = null.groupBy(*keys).agg(F.sum((F.col("t") > 0).cast("int")).alias("false_acceptances")).join(spread, keys)
    low, high = wilson(F.col("false_acceptances"), n)
    return x.select(*keys, n.alias("replicates"), "false_acceptances", (F.col("false_acceptances") / n).alias("rate"), low.alias("low"), high.alias("high"), "median_t", "q90_t", (low > alpha).alias("exceeds_alpha"))


def power_table(runs: DataFrame, least: float = 0.8) -> DataFrame:
    """Per strength and pool: recovered, of, power, its interval, core seconds; and whether the strength is found in every pool. runs: strength, pool, recovered, seconds."""
    x = runs.groupBy("strength", "pool").agg(F.sum(F.col("recovered").cast("int")).alias("recovered"), F.count(F.lit(1)).alias("of"), F.sum("seconds").alias("core_seconds"))
    low, high = wilson(F.col("recovered"), F.col("of"))
    x = x.withColumns({"power": F.round(F.col("recovered") / F.col("of"), 3), "low": low, "high": high})
    return x.withColumn("detectable", F.min("power").over(Window.partitionBy("strength")) >= least)


def unit_costs(seconds: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds of one unit of work: n, median, mean, p10, p90, min, max. seconds: keys, seconds."""
    n = F.col("n")
    spread = at_place(seconds, keys, "seconds", {"p10": F.floor(F.lit(0.1) * (n - 1)), "p90": F.floor(F.lit(0.9) * (n - 1))})
    x = seconds.groupBy(*keys).agg(F.median("seconds").alias("median"), F.avg("seconds").alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    return x.join(spread, keys)


def null_costs(stages: DataFrame) -> DataFrame:
    """Runs, core seconds and core hours of each kind of null. stages: kind, core_seconds."""
    x = stages.where("core_seconds > 0").groupBy("kind").agg(F.count(F.lit(1)).alias("runs"), F.sum("core_seconds").alias("s"))
    return x.select("kind", "runs", F.round("s", 1).alias("total_core_seconds"), F.round(F.col("s") / 3600, 2).alias("core_hours"))


def rotation_against_procedure(procedure: DataFrame, real: DataFrame, draws: DataFrame, stop_at: int = 5) -> DataFrame:
    """What the null of single rotations would have said in place of the procedure's.

    procedure: ticker, outer_fold, arm, unit, verdict. real: ticker, outer_fold, arm, unit, delta of each real rotation.
    draws: ticker, outer_fold, arm, permutation, delta of each rotation under a permutation; a permutation
    counts with its largest. Folds without comparable rotations on either side are left out.
    """
    keys = ["ticker", "outer_fold", "arm"]
    best = real.where("delta IS NOT NULL").groupBy(*keys, "unit").agg(F.max("delta").alias("real_max_delta"))
    null = draws.where("delta IS NOT NULL").groupBy(*keys, "permutation").agg(F.max("delta").alias("d"))
    x = null.join(procedure.join(best, [*keys, "unit"]), keys).groupBy(*keys, "unit", "verdict", "real_max_delta").agg(F.sum((F.col("d") >= F.col("real_max_delta")).cast("int")).alias("exceedances"), F.count(F.lit(1)).alias("permutations"))
    passed = F.col("exceedances") < stop_at
    return x.withColumns({"rotation_verdict": F.when(passed, "passed").otherwise("rejected_early"), "conclusion_changes": (F.col("verdict") == "passed") != passed})


def optimism(folds: DataFrame) -> DataFrame:
    """delta of the greedy arm over the core's, the gap to what the inner search promised, and whether either arm traded at all. folds: core_growth, greedy_growth, core_trades, greedy_trades, inner_gain."""
    delta = F.round(F.col("greedy_growth") - F.col("core_growth"), 8)
    informative = F.coalesce(delta.isNotNull() & ((F.col("core_trades") > 0) | (F.col("greedy_trades") > 0)), F.lit(False))
    return folds.withColumns({"delta": delta, "optimism_gap": F.round(F.col("inner_gain") - delta, 8), "informative": informative})


def viable(trials: DataFrame, least: int = 20) -> DataFrame:
    """Per table the upper median of the trials' split nodes, and whether it clears the floor. trials: table, split_nodes."""
    return at_place(trials, ["table"], "split_nodes", {"median_splits": F.floor(F.col("n") / 2)}).withColumn("viable", F.col("median_splits") >= least)


def viability_register(folds: DataFrame) -> DataFrame:
    """One row for each trial from its folds: trial, splits, leaves, std, lo, hi, ap, growth, trades."""
    return folds.groupBy("trial").agg(
        F.sum("splits").alias("split_nodes"), F.sum("leaves").alias("leaves"), F.round(F.avg("std"), 6).alias("pred_std"), F.round(F.min("lo"), 6).alias("pred_min"), F.round(F.max("hi"), 6).alias("pred_max"),
        F.round(F.avg("ap"), 6).alias("auc_pr"), F.round(F.sum("growth"), 6).alias("oof_log_growth"), F.sum("trades").alias("trades"), F.count(F.lit(1)).alias("folds_used"),
    )


def fold_win_share(base: str, own: str) -> Column:
    """Share of the folds that both have in which own is better; 0 without any."""
    both = F.filter(F.arrays_zip(F.col(base).alias("b"), F.col(own).alias("c")), lambda z: z["b"].isNotNull() & z["c"].isNotNull())
    return F.when(F.size(both) > 0, F.size(F.filter(both, lambda z: z["c"] > z["b"])) / F.nullif(F.size(both), F.lit(0))).otherwise(0.0)


def hessian_total(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The scale of the first split: total weight times p (1 - p) at the base rate. rows: keys, y, weight."""
    p = F.avg("y")
    return rows.groupBy(*keys).agg((F.sum("weight") * p * (1 - p)).alias("hessian"))


def train_cv(folds: DataFrame, ledger: DataFrame, capital: float = 1000.0) -> DataFrame:
    """Per ticker: log growth over folds, mean return, profit factor (null if nothing was lost but something won) and trades. folds: ticker, fold, end_capital, return_pct. ledger: ticker, net."""
    net = F.col("net")
    won, lost = F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)), F.coalesce(F.sum(F.when(net < 0, -net)), F.lit(0.0))
    trades = ledger.groupBy("ticker").agg(won.alias("won"), lost.alias("lost"), F.count(F.lit(1)).alias("trades"))
    growth = folds.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_folds"), F.sum(F.ln(F.greatest("end_capital", F.lit(1e-9)) / capital)).alias("log_growth"), F.avg("return_pct").alias("return_pct"))
    pf = F.when(F.col("lost") > 0, F.col("won") / F.nullif("lost", F.lit(0.0))).when(F.col("won") > 0, None).otherwise(0.0)
    x = growth.join(trades, "ticker", "left")
    return x.select("ticker", "n_folds", F.round("log_growth", 6).alias("train_cv_oof_log_growth"), F.round(pf, 4).alias("train_cv_pf"), F.round("return_pct", 4).alias("train_cv_return_pct"), F.coalesce("trades", F.lit(0)).alias("train_cv_trades"))


def accepted_strategy(trades: Column, profit_factor: Column, least: int | None) -> Column:
    """The modes' names. Without a least number of trades every strategy passes as a check of correctness."""
    rankable = profit_factor.isNotNull() & ~F.isnan(profit_factor) & (F.abs(profit_factor) != float("inf"))
    if least is None:
        return F.lit("correctness_check")
    return F.when((trades < least) | ~rankable, "rejected").otherwise("accepted")


def outer_folds(events: DataFrame, k: int, horizon: int, embargo: int, least_val: int = 5, least_train: int = 10) -> DataFrame:
    """ticker, fold, n_train, n_val, val_lo, val_hi, inner_end: outer walk-forward folds, and the bar where the inner ones must stop."""
    ends = events.groupBy("ticker").agg(F.min("t0").alias("ts"), F.max("t0").alias("te"))
    edge = lambda i: (F.col("ts") + (F.col("te") + 1 - F.col("ts")) * i / (k + 1)).cast("int")
    cuts = ends.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).select("ticker", "fold", edge(F.col("fold")).alias("val_lo"), edge(F.col("fold") + 1).alias("val_hi"))
    t0 = F.col("t0")
    train, val = t0 + horizon < F.col("val_lo") - embargo, (t0 >= F.col("val_lo")) & (t0 < F.col("val_hi"))
    x = events.select("ticker", "t0").join(cuts, "ticker").groupBy("ticker", "fold", "val_lo", "val_hi").agg(F.sum(train.cast("int")).alias("n_train"), F.sum(val.cast("int")).alias("n_val"))
    return x.where((F.col("n_val") >= least_val) & (F.col("n_train") >= least_train)).withColumn("inner_end", F.col("val_lo") - embargo - horizon - 1)


def segment_of(ts: Column, bounds: list[tuple[str, str, str]]) -> Column:
    """The first segment (name, first day, last day) that holds the time; a segment ends with the first instant after its last day, which it includes."""
    out = F.lit("none")
    for name, first, last in reversed(bounds):
        inside = (ts >= F.lit(first).cast("timestamp")) & (ts <= F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
        out = F.when(inside, name).otherwise(out)
    return out


def discovery_picks(scores: DataFrame) -> DataFrame:
    """Per ticker, fold and rotation: the flat arm's pick and the hierarchical arm's family. scores: ticker, outer_fold, rotation, id, family, gain.

    The strongest feature, and the family of the strongest member; the smallest id wins ties.
    """
    keys = ["ticker", "outer_fold", "rotation"]
    top = F.min(F.struct((-F.col("gain")).alias("g"), "id", "family"))
    return scores.where("gain IS NOT NULL").groupBy(*keys).agg(top.alias("top")).select(*keys, F.col("top.id").alias("picked"), F.col("top.family").alias("family"), (-F.col("top.g")).alias("discovery_gain"))


def path_problems(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """model, ticker, problem: sealed rows whose path is not their folder's, or whose folder the manifest omits."""
    x = results.join(manifest.select("model", "ticker", F.lit(True).alias("listed")), ["model", "ticker"], "left")
    odd = ~F.col("artifact_path").eqNullSafe(F.concat_ws("/", F.lit("artifacts"), "model", "ticker"))
    problem = F.when(odd, "artifact_path").when(F.col("listed").isNull(), "not in the manifest")
    return x.select("model", "ticker", problem.alias("problem")).where("problem IS NOT NULL")


def slimmed(table: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of the tickers to keep."""
    return table.join(keep.select("ticker").distinct(), "ticker", "left_semi")


def to_resume(ledger: DataFrame, planned: DataFrame, stage: str) -> DataFrame:
    """unit, state of each planned unit of a stage: completed at any time, else orphan if it was last seen running, else open. ledger: seq, stage, unit, status."""
    x = ledger.where(F.col("stage") == stage).groupBy("unit").agg(F.max((F.col("status") == "completed").cast("int")).alias("done"), F.max_by("status", "seq").alias("last"))
    state = F.when(F.col("done") == 1, "completed").when(F.col("last") == "running", "orphan").otherwise("open")
    return planned.select("unit").distinct().join(x, "unit", "left").select("unit", F.when(F.col("last").isNull(), "open").otherwise(state).alias("state"))


def unmapped(pool: DataFrame, families: DataFrame) -> DataFrame:
    """id, problem: candidates without a family, mapped ids that are no candidates, ids mapped more than once. None if the map is in step with the pool."""
    f = families.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    x = pool.select("id").distinct().withColumn("c", F.lit(True)).join(f, "id", "full")
    problem = F.when(F.col("k").isNull(), "unmapped").when(F.col("c").isNull(), "stale").when(F.col("k") > 1, "mapped twice")
    return x.select("id", problem.alias("problem")).where("problem IS NOT NULL")


def selection_overlap(picks: DataFrame) -> DataFrame:
    """a, b, jaccard of the sets of features that two folds of a ticker picked. picks: ticker, fold, id."""
    sets = picks.groupBy("ticker", "fold").agg(F.collect_set("id").alias("ids"))  # a fold's few picks
    a, b = sets.select("ticker", F.col("fold").alias("a"), F.col("ids").alias("x")), sets.select("ticker", F.col("fold").alias("b"), F.col("ids").alias("y"))
    return a.join(b, "ticker").where("a < b").select("ticker", "a", "b", (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"))


#: What the console calls the modes of a result.
STATUS_LABELS = {
    "ML_MULTI_TRADE": "ACTIVE", "ML_ONE_TRADE_LOW_EVIDENCE": "LOW EVIDENCE", "HODL_FALLBACK_NO_MODEL_TRADES": "IDLE / HODL", "TRAIN_OOF_FLOOR_NOT_MET": "NO-TRADE (floor)",
    "NO_VALID_FOLDS": "NO VALID FOLDS", "TRAINING_FAILED": "FAILED",
}


def status_label(mode: Column) -> Column:
    return F.coalesce(*[F.when(mode == k, v) for k, v in STATUS_LABELS.items()], mode)


def shared_wins(xgb: Column, lstm: Column, both_win: Column, both_lose: Column, own_xgb: Column, own_lstm: Column) -> dict[str, Column]:
    """Whole percentages of a Venn picture, held within what the others allow.

    xgb, lstm: each model's share of won trades. both_win, both_lose: the drawn blocks common to both, the smaller of their shares. own_xgb, own_lstm: each
    model's own share of wins on tickers that both won; what it wins beyond that is its edge, so that models that agree have none.
    """
    held = lambda c: F.greatest(F.lit(0), F.least(c.cast("int"), F.lit(100)))
    x, y = held(xgb), held(lstm)
    both, none = F.greatest(F.lit(0), F.least(both_win.cast("int"), x, y)), F.greatest(F.lit(0), F.least(both_lose.cast("int"), 100 - x, 100 - y))
    edge = lambda c, own: F.greatest(F.lit(0), c - F.bround(own, 0).cast("int"))
    ex, ey = edge(x, own_xgb), edge(y, own_lstm)
    drawn = F.when(both + none > 0, F.bround(100 * both / F.nullif(both + none, F.lit(0)), 0).cast("int"))
    return {"xgb": x, "lstm": y, "both": both, "neither": none, "edge_xgb": ex, "edge_lstm": ey, "edge": ex + ey, "intersection_win_rate": drawn}


def joint_point(grid: DataFrame, keys: list[str], least_trades: int) -> DataFrame:
    """Per key the grid point of most growth among those with enough trades; of equal ones smaller lambda, higher theta, both directions.

    grid: keys, direction, theta, lambda (null: none), growth, trades. Without enough trades anywhere the point with most trades is taken and flagged.
    """
    by = Window.partitionBy(*keys)
    x = grid.withColumn("enough", F.col("trades") >= least_trades).withColumn("floor_met", F.max("enough").over(by))
    most = F.row_number().over(by.orderBy(F.desc("trades"), F.desc("growth"), F.desc("theta"), "lambda", "direction")) == 1
    x = x.withColumn("most", most).where(F.when(F.col("floor_met"), F.col("enough")).otherwise(F.col("most")))
    x = x.withColumn("best", F.max("growth").over(by)).where(F.col("growth") >= F.col("best") - 1e-9)
    order = by.orderBy(F.coalesce("lambda", F.lit(0.0)), F.desc("theta"), (F.col("direction") != "both").cast("int"), "direction")
    x = x.withColumn("place", F.row_number().over(order)).where("place = 1")
    return x.select(*keys, "theta", "lambda", "direction", F.col("best").alias("oof_log_growth"), F.col("trades").alias("oof_trades"), F.col("floor_met").alias("trade_floor_met"))


def stability(a2: Column, b: Column) -> Column:
    """The class of a survivor by its sensitivity nulls, true if passed, null if not run."""
    yes, also = F.coalesce(a2, F.lit(False)), F.coalesce(b, F.lit(False))
    return F.when(a2.isNull() & b.isNull(), "primary_only").when(yes & also, "stable").when(also, "regime_sensitive").when(yes, "core_coupled").otherwise("weak")


def compiled(survivors: DataFrame, with_null: bool = True) -> DataFrame:
    """One resolved record for each ticker.

    Win rates are rounded to three places before they are averaged. survivors: ticker, unit, arm, win_rate, outer_delta, null (passed, failed, or null where not run), a2 and b (passed or not, null where not run).
    """
    passed, missing = F.coalesce(F.col("null") == "passed", F.lit(False)), F.col("null").isNull()
    x = survivors.withColumns({"ok": passed, "class": F.when(passed, stability(F.col("a2"), F.col("b")))})
    own = lambda c: F.when(F.col("ok"), F.col(c))
    x = x.groupBy("ticker").agg(
        F.sum(F.col("ok").cast("int")).alias("accepted"), F.sum((F.coalesce(F.col("class"), F.lit("")) == "stable").cast("int")).alias("stable"), F.sum((missing & ~F.col("ok")).cast("int")).alias("screening"),
        F.countDistinct(own("unit")).alias("n_selected"), F.min(own("arm")).alias("selection_mode"), F.round(F.sum(F.round(own("win_rate") * 1000).cast("long")) / F.count(own("win_rate")) / 1000, 3).alias("confirmation_win_rate"), F.round(F.max(own("outer_delta")), 6).alias("outer_delta"),
    )
    status = F.when(F.col("stable") > 0, "resolved").when(F.col("accepted") > 0, "resolved_conditional").when((F.col("screening") > 0) & F.lit(not with_null), "screening_only").otherwise("resolved_empty")
    return x.withColumn("status", status)


def ranking_objective(x: DataFrame, optimism: float, instability: float, complexity: float, cost: float) -> DataFrame:
    """J of each ticker: outer gain less weighted optimism, instability, complexity and cost. x: ticker, u_outer, optimism, win_rate, n_units, seconds."""
    j = F.col("u_outer") - optimism * F.coalesce("optimism", F.lit(0.0)) - instability * (1 - F.col("win_rate")) - complexity * F.col("n_units") - cost * F.col("seconds")
    return x.select("ticker", F.when(F.col("u_outer").isNotNull(), F.round(j, 6)).alias("j"))


def null_scope(verdicts: DataFrame, rotations: DataFrame) -> DataFrame:
    """The rotations that a null could still overturn: those whose pick supports an accepted unit. verdicts: ticker, outer_fold, arm, unit. rotations: ticker, outer_fold, confirmation_fold, arm, unit, delta."""
    return rotations.where("delta IS NOT NULL").join(verdicts, ["ticker", "outer_fold", "arm", "unit"]).groupBy("ticker", "outer_fold", "confirmation_fold").agg(F.count(F.lit(1)).alias("arms"), F.max("delta").alias("real_statistic"))


def planted(rows: DataFrame, keys: list[str], strength: float) -> DataFrame:
    """rows with `plant`: strength times the standardised outcome y and the rest noise, of unit variance if noise is."""
    by = Window.partitionBy(*keys)
    z = (F.col("y") - F.avg("y").over(by)) / (F.stddev_pop("y").over(by) + 1e-12)
    return rows.withColumn("plant", strength * z + max(0.0, 1 - strength**2) ** 0.5 * F.col("noise"))


def to_search(universe: DataFrame, searched: DataFrame, paused: DataFrame, pool: int) -> DataFrame:
    """Tickers never searched, or left at the core by a search of a smaller pool; paused ones wait. searched: ticker, applied, pool_size."""
    x = universe.select("ticker").join(searched, "ticker", "left").join(paused.select("ticker"), "ticker", "left_anti")
    return x.where(F.col("applied").isNull() | ((F.col("applied") == 0) & (F.coalesce("pool_size", F.lit(0)) < pool))).select("ticker")


def search_verdict(subset_size: Column, best: Column, base: Column, thin: Column, least_gain: float) -> Column:
    return F.when((subset_size > 0) & (best >= base + least_gain), "applied").when(thin, "thin_trades").otherwise("core_only")


def names_token(groups: list[Column]) -> Column:
    """Changes whenever a list of feature names does. groups: arrays of names."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.array_join(g, ",") for g in groups]), 256), 1, 16)


def ranked_tables(profile: DataFrame, limit: int) -> DataFrame:
    """The tables of finest price resolution, least flat first of equal ones: a report of `limit` rows."""
    order = [F.desc("resolution"), F.asc("flat_share"), F.asc("ticker")]
    top = profile.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
