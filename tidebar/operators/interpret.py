"""What a model's splits and scores say about its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A cell with fewer rows says nothing about a feature's direction.
LEAST_CELL = 25


def split_points(trees: DataFrame) -> DataFrame:
    """feature, thresholds (distinct, sorted, finite), n_splits, gain, gain_share."""
    ok = trees.where((F.col("feature") != "Leaf") & F.col("split").isNotNull() & ~F.isnan("split") & (F.abs("split") < float("inf")))
    x = ok.groupBy("feature").agg(F.array_sort(F.collect_set("split")).alias("thresholds"), F.count(F.lit(1)).alias("n_splits"), F.sum("gain").alias("gain"))
    total = F.sum("gain").over(Window.partitionBy())  # one row for each feature
    return x.withColumn("gain_share", F.when(total > 0, F.col("gain") / F.when(total > 0, total)).otherwise(0.0))


def bin_of(value: Column, edges: Column) -> Column:
    """How many edges are at or below the value, both as 32-bit floats."""
    return F.size(F.filter(edges, lambda e: e.cast("float") <= value.cast("float")))


def bin_stats(rows: DataFrame, edges: list[float]) -> DataFrame:
    """bin, n, n_entry, rate, lift over the base rate. rows: value, entry (0 or 1)."""
    e = F.array(*[F.lit(float(x)) for x in edges])
    x = rows.where("value IS NOT NULL").groupBy(bin_of(F.col("value"), e).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("entry").alias("n_entry"))
    all_ = Window.partitionBy()  # one row for each bin
    base = F.sum("n_entry").over(all_) / F.sum("n").over(all_)
    return x.withColumn("rate", F.col("n_entry") / F.col("n")).withColumn("lift", F.when(base > 0, F.col("n_entry") / F.col("n") / F.when(base > 0, base)).otherwise(0.0))


def entry_segments(rows: DataFrame, edges: list[float], lift: float = 1.25, least_rows: int = 20, least_entries: int = 10) -> DataFrame:
    """Runs of bins of one class (hot or cold): lo_bin, hi_bin, class, n, n_entry, entry_share, entry_lift, whether
    the run is a candidate region, and whether its entries are little evidence.

    Empty bins extend the run before them, also at a change of class; leading ones belong to none.
    """
    every = rows.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("bin"))
    x = every.join(bin_stats(rows, edges), "bin", "left").withColumn("class", F.when(F.col("n").isNull(), None).when(F.col("lift") >= lift, "hot").otherwise("cold"))
    w = Window.orderBy("bin")  # one row for each bin
    x = x.withColumn("filled", F.last("class", ignorenulls=True).over(w)).where("filled IS NOT NULL")
    x = x.withColumn("new", (F.coalesce(F.lag("filled").over(w), F.lit("")) != F.col("filled")).cast("int")).withColumn("run", F.sum("new").over(w))
    out = x.groupBy("run").agg(F.min("bin").alias("lo_bin"), F.max("bin").alias("hi_bin"), F.first("filled").alias("class"), F.sum("n").alias("n"), F.sum("n_entry").alias("n_entry"))
    all_ = Window.partitionBy()  # one row for each run
    base = F.sum("n_entry").over(all_) / F.sum("n").over(all_)
    share = F.col("n_entry") / F.col("n")
    out = out.withColumns({"entry_share": share, "entry_lift": F.when(base > 0, share / F.when(base > 0, base)).otherwise(0.0)})
    out = out.withColumns({"candidate_region": (F.col("entry_lift") >= lift) & (F.col("n_entry") >= least_entries), "low_evidence": F.col("n_entry") < least_entries})
    return out.where(F.col("n") >= least_rows).drop("run")


def trajectories(seqs: DataFrame) -> DataFrame:
    """group, feature, step, mean, deviation of sequences. seqs: group, seq (steps x features)."""
    steps = seqs.select("group", F.posexplode("seq").alias("step", "row")).select("group", "step", F.posexplode("row").alias("feature", "v"))
    return steps.groupBy("group", "feature", "step").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev"), F.count("v").alias("n"))


def sign_flips(grid: DataFrame) -> DataFrame:
    """feature, flips, reversal: how often the mean changes sign from one kept cell to the next that has one. grid: feature, cell, mean, n."""
    w = Window.partitionBy("feature").orderBy("cell")
    x = grid.where(F.col("n") >= LEAST_CELL).withColumn("sign", F.when(F.col("mean") != 0, F.signum("mean")))
    x = x.withColumn("flip", (F.col("sign") * F.last("sign", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) < 0).cast("int"))
    return x.groupBy("feature").agg(F.coalesce(F.sum("flip"), F.lit(0)).alias("flips")).withColumn("reversal", F.col("flips") >= 2)


def contribution_cells(rows: DataFrame, keys: list[str], low: float = -3.0, high: float = 3.0, step: float = 0.25, digits: int = 8) -> DataFrame:
    """keys, feature, cell, lo, hi, n, mean, abs_mean, thin: contributions by how many deviations a value lies from its mean; cells of `step` and an open one at either end, empty ones too.

    rows: keys, feature, value, contribution. Values count as 32-bit floats; one that does not vary lies at 0, a missing one in the last cell. lo and hi are null where the cell is open.
    Means are rounded to `digits`. One row of statistics for each feature is broadcast: joined by key, all rows of a feature would meet in one task.
    """
    edges = [low + i * step for i in range(round((high - low) / step) + 1)]
    by = [*keys, "feature"]
    v = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("float").cast("double"))
    x = rows.select(*by, v.alias("v"), F.col("contribution").cast("double").alias("c"))
    stats = x.groupBy(*by).agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"))
    z = F.when(F.col("sigma") > 0, (F.col("v") - F.col("mu")) / F.nullif("sigma", F.lit(0.0))).otherwise(0.0)
    cell = F.when(F.col("sigma").isNull() | ((F.col("sigma") > 0) & F.col("v").isNull()), len(edges)).otherwise(bin_of(z, F.array(*[F.lit(e) for e in edges])))
    sums = x.join(F.broadcast(stats), by).groupBy(*by, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean"), F.avg(F.abs("c")).alias("abs_mean"))
    every = stats.select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(edges)))).alias("cell")).join(sums, [*by, "cell"], "left")
    at = F.array(*[F.lit(e) for e in edges])
    n = F.coalesce("n", F.lit(0))
    return every.select(*by, "cell", F.get(at, F.col("cell") - 1).alias("lo"), F.get(at, F.col("cell")).alias("hi"), n.alias("n"), F.round("mean", digits).alias("mean"), F.round("abs_mean", digits).alias("abs_mean"), (n < LEAST_CELL).alias("thin"))


def contribution_features(rows: DataFrame, keys: list[str], digits: int = 8, **axis: float) -> DataFrame:
    """keys, feature, rank, mean_abs, share, used, mu, sigma, flips, reversal of contribution_cells(...): what each feature adds, and whether its push turns more than once. Figures are rounded to `digits`; signs are those of 8."""
    by = [*keys, "feature"]
    v = F.when(~F.isnan(F.col("value").cast("double")), F.col("value").cast("float").cast("double"))
    x = rows.groupBy(*by).agg(F.avg(F.abs("contribution")).alias("m"), F.max((F.col("contribution") != 0).cast("int")).alias("u"), F.avg(v).alias("mu"), F.stddev_pop(v).alias("sigma"))
    all_ = Window.partitionBy(*keys)
    total = F.sum("m").over(all_)
    x = x.withColumns({"rank": F.row_number().over(all_.orderBy(F.desc("m"), "feature")), "share": F.round(F.when(total > 0, F.col("m") / F.nullif(total, F.lit(0.0))).otherwise(0.0), digits)})
    flips = sign_flips(contribution_cells(rows, keys, **axis).select(F.struct(*by).alias("feature"), "cell", "mean", "n")).select("feature.*", "flips", "reversal")
    y = x.join(flips, by, "left")
    return y.select(*by, "rank", F.round("m", digits).alias("mean_abs"), "share", (F.col("u") == 1).alias("used"), F.round("mu", digits).alias("mu"), F.round("sigma", digits).alias("sigma"), F.coalesce("flips", F.lit(0)).alias("flips"), F.coalesce("reversal", F.lit(False)).alias("reversal"))


def sigma_bounds(lo: Column, hi: Column, mu: Column, sigma: Column) -> tuple[Column, Column]:
    """Bounds in deviations from the mean, to five digits; null where a bound is open or nothing varies."""
    one = lambda b: F.when((sigma > 0) & (F.abs(b) < float("inf")), five_digits((b - mu) / F.nullif(sigma, F.lit(0.0))))
    return one(lo), one(hi)


def segment_outcomes(rows: DataFrame, edges: list[float], **rule: float) -> DataFrame:
    """entry_segments(...) with tp_events, tp_rate and tp_lift: how often an entry of the segment reached its target, and that over the rate of all rows. rows: value, entry, y (0 or 1). Shares and lifts have five digits."""
    segments = entry_segments(rows, edges, **rule)
    e = F.array(*[F.lit(float(x)) for x in edges])
    x = rows.where("value IS NOT NULL").groupBy(bin_of(F.col("value"), e).alias("bin")).agg(F.sum(F.when(F.col("entry") == 1, F.col("y")).otherwise(0)).alias("tp"), F.sum("y").alias("all_y"), F.count(F.lit(1)).alias("all_n"))
    all_ = Window.partitionBy()  # one row for each bin
    x = x.withColumn("baseline", F.sum("all_y").over(all_) / F.sum("all_n").over(all_))
    got = segments.join(x, (F.col("bin") >= F.col("lo_bin")) & (F.col("bin") <= F.col("hi_bin"))).groupBy(*segments.columns).agg(F.sum("tp").alias("tp_events"), F.first("baseline").alias("baseline"))
    rate = F.col("tp_events") / F.nullif("n_entry", F.lit(0))
    got = got.withColumns({"tp_rate": five_digits(rate), "tp_lift": F.when(F.col("baseline") > 0, five_digits(rate / F.nullif("baseline", F.lit(0.0))))})
    return got.withColumns({c: five_digits(F.col(c)) for c in ("entry_share", "entry_lift")}).drop("baseline")


def fold_ranking(contributions: DataFrame) -> DataFrame:
    """Mean of the folds' means, not of the pooled rows, and the rank. contributions: fold, feature, value."""
    per = contributions.groupBy("feature", "fold").agg(F.avg(F.abs("value")).alias("m"))
    x = per.groupBy("feature").agg(F.avg("m").alias("score"), F.count(F.lit(1)).alias("folds"))
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature")))  # one row for each feature


def spearman(pairs: DataFrame) -> DataFrame:
    """Rank correlation by rank differences; ties are ranked by key. pairs: key, a, b, one row for each feature."""
    ra, rb = F.row_number().over(Window.orderBy(F.desc("a"), "key")), F.row_number().over(Window.orderBy(F.desc("b"), "key"))
    x = pairs.withColumns({"ra": ra, "rb": rb})
    n = F.count(F.lit(1))
    return x.agg(n.alias("n"), F.when(n > 1, 1 - 6 * F.sum((F.col("ra") - F.col("rb")) * (F.col("ra") - F.col("rb"))) / F.nullif(n * (n * n - 1), F.lit(0))).alias("rho"))


def interval_jaccard(spans: DataFrame) -> DataFrame:
    """key, jaccard of two interval lists by measure. spans: key, side (a or b), lo, hi; overlaps within a side count once."""
    step = lambda at, by: F.struct(F.col(at).alias("at"), *[F.when(F.col("side") == s, by).otherwise(0).alias(s) for s in ("a", "b")])
    ends = spans.where("hi > lo").select("key", F.explode(F.array(step("lo", 1), step("hi", -1))).alias("end")).select("key", "end.*")
    w = Window.partitionBy("key").orderBy("at")
    open_ = {s: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0 for s in ("a", "b")}  # after the last of equal ends; between equal ends nothing is measured
    x = ends.select("key", (F.lead("at").over(w) - F.col("at")).alias("width"), *[c.alias(s) for s, c in open_.items()])
    common, total = F.sum(F.when(F.col("a") & F.col("b"), F.col("width"))), F.sum(F.when(F.col("a") | F.col("b"), F.col("width")))
    return x.groupBy("key").agg((F.coalesce(common, F.lit(0.0)) / total).alias("jaccard"))


def five_digits(x: Column) -> Column:
    """Five significant digits."""
    return F.when(x.isNotNull(), F.format_string("%.4e", x)).cast("double")
