"""Rules by which features, families and strategies are accepted, and the statistics of their null runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.folds import running
from tidebar.operators.nulls import FUTILITY, PERMUTATIONS, advanced, begun, verdicts


def complexity(formula: Column) -> Column:
    """Longest look-back, operators, length: smaller is simpler."""
    digits = F.transform(F.regexp_extract_all(formula, F.lit(r"(\d+)"), F.lit(1)), lambda d: d.cast("int"))
    return F.struct(F.coalesce(F.array_max(digits), F.lit(0)).alias("history"), (F.length(formula) - F.length(F.translate(formula, "+-*/(),", ""))).alias("operators"), F.length(formula).alias("size"))


def one_se(variants: DataFrame) -> DataFrame:
    """family, id, best, se, in_plateau, representative. variants: family, id, mean, folds (array), formula."""
    by = Window.partitionBy("family")
    v = variants.withColumn("kept", F.filter("folds", lambda x: x.isNotNull())).withColumn("k", F.size("kept"))
    m = F.aggregate("kept", F.lit(0.0), lambda a, x: a + x) / F.nullif("k", F.lit(0))
    dev = F.sqrt(F.aggregate("kept", F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.greatest(F.col("k") - 1, F.lit(1)))
    v = v.withColumn("own_se", F.when(F.col("k") > 1, dev / F.sqrt("k")).otherwise(0.0))
    top = F.max(F.struct("mean", (-F.col("id")).alias("i"), "own_se")).over(by)
    v = v.withColumns({"best": (-top["i"]), "se": top["own_se"], "best_mean": top["mean"]}).withColumn("in_plateau", F.col("mean") >= F.col("best_mean") - F.col("se"))
    simple = F.min(F.when(F.col("in_plateau"), F.struct(complexity(F.col("formula")).alias("c"), F.col("id").alias("id")))).over(by)
    return v.withColumn("representative", simple["id"] == F.col("id")).select("family", "id", "mean", "best", "best_mean", "se", "in_plateau", "representative")


def pool_order(ranked: DataFrame, ranges: int = 32) -> DataFrame:
    """Representatives by their family's best mean, then the others by their own: id, place.

    Rows are numbered within ranges of the order, cut at sampled rows, and each range starts where those before it end.
    """
    value = F.when(F.col("representative"), F.col("best_mean")).otherwise(F.col("mean"))
    x = ranked.select("family", "id", "representative", F.struct((~F.col("representative")).cast("int").alias("later"), value.isNull().alias("none"), (-value).alias("value"), F.col("id").alias("id")).alias("key"))
    some = sorted((r.key for r in x.select("key").orderBy(F.xxhash64("id"), "key").limit(16 * ranges).collect()), key=lambda k: [(v is not None, v if v is not None else 0) for v in k])
    kinds = {f.name: f.dataType for f in x.schema["key"].dataType}
    bounds = [F.struct(*[F.lit(k[c]).cast(t).alias(c) for c, t in kinds.items()]) for k in some[8::16]]
    part = F.size(F.filter(F.array(*bounds), lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    x = x.withColumn("part", part)
    before, starts = 0, {}
    for part, n in sorted(tuple(r) for r in x.groupBy("part").count().collect()):
        starts[part] = before
        before += n
    offset = F.element_at(F.array(*[F.lit(starts.get(k, 0)).cast("bigint") for k in range(len(bounds) + 1)]), F.col("part") + 1)
    place = (F.row_number().over(Window.partitionBy("part").orderBy("key")) + offset).cast("int")
    return x.select("family", "id", "representative", place.alias("place"))  # one row for each feature


def stage_pool(ranked: DataFrame) -> DataFrame:
    """family, id, stage, place: the pool of a search in two stages, from one_se(...) of the survivors.

    Stage 1 holds each family's representative, the strongest family first, then the smaller id; stage 2 its other survivors, the best first, to be tried only if the representative was taken: `place` counts within the stage, in stage 2 within the family.
    """
    first, others = F.row_number().over(Window.orderBy(F.desc("best_mean"), "id")), F.row_number().over(Window.partitionBy("family").orderBy(F.desc("mean"), "id"))
    heads = ranked.where("representative").select("family", "id", F.lit(1).alias("stage"), first.alias("place"))  # one row for each family
    rest = ranked.where("NOT representative").select("family", "id", F.lit(2).alias("stage"), others.alias("place"))
    return heads.unionByName(rest)


def acceptance(rotations: DataFrame, penalty: float = 0.004, least: int = 2, majority: float = 0.5) -> DataFrame:
    """Per ticker, fold and arm: the eligible unit with the best median gain less the penalty, and whether it is accepted.

    A unit is a feature in the flat arm, a family in the hierarchical one; it is eligible if at least `least`
    comparable rotations picked it and it gained in more than `majority` of them. The statistic is its score, 0 without
    an eligible unit; the unit is accepted if that is above 0. Of equal scores the unit first picked wins, by
    `rotation` if there is such a column, then by name. Rotations without a gain count for nothing.
    """
    unit = F.when(F.col("arm") == "flat", F.concat(F.lit("feature:"), F.col("picked").cast("string"))).otherwise(F.concat(F.lit("family:"), F.col("family")))
    first = F.min(F.col("rotation") if "rotation" in rotations.columns else F.lit(0))
    x = rotations.where("confirm_delta IS NOT NULL").withColumn("unit", unit).groupBy("ticker", "outer_fold", "arm", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("confirm_delta") > 0).cast("int")).alias("wins"), F.median("confirm_delta").alias("median"), first.alias("first"),
    )
    x = x.withColumn("eligible", (F.col("n") >= least) & (F.col("wins") / F.col("n") > majority))
    best = F.min(F.when(F.col("eligible"), F.struct((-F.col("median")).alias("m"), "first", "unit", "n", "wins")))
    x = x.groupBy("ticker", "outer_fold", "arm").agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("eligible").cast("int")).alias("units_eligible"), best.alias("best"))
    score = F.coalesce(-F.col("best.m") - penalty, F.lit(0.0))
    return x.select("ticker", "outer_fold", "arm", "units", "units_eligible", F.col("best.unit").alias("unit"), F.coalesce("best.n", F.lit(0)).alias("rotations"), F.coalesce("best.wins", F.lit(0)).alias("wins"), F.when(score > 0, F.col("best.unit")).alias("accepted"), score.alias("statistic"))


def exceedance(null: DataFrame, observed: DataFrame, keys: list[str], most: int = PERMUTATIONS, futility: int = FUTILITY) -> DataFrame:
    """The sequential verdict over all permutations of a finished null run. null: keys, permutation, t. observed: keys, statistic."""
    return verdicts(advanced(begun(observed, keys), null, keys, most), keys, most, futility).drop("min_displaced_fraction")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    mid, half, d = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / d, (mid + half) / d


def blocks(times: DataFrame, span: int, within: list[str] | None = None) -> DataFrame:
    """ticker, t0, block, pos: a block ends before the first time at least `span` after its first one. within: columns that no block crosses, kept too.

    Each block depends on where the last one began, so a ticker's times are one ordered fold.
    """
    keys = ["ticker", *(within or [])]

    def step(a: Column, r: Column) -> Column:
        new = a["begin"].isNull() | (r["t0"] - a["begin"] >= span)
        return F.struct(F.when(new, r["t0"]).otherwise(a["begin"]).alias("begin"), (a["block"] + new.cast("int")).alias("block"))

    x = running(times.select(*keys, "t0"), keys, ["t0"], {"begin": None, "block": -1}, "`begin`: int, `block`: int", step).select(*keys, "t0", "state.block")
    return x.withColumn("pos", F.row_number().over(Window.partitionBy(*keys, "block").orderBy("t0")) - 1)


def macro_segments(times: DataFrame, groups: int) -> DataFrame:
    """ticker, t0, segment: equal spans of time, none shorter than one bar."""
    by = Window.partitionBy("ticker")
    width = F.greatest(F.lit(1.0), (F.max("t0").over(by) + 1 - F.min("t0").over(by)) / groups)
    return times.withColumn("segment", F.least(F.lit(groups - 1), F.floor((F.col("t0") - F.min("t0").over(by)) / width)).cast("int"))


def grouped_blocks(times: DataFrame, span: int, groups: int) -> DataFrame:
    """Blocks within equal spans of time: ticker, segment, t0, block, pos."""
    return blocks(macro_segments(times.select("ticker", "t0"), groups), span, ["segment"])


def orders(blocked: DataFrame, seed: int, number: int, least: float = 0.5, tries: int = 64) -> DataFrame:
    """ticker, segment, block, own, place, draw: a reordering of each ticker's blocks, within segments if blocked has them; `own` numbers them over all segments.

    A reordering sorts the blocks by a hash of seed, number, try, ticker, segment and block. The first of `tries` that moves at least this share of
    a ticker's blocks is taken; later ones are drawn only where the first does not. A ticker none of whose tries does is an error.
    """
    x = blocked if "segment" in blocked.columns else blocked.withColumn("segment", F.lit(0))
    x = x.select("ticker", "segment", "block").distinct()
    x = x.withColumn("own", F.row_number().over(Window.partitionBy("ticker").orderBy("segment", "block")) - 1).withColumn("_first", F.min("own").over(Window.partitionBy("ticker", "segment")))

    def drawn(rows: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(number)), F.col("draw").cast("string"), F.col("ticker"), F.col("segment").cast("string"), F.col("block").cast("string")))
        y = rows.withColumn("_o", key).withColumn("place", F.row_number().over(Window.partitionBy("ticker", "segment", "draw").orderBy("_o", "block")) - 1 + F.col("_first"))
        by = Window.partitionBy("ticker", "draw")
        return y.withColumn("_fine", F.sum((F.col("place") != F.col("own")).cast("int")).over(by) >= least * F.count(F.lit(1)).over(by))

    enough = drawn(x.withColumn("draw", F.lit(0))).groupBy("ticker").agg(F.max("_fine").alias("_enough"))
    which = F.when(F.col("_enough"), F.array(F.lit(0))).otherwise(F.array(*[F.lit(i) for i in range(min(1, tries - 1), tries)]))
    by = Window.partitionBy("ticker")
    y = drawn(x.join(enough, "ticker").withColumn("draw", F.explode(which))).withColumn("_draw", F.min(F.when(F.col("_fine"), F.col("draw"))).over(by))
    none = F.raise_error(F.concat(F.lit("no reordering moves enough blocks of "), "ticker")).cast("int")
    y = y.withColumn("_draw", F.when(F.col("_draw").isNull(), none).otherwise(F.col("_draw"))).where(F.col("draw") == F.col("_draw"))
    return y.select("ticker", "segment", "block", "own", "place", "draw")


def draws(order: DataFrame) -> DataFrame:
    """ticker, draw, displaced, n_blocks, segments, blocks_per_segment, index_hash: what a reordering moved. order: from orders(...)."""
    per = order.groupBy("ticker", "segment").agg(F.count(F.lit(1)).alias("n")).groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "n"))), lambda s: s["n"]).alias("blocks_per_segment"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "own"))), lambda s: s["own"].cast("string")), ","), 256)
    x = order.groupBy("ticker", "draw").agg(F.sum((F.col("place") != F.col("own")).cast("int")).alias("displaced"), F.count(F.lit(1)).alias("n_blocks"), F.substring(digest, 1, 16).alias("index_hash"))
    return x.join(per, "ticker").select("ticker", "draw", "displaced", "n_blocks", F.size("blocks_per_segment").alias("segments"), "blocks_per_segment", "index_hash")


def permuted(blocked: DataFrame, order: DataFrame) -> DataFrame:
    """ticker, t0, src_t0: the rows in the order of their blocks that orders(...) gave."""
    x = blocked if "segment" in blocked.columns else blocked.withColumn("segment", F.lit(0))
    rank = Window.partitionBy("ticker")
    src = x.join(order.select("ticker", "segment", "block", F.col("place").alias("_slot")), ["ticker", "segment", "block"])
    src = src.select("ticker", F.col("t0").alias("src_t0"), F.row_number().over(rank.orderBy("_slot", "pos")).alias("place"))
    dst = x.select("ticker", "t0", F.row_number().over(rank.orderBy("t0")).alias("place"))
    return dst.join(src, ["ticker", "place"]).select("ticker", "t0", "src_t0")


def family_matrix(accepted: DataFrame, majority: float = 0.5) -> DataFrame:
    """Per family, in how many tickers it was accepted and in how many of them the null run confirmed it, and its class.

    accepted: ticker, family, null (passed, failed, or null where no null run was made), one row for each fold and arm
    that accepted it. Recurrence is the confirmed share of the tickers, to three places.
    """
    passed, missing = F.max(F.coalesce(F.col("null") == "passed", F.lit(False)).cast("int")), F.max(F.col("null").isNull().cast("int"))
    per = accepted.groupBy("family", "ticker").agg(passed.alias("passed"), missing.alias("missing"))
    x = per.groupBy("family").agg(F.count(F.lit(1)).alias("n_provisional"), F.sum("passed").alias("n_confirmed"), F.sum(((F.col("missing") == 1) & (F.col("passed") == 0)).cast("int")).alias("n_screening"))
    kind = (
        F.when((F.col("n_confirmed") == 0) & (F.col("n_screening") == 0), "unconfirmed").when(F.col("n_confirmed") == 0, "screening_only").when(F.col("n_confirmed") == 1, "asset_specific")
        .when(F.col("n_confirmed") > majority * F.col("n_provisional"), "universal").otherwise("conditional")
    )
    return x.withColumns({"classification": kind, "recurrence": F.round(F.col("n_confirmed") / F.col("n_provisional"), 3)})


#: The classes, the most transferable first.
CLASSES = "universal conditional asset_specific screening_only unconfirmed".split()


def transfer_prior(matrix: DataFrame) -> DataFrame:
    """The matrix with `place`, the order in which to search families on a new ticker. One row for each family."""
    order = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("classification"))
    return matrix.withColumn("place", F.row_number().over(Window.orderBy(order, F.desc("n_confirmed"), F.desc("recurrence"), "family")))
