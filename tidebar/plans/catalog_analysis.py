"""Queries of the console, the screening, the interpretation and the search rules, on inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.operators import console as C
from tidebar.operators import features as X
from tidebar.operators import interpret as I
from tidebar.operators import screening as P
from tidebar.operators import search as R
from tidebar.operators import trades as T
from tidebar.plans import sql as S
from tidebar.plans.catalog_bars import hourly, rounded
from tidebar.sources import bars as B
from tidebar.sources import stores

# A result store in place of sealed runs: the same expressions for both engines.
_RESULTS = [
    "concat('T', cast(c_custkey as varchar(20))) AS ticker", "model", "CASE WHEN k % 5 = 0 THEN 0 ELSE k % 61 END AS model_trades",
    "CASE WHEN k % 5 = 0 THEN 1 ELSE greatest(k % 61, 1) END AS trades", "round(c_acctbal / 100 - 20 + k % 13, 4) AS return_pct",
    "CASE WHEN k % 17 = 0 THEN NULL ELSE round(c_acctbal / 83 - 10, 4) END AS hodl_return_pct", "CASE WHEN k % 5 = 0 OR k % 61 < 3 THEN NULL ELSE (k % 23) / 10.0 + 0.1 END AS profit_factor",
    "CASE WHEN k % 5 = 0 THEN 0 ELSE cast(floor((k % 61) * (k % 7) / 7.0) as bigint) END AS wins", "CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END AS trade_floor_met",
]
_RESULTS_2 = ["*", "model_trades - wins AS losses", "CASE WHEN return_pct > coalesce(hodl_return_pct, 1e9) THEN 1 ELSE 0 END AS beats_hodl"]
RESULTS = f"""results AS (SELECT {", ".join(_RESULTS_2)} FROM (SELECT {", ".join(_RESULTS)} FROM (
  SELECT c_custkey, c_acctbal, model, c_custkey * 7 + CASE WHEN model = 'lstm' THEN 3 ELSE 0 END AS k FROM customer, (SELECT unnest(['xgb', 'lstm']) AS model))))"""


def results(spark, d):
    x = B.read(spark, d, "customer").select("c_custkey", "c_acctbal", F.explode(F.array(F.lit("xgb"), F.lit("lstm"))).alias("model"))
    return x.withColumn("k", F.col("c_custkey") * 7 + F.when(F.col("model") == "lstm", 3).otherwise(0)).selectExpr(*_RESULTS).selectExpr(*_RESULTS_2)


def console_overview(spark, d):
    return rounded(C.overview(results(spark, d)), ["median_return", "median_hodl", "median_pf", "beats_share"])


def console_payoff(spark, d):
    return rounded(C.payoff(results(spark, d)), ["median_payoff", "share_2"])


def console_basket(spark, d):
    r = results(spark, d)
    return rounded(C.basket(r, r.where("model_trades > 20").select("ticker").distinct(), "xgb"), ["executed_usd", "ml_usd", "hodl_usd"])


def console_overlap(spark, d):
    return C.overlap(results(spark, d), "xgb", "lstm")


def console_trade_buckets(spark, d):
    return C.trade_buckets(results(spark, d))


def console_return_histogram(spark, d):
    return C.histogram(results(spark, d), "return_pct", -100.0, 300.0, 60)


def console_result_rows(spark, d):
    r = results(spark, d)
    mode = F.when(F.col("trade_floor_met") == 0, "TRAIN_OOF_FLOOR_NOT_MET").when(F.col("model_trades") == 0, "HODL_FALLBACK_NO_MODEL_TRADES").when(F.col("model_trades") == 1, "ML_ONE_TRADE_LOW_EVIDENCE").otherwise("ML_MULTI_TRADE")
    return rounded(r.where("model = 'xgb' AND hodl_return_pct IS NOT NULL").select("ticker", mode.alias("result_mode"), "return_pct", "hodl_return_pct", "model_trades"), ["return_pct", "hodl_return_pct"])


def console_mode_counts(spark, d):
    x = results(spark, d).withColumn("result_mode", F.when(F.col("trade_floor_met") == 0, "TRAIN_OOF_FLOOR_NOT_MET").when(F.col("model_trades") == 0, "HODL_FALLBACK_NO_MODEL_TRADES").when(F.col("model_trades") == 1, "ML_ONE_TRADE_LOW_EVIDENCE").otherwise("ML_MULTI_TRADE"))
    return x.groupBy("model", "result_mode").agg(F.count(F.lit(1)).alias("n"))


def console_coverage(spark, d):
    """Assets of one model that the other did not trade, both ways."""
    r = results(spark, d).where("model_trades > 0")
    a, b = r.where("model = 'xgb'").select("ticker"), r.where("model = 'lstm'").select("ticker")
    return a.exceptAll(b).withColumn("side", F.lit("xgb_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("lstm_only"))).unionByName(a.intersect(b).withColumn("side", F.lit("both"))).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def console_health(spark, d):
    """One store for each nation, in whatever state its customers put it."""
    c = B.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("store")).agg(F.count(F.lit(1)).alias("assets"), F.sum((F.col("c_acctbal") < -950).cast("int")).alias("failed_checks"))
    k = F.col("store")
    c = c.withColumns({"found": k % 7 > 0, "missing_tables": (k % 5 == 1).cast("int"), "frozen": k % 4 != 2, "expected": F.col("assets") + (k % 6 == 5).cast("int")})
    return C.health(c).select("store", "assets", "state")


def first_result_rows(spark, d):
    """One row for each asset, that of the model with the higher return."""
    return rounded(C.first_rows(results(spark, d).select("ticker", "model", (-F.col("return_pct")).alias("loss_pct")), ["ticker"], ["loss_pct", "model"]), ["loss_pct"])


def integrity_checks(spark, d):
    c = B.read(spark, d, "customer").groupBy(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("check_name")).agg(F.when(F.min("c_acctbal") < -900, "FAIL").otherwise("PASS").alias("status"))
    return C.integrity(c)


def drawn_basket(spark, d):
    return C.drawn_basket(results(spark, d), 11)


def ledger_head(spark, d):
    x = B.read(spark, d, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderkey").alias("trade_id"), "o_orderstatus")
    return C.ledger_head(x, ["ticker"])


def result_upsert(spark, d):
    r = results(spark, d).select("ticker", "model", "return_pct")
    new = r.where("model = 'xgb'").withColumn("return_pct", F.lit(0.0)).withColumn("note", F.lit("rerun"))
    return rounded(stores.upserted(r, new.where("ticker LIKE 'T1%'"), ["ticker", "model"]), ["return_pct"])


def _contrib(spark, d):
    x = B.read(spark, d, "part").withColumns({"ticker": F.col("p_brand"), "feature": F.col("p_type"), "family": F.substring("p_type", 1, 3)})
    return x.groupBy("ticker", "family", "feature").agg(F.sum("p_retailprice").alias("gain"))


def feature_contributions(spark, d):
    return rounded(C.contributions(_contrib(spark, d)).drop("gain"), ["share", "family_share"])


def feature_tooltips(spark, d):
    x = B.read(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("family"))
    return C.tooltips(x)


PROFILE = ["max_abs_return", "volatility", "median_turnover", "min_close", "max_close", "coverage", "flat_share", "resolution"]


def table_profile(spark, d):
    return rounded(P.profile(hourly(spark, d), gap_hours=1), PROFILE)


def return_correlations(spark, d):
    return rounded(P.correlations(hourly(spark, d), 100), ["corr"])


def filter_cascade(spark, d):
    """The rules of a sample on the bars of each kind of event and group of users; a table is short if it has under 70 in 100 of the longest one's bars, and lies flat if it has no second event in an hour."""
    e = B.read(spark, d, "events").withColumn("event_type", F.concat("event_type", F.lit("-"), (F.col("user_id") % 11).cast("string")))
    return P.cascade(P.profile(B.hourly_from_events(e)), P.sample_rules(coverage="coverage >= 0.7", max_abs_return="max_abs_return <= 6", violent="violent <= bars * 0.97", flat_share="flat_share <= 0.99", max_gap_hours="max_gap_hours <= 60"))


def sample_cascade(spark, d):
    """The same rules at their fixed values, on daily bars."""
    by_brand = B.read(spark, d, "lineitem").join(B.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("l_returnflag", F.col("p_brand"))
    return P.cascade(P.profile(B.daily_from_lineitem(by_brand)), P.sample_rules())


def nearest_rank_quantiles(spark, d):
    x = hourly(spark, d).groupBy("ticker").agg(P.nearest_rank("close", 0.1).alias("p10"), P.nearest_rank("close", 0.5).alias("p50"), P.nearest_rank("close", 0.9).alias("p90"))
    return rounded(x, ["p10", "p50", "p90"])


def uncorrelated_sample(spark, d):
    """The smoothest prices first, of which each must differ from those taken."""
    b = hourly(spark, d)
    b = b.withColumn("half", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("ticker", F.concat_ws("-", "ticker", "half")).withColumn("close", F.when(F.col("half") == "b", F.col("close") * 2 + F.col("idx") % 3 * 0.01).otherwise(F.col("close")))
    top = b.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "ticker")))  # one row for each ticker
    return P.uncorrelated(top, P.correlations(b, 20), 4, 0.95)


def sample_digest(spark, d):
    return B.universe(hourly(spark, d)).agg(P.digest(F.array_sort(F.collect_list("ticker"))).alias("digest"))


def ledger_chain(spark, d):
    x = B.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("body"))
    return stores.chained(x, "seq", "body")


def ledger_latest(spark, d):
    x = B.read(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("body"))
    return stores.latest(x, "unit")


EDGES = [0.5, 1.0, 2.0, 3.5, 5.0, 7.5, 9.0]


def _rows(spark, d):
    return B.read(spark, d, "lineitem").select((F.col("l_extendedprice") / 10000).alias("value"), (F.col("l_returnflag") == "R").cast("int").alias("entry"))


def entry_bins(spark, d):
    return rounded(I.bin_stats(_rows(spark, d), EDGES), ["rate", "lift"])


def entry_segments(spark, d):
    return rounded(I.entry_segments(_rows(spark, d), EDGES, lift=1.0), ["entry_share", "entry_lift"])


def split_harvest(spark, d):
    t = B.read(spark, d, "part").select(F.when(F.col("p_size") > 45, "Leaf").otherwise(F.col("p_brand")).alias("feature"), F.col("p_size").cast("double").alias("split"), F.col("p_retailprice").alias("gain"))
    x = I.split_points(t)
    return rounded(x.select("feature", F.size("thresholds").alias("n_thresholds"), F.array_min("thresholds").alias("lowest"), F.array_max("thresholds").alias("highest"), "n_splits", "gain", "gain_share"), ["gain", "gain_share", "lowest", "highest"])


def feature_quantiles(spark, d):
    x = X.core(hourly(spark, d)).groupBy("ticker").agg(F.percentile("rsi_14", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.count("rsi_14").alias("n"))
    return rounded(x.select("ticker", "n", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q90")), ["q10", "q50", "q90"])


def trajectory_bands(spark, d):
    f = X.core(hourly(spark, d))
    s = T.sequences(f, ["log_return_5", "rsi_14"], 12).join(f.select("ticker", "idx", "direction"), ["ticker", "idx"]).withColumn("group", F.when(F.col("direction") > 0, "entry").otherwise("rest"))
    x = I.trajectories(s.select("group", F.transform("seq", lambda r: F.transform(r, lambda v: v.cast("double"))).alias("seq")))
    return x.select("group", "feature", "step", "n", (F.round("mean", 4) + 0.0).alias("mean"), (F.round("dev", 4) + 0.0).alias("dev"))


def interval_overlap(spark, d):
    x = B.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_linenumber") % 2 == 0, "a").otherwise("b").alias("side"), F.col("l_quantity").alias("lo"), (F.col("l_quantity") + 3 + F.col("l_linenumber")).alias("hi"))
    return rounded(I.interval_jaccard(x), ["jaccard"])


def rank_correlation(spark, d):
    x = B.read(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.avg("p_retailprice").alias("a"), F.avg("p_size").alias("b"))
    return rounded(I.spearman(x), ["rho"])


def fold_ranking(spark, d):
    x = B.read(spark, d, "part").select((F.col("p_partkey") % 4).alias("fold"), F.col("p_brand").alias("feature"), (F.col("p_retailprice") - 1400).alias("value"))
    return rounded(I.fold_ranking(x), ["score"])


def shap_sign_flips(spark, d):
    x = B.read(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("feature"), F.floor(F.col("l_quantity") / 2).alias("cell")).agg((F.avg("l_discount") - 0.05).alias("mean"), F.count(F.lit(1)).alias("n"))
    return I.sign_flips(x)


def _contributions(spark, d):
    """Line items' contributions by price, tax and a constant, for each line status."""
    x = B.read(spark, d, "lineitem").withColumn("f", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.expr(v).alias("value"), F.expr(c).alias("contribution")) for n, v, c in _CONTRIBUTIONS])))
    return x.select(F.col("l_linestatus").alias("ticker"), "f.*")


_CONTRIBUTIONS = [("price", "CAST(l_extendedprice AS double)", "sin(l_extendedprice / 9000.0D) * l_discount"), ("tax", "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_tax AS double) END", "l_tax - 0.04"), ("constant", "CAST(2.5 AS double)", "0.0D")]


def contribution_cells(spark, d):
    return rounded(I.contribution_cells(_contributions(spark, d), ["ticker"], digits=6), ["mean", "abs_mean"])


def contribution_features(spark, d):
    return rounded(I.contribution_features(_contributions(spark, d), ["ticker"], digits=6), ["mean_abs", "share", "mu", "sigma"])


def sigma_bounds(spark, d):
    s = B.read(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mu"), F.when(F.col("p_brand") == "Brand#1", 0.0).otherwise(F.stddev_pop("p_retailprice")).alias("sigma"))
    x = B.read(spark, d, "part").join(s, "p_brand").withColumns({"lo": F.when(F.col("p_size") < 5, -float("inf")).otherwise(F.col("p_retailprice") - F.col("p_size")), "hi": F.when(F.col("p_size") > 45, float("inf")).otherwise(F.col("p_retailprice") + F.col("p_size"))})
    lo, hi = I.sigma_bounds(F.col("lo"), F.col("hi"), F.col("mu"), F.col("sigma"))
    return x.select("p_partkey", (lo + 0.0).alias("lo"), (hi + 0.0).alias("hi"))


def segment_outcomes(spark, d):
    """Entries are dear returned line items; a target is reached with a high discount."""
    x = B.read(spark, d, "lineitem").select((F.col("l_extendedprice") / 10000).alias("value"), ((F.col("l_returnflag") == "R") & (F.col("l_extendedprice") % 25000 > 12000)).cast("int").alias("entry"), (F.col("l_discount") > 0.06).cast("int").alias("y"))
    return I.segment_outcomes(x, EDGES)


def five_significant_digits(spark, d):
    return B.read(spark, d, "part").select("p_partkey", I.five_digits(F.col("p_retailprice") / 7).alias("v"))


_ROT = "o_orderpriority AS ticker, o_orderkey AS rotation, o_orderkey % 3 AS outer_fold, CASE WHEN o_custkey % 2 = 0 THEN 'flat' ELSE 'hierarchical' END AS arm, o_custkey % 11 AS picked, concat('f', cast(o_custkey % 4 as varchar(5))) AS family, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE floor(o_totalprice) % 1000 / 10000.0 - 0.047 END AS confirm_delta"


def rotation_acceptance(spark, d):
    x = B.read(spark, d, "orders").selectExpr(*_split_top(_ROT))
    return rounded(R.acceptance(x), ["statistic"])


def _split_top(text: str) -> list[str]:
    """The items of a select list."""
    out, depth, item = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [x.strip() for x in [*out, item]]


def _variants(spark, d):
    x = B.read(spark, d, "part")
    m = F.floor("p_retailprice") % 97 / 1000.0
    return x.select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), m.alias("mean"), F.array(m - 0.01, m + 0.02, m - 0.005 * (F.col("p_size") % 3)).alias("folds"), F.concat(F.lit("rolling_mean(c,"), F.col("p_size").cast("string"), F.lit(")/c-1")).alias("formula"))


def one_se_representatives(spark, d):
    return rounded(R.one_se(_variants(spark, d)), ["mean", "best_mean", "se"])


def search_pool_order(spark, d):
    return R.pool_order(R.one_se(_variants(spark, d)))


def search_stage_pool(spark, d):
    return R.stage_pool(R.one_se(_variants(spark, d)))


def null_exceedance(spark, d):
    """Some tickers' runs stopped short of fifty permutations, some statistics are seldom reached."""
    x = B.read(spark, d, "orders").select(F.col("o_orderpriority").alias("ticker"), (F.col("o_orderkey") % 50).alias("permutation"), "o_totalprice")
    null = x.where("NOT (ticker LIKE '5%' AND permutation = 30)").groupBy("ticker", "permutation").agg(F.max("o_totalprice").alias("t"))
    obs = x.groupBy("ticker").agg((F.max("o_totalprice") * F.when(F.col("ticker") < "3", 0.9).otherwise(0.999)).alias("statistic"))
    return rounded(R.exceedance(null, obs, ["ticker"]), ["p_mc", "final_p_lower_bound", "null_max", "null_median"])


def wilson_interval(spark, d):
    x = B.read(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = R.wilson(F.col("k"), F.col("n"))
    return rounded(x.withColumns({"lo": lo, "hi": hi}), ["lo", "hi"])


def _t0(spark, d):
    return T.candidates(X.core(hourly(spark, d))).select("ticker", "t0")


def time_blocks(spark, d):
    return R.blocks(_t0(spark, d), 24)


def macro_segments(spark, d):
    return R.macro_segments(_t0(spark, d), 4)


def block_permutation(spark, d):
    x = R.blocks(_t0(spark, d), 24)
    return R.permuted(x, R.orders(x, 42, 1))


def segment_permutation(spark, d):
    """Blocks reordered within each quarter of a ticker's time."""
    x = R.grouped_blocks(_t0(spark, d), 24, 4)
    return R.permuted(x, R.orders(x, 42, 1))


def permutation_draw(spark, d):
    return R.draws(R.orders(R.grouped_blocks(_t0(spark, d), 24, 4), 42, 1)).drop("blocks_per_segment")


def _accepted(spark, d):
    x = B.read(spark, d, "lineitem").join(B.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    verdict = F.when(F.col("l_orderkey") % 13 == 0, "passed").when(F.col("l_orderkey") % 5 > 0, "failed")
    return x.select(F.col("p_type").alias("family"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("ticker"), verdict.alias("null"))


def family_matrix(spark, d):
    return R.family_matrix(_accepted(spark, d))


def transfer_prior(spark, d):
    return R.transfer_prior(R.family_matrix(_accepted(spark, d))).select("place", "family", "classification")


_BASE = f"""{S.core_features(S.BARS_1H)}, cand AS (SELECT ticker, idx AS t0 FROM (SELECT *, max(idx) OVER (PARTITION BY ticker) AS last FROM core) WHERE idx < last AND log_return_5 <> 0 AND atr > 1e-9)"""
_SEG = "SELECT ticker, t0, least(3, floor((t0 - min(t0) OVER t) / greatest(1.0, (max(t0) OVER t + 1 - min(t0) OVER t) / 4.0)))::INT AS segment FROM cand WINDOW t AS (PARTITION BY ticker)"
_ONE = "SELECT ticker, t0, 0 AS segment FROM cand"


def blocks_sql(segments: str) -> str:
    """The table blk: ticker, segment, t0, block, pos."""
    return f"""{_BASE}, seg AS ({segments}), num AS (SELECT *, row_number() OVER (PARTITION BY ticker, segment ORDER BY t0) AS k FROM seg),
walk AS (SELECT ticker, segment, t0, k, t0 AS b0, 0 AS block FROM num WHERE k = 1 UNION ALL
  SELECT n.ticker, n.segment, n.t0, n.k, CASE WHEN n.t0 - b0 >= 24 THEN n.t0 ELSE b0 END, CASE WHEN n.t0 - b0 >= 24 THEN block + 1 ELSE block END FROM walk JOIN num n ON n.ticker = walk.ticker AND n.segment = walk.segment AND n.k = walk.k + 1),
blk AS (SELECT ticker, segment, t0, block, (row_number() OVER (PARTITION BY ticker, segment, block ORDER BY t0) - 1)::INT AS pos FROM walk)"""


def orders_sql(segments: str) -> str:
    """The tables drawn (provenance) and moved (ticker, t0, src_t0) of the accepted reordering."""
    return f"""{blocks_sql(segments)}, own AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY segment, block) - 1 AS own FROM (SELECT DISTINCT ticker, segment, block FROM blk)),
tries AS (SELECT *, t::INT AS draw, row_number() OVER (PARTITION BY ticker, segment, t ORDER BY md5(concat_ws('-', '42', '1', t::VARCHAR, ticker, segment::VARCHAR, block::VARCHAR)), block) - 1 + f AS place
  FROM (SELECT *, min(own) OVER (PARTITION BY ticker, segment) AS f FROM own), range(64) r(t)),
seen AS (SELECT ticker, draw, count(*) FILTER (place <> own) AS displaced, count(*) AS n_blocks, count(DISTINCT segment)::INT AS segments, left(sha256(string_agg(own::VARCHAR, ',' ORDER BY place)), 16) AS index_hash FROM tries GROUP BY ALL),
drawn AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY draw) AS k FROM seen WHERE displaced >= 0.5 * n_blocks) WHERE k = 1),
src AS (SELECT ticker, t0 AS src_t0, row_number() OVER (PARTITION BY ticker ORDER BY place, pos) AS place FROM blk JOIN tries USING (ticker, segment, block) JOIN drawn USING (ticker, draw)),
moved AS (SELECT ticker, t0, src_t0 FROM (SELECT ticker, t0, row_number() OVER (PARTITION BY ticker ORDER BY t0) AS place FROM blk) JOIN src USING (ticker, place))"""


_MATRIX = """WITH a AS (SELECT p_type AS family, l_returnflag || l_suppkey AS ticker, CASE WHEN l_orderkey % 13 = 0 THEN 'passed' WHEN l_orderkey % 5 > 0 THEN 'failed' END AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT family, ticker, coalesce(bool_or(v = 'passed'), false) AS passed, bool_or(v IS NULL) AS missing FROM a GROUP BY ALL),
f AS (SELECT family, count(*) AS n_provisional, sum(passed::INT)::BIGINT AS n_confirmed, sum((missing AND NOT passed)::INT)::BIGINT AS n_screening FROM t GROUP BY family),
m AS (SELECT *, CASE WHEN n_confirmed = 0 AND n_screening = 0 THEN 'unconfirmed' WHEN n_confirmed = 0 THEN 'screening_only' WHEN n_confirmed = 1 THEN 'asset_specific' WHEN n_confirmed > 0.5 * n_provisional THEN 'universal' ELSE 'conditional' END AS classification,
  round(n_confirmed / n_provisional, 3) AS recurrence FROM f)"""


def cascade_sql(bars: str, **other: str) -> str:
    rules = P.SAMPLE_RULES | other
    fails = " ".join(f"WHEN NOT coalesce({r}, false) THEN {i}" for i, r in enumerate(rules.values()))
    return f"""WITH {bars}, l AS (SELECT *, (epoch(date_trunc('hour', ts)) - epoch(date_trunc('hour', lag(ts) OVER w))) / 3600 AS gap, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY idx)),
      p AS (SELECT ticker, count(*) AS bars, count(*) FILTER (gap > 96) AS gaps, max(gap)::BIGINT AS max_gap_hours, max(abs(r)) AS max_abs_return, count(*) FILTER (abs(r) > 0.35) AS violent, round(count(*) FILTER (high = low) / count(*), 6) AS flat_share, round(count(DISTINCT close) / count(*), 6) AS resolution FROM l GROUP BY ticker),
      f AS (SELECT CASE {fails} ELSE {len(rules)} END AS s FROM (SELECT *, round(bars / max(bars) OVER (), 6) AS coverage FROM p)),
      r AS (SELECT unnest({list(rules)}) AS rule, unnest({list(range(len(rules)))})::INT AS step)
      SELECT step, rule, (SELECT count(*) FROM f WHERE s = step) AS dropped, (SELECT count(*) FROM f WHERE s > step) AS remaining FROM r"""


def verdict_sql(keys: list[str]) -> str:
    """The sequential verdict from n (keys, permutation, t) and s (keys, statistic); the last tables of a WITH and its query."""
    k = ", ".join(keys)
    return f"""run AS (SELECT *, count(*) FILTER (t >= statistic) OVER (PARTITION BY {k} ORDER BY permutation) AS b FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY permutation) - 1 AS place FROM n JOIN s USING ({k}) WHERE permutation < 50) WHERE place = permutation),
      st AS (SELECT {k}, max(permutation) + 1 AS executed, min(permutation) FILTER (b >= 5) + 1 AS stopped, least(max(b), 5) AS b FROM run GROUP BY ALL),
      nl AS (SELECT {k}, max(t) AS null_max, median(t) AS null_median FROM run JOIN st USING ({k}) WHERE permutation < coalesce(stopped, executed) GROUP BY ALL)
      SELECT {k}, CASE WHEN coalesce(st.b, 0) >= 5 THEN 'rejected_early' WHEN executed >= 50 THEN 'passed' ELSE 'incomplete' END AS verdict, coalesce(stopped, executed, 0)::INT AS permutations_executed, coalesce(st.b, 0)::INT AS exceedances,
        CASE WHEN st.b < 5 AND executed >= 50 THEN round((st.b + 1) / 51, 6) + 0.0 END AS p_mc, CASE WHEN st.b >= 5 THEN round((st.b + 1) / 51, 6) + 0.0 END AS final_p_lower_bound, round(null_max, 6) + 0.0 AS null_max, round(null_median, 6) + 0.0 AS null_median
      FROM s LEFT JOIN st USING ({k}) LEFT JOIN nl USING ({k})"""


_BINS = f"""bins AS (SELECT len(list_filter({EDGES}, lambda e: e::FLOAT <= (l_extendedprice / 10000)::FLOAT))::INT AS bin, count(*) AS n, sum((l_returnflag = 'R')::INT)::BIGINT AS n_entry FROM lineitem GROUP BY 1),
stats AS (SELECT *, n_entry / n AS rate, (n_entry / n) / (sum(n_entry) OVER () / sum(n) OVER ()) AS lift FROM bins)"""
_CELLS = f"""WITH x AS (SELECT l_linestatus AS ticker, feature, v::FLOAT::DOUBLE AS v, c FROM (
  {" UNION ALL ".join(f"SELECT l_linestatus, '{n}' AS feature, {v} AS v, {c.replace('0D', '0').replace('9000.0', '9000.0::DOUBLE')} AS c FROM lineitem" for n, v, c in _CONTRIBUTIONS)})),
st AS (SELECT ticker, feature, avg(v) AS mu, stddev_pop(v) AS sigma FROM x GROUP BY ALL),
z AS (SELECT x.*, CASE WHEN sigma > 0 THEN (v - mu) / sigma ELSE 0 END AS z, sigma > 0 AND v IS NULL AS gone FROM x JOIN st USING (ticker, feature)),
own AS (SELECT ticker, feature, CASE WHEN gone THEN 25 ELSE len([e FOR e IN range(-12, 13) IF (e / 4.0)::FLOAT <= z::FLOAT]) END::INT AS cell, count(*) AS n, avg(c) AS mean, avg(abs(c)) AS abs_mean FROM z GROUP BY ALL),
cells AS (SELECT ticker, feature, i::INT AS cell, CASE WHEN i > 0 THEN (i - 13) / 4.0::DOUBLE END AS lo, CASE WHEN i < 25 THEN (i - 12) / 4.0::DOUBLE END AS hi, coalesce(n, 0) AS n, mean, abs_mean FROM (SELECT DISTINCT ticker, feature FROM x) CROSS JOIN range(26) r(i) LEFT JOIN (SELECT *, cell AS i FROM own) USING (ticker, feature, i))"""
_MODE = "CASE WHEN trade_floor_met = 0 THEN 'TRAIN_OOF_FLOOR_NOT_MET' WHEN model_trades = 0 THEN 'HODL_FALLBACK_NO_MODEL_TRADES' WHEN model_trades = 1 THEN 'ML_ONE_TRADE_LOW_EVIDENCE' ELSE 'ML_MULTI_TRADE' END"
_VARIANTS = """v AS (SELECT p_brand AS family, p_partkey AS id, floor(p_retailprice) % 97 / 1000.0 AS mean, 'rolling_mean(c,' || p_size || ')/c-1' AS formula, p_size,
  [floor(p_retailprice) % 97 / 1000.0 - 0.01, floor(p_retailprice) % 97 / 1000.0 + 0.02, floor(p_retailprice) % 97 / 1000.0 - 0.005 * (p_size % 3)] AS folds FROM part),
s AS (SELECT *, list_aggregate(folds, 'stddev_samp') / sqrt(3) AS own, row_number() OVER (PARTITION BY family ORDER BY mean DESC, id) AS r FROM v),
b AS (SELECT s.family, s.id, s.mean, t.id AS best, t.mean AS best_mean, t.own AS se, s.mean >= t.mean - t.own AS in_plateau, greatest(s.p_size, 1) AS history, length(s.formula) AS size FROM s JOIN s t ON t.family = s.family AND t.r = 1),
o AS (SELECT family, id, mean, best, best_mean, se, in_plateau, in_plateau AND row_number() OVER (PARTITION BY family, in_plateau ORDER BY history, size, id) = 1 AS representative FROM b)"""

QUERIES = {n: globals()[n] for n in (
    "console_overview console_payoff console_basket console_overlap console_trade_buckets console_return_histogram console_result_rows console_mode_counts console_coverage console_health first_result_rows integrity_checks drawn_basket ledger_head result_upsert feature_contributions "
    "feature_tooltips table_profile return_correlations filter_cascade sample_cascade nearest_rank_quantiles sample_digest ledger_chain ledger_latest entry_bins entry_segments split_harvest feature_quantiles trajectory_bands interval_overlap "
    "rank_correlation fold_ranking shap_sign_flips contribution_cells contribution_features sigma_bounds segment_outcomes uncorrelated_sample five_significant_digits rotation_acceptance one_se_representatives search_pool_order search_stage_pool null_exceedance wilson_interval time_blocks macro_segments block_permutation segment_permutation permutation_draw family_matrix transfer_prior"
).split()}

ORACLES = {
    "console_overview": f"""WITH {RESULTS} SELECT model, count(*) AS assets, round(median(return_pct), 6) + 0.0 AS median_return, round(median(hodl_return_pct), 6) + 0.0 AS median_hodl,
      round(median(profit_factor) FILTER (model_trades >= 2), 6) AS median_pf, count(profit_factor) FILTER (model_trades >= 2) AS pf_assets, sum(beats_hodl)::BIGINT AS beats, round(avg(beats_hodl), 6) AS beats_share, sum(trades)::BIGINT AS trades FROM results GROUP BY model""",
    "console_payoff": f"""WITH {RESULTS}, p AS (SELECT model, profit_factor * losses / wins AS payoff FROM results WHERE profit_factor IS NOT NULL AND wins > 0 AND losses > 0)
      SELECT model, round(median(payoff), 6) AS median_payoff, count(*) AS n, round(avg((payoff >= 2)::INT), 6) AS share_2 FROM p GROUP BY model""",
    "console_basket": f"""WITH {RESULTS}, b AS (SELECT *, model_trades > 0 AND trade_floor_met = 1 AS ml FROM results WHERE model = 'xgb' AND ticker IN (SELECT ticker FROM results WHERE model_trades > 20))
      SELECT count(*) AS assets, round(sum(1000 * (1 + return_pct / 100)), 6) AS executed_usd, count(*) FILTER (ml) AS ml_assets, round(sum(1000 * (1 + return_pct / 100)) FILTER (ml), 6) AS ml_usd,
        round(sum(1000 * (1 + hodl_return_pct / 100)), 6) AS hodl_usd, count(*) FILTER (ml AND return_pct > 0) AS ml_winners FROM b""",
    "console_overlap": f"""WITH {RESULTS}, t AS (SELECT ticker, model, return_pct > 0 AS w FROM results WHERE model_trades > 0 AND trade_floor_met = 1),
      j AS (SELECT a.w AS l, b.w AS r FROM t a JOIN t b ON a.ticker = b.ticker AND a.model = 'xgb' AND b.model = 'lstm'),
      c AS (SELECT count(*) AS "both", count(*) FILTER (l AND r) AS both_win, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (NOT l AND r) AS right_only, count(*) FILTER (NOT l AND NOT r) AS neither FROM j)
      SELECT *, round_even(100.0 * (both_win + neither) / "both", 1)::DOUBLE AS agree_pct, CASE WHEN both_win * 2 > "both" THEN 'above the 50 % line' WHEN both_win * 2 < "both" THEN 'below the 50 % line' ELSE 'on the 50 % line' END AS note FROM c""",
    "console_trade_buckets": f"""WITH {RESULTS} SELECT model, CASE WHEN model_trades = 0 THEN '0' WHEN model_trades = 1 THEN '1' WHEN model_trades <= 10 THEN '2-10' WHEN model_trades <= 50 THEN '11-50' WHEN model_trades <= 200 THEN '51-200' ELSE '200+' END AS bucket, count(*) AS n FROM results GROUP BY ALL""",
    "console_return_histogram": f"""WITH {RESULTS} SELECT model, least(floor((least(greatest(return_pct, -100.0), 300.0) - -100.0) / ((300.0 - -100.0) / 60)), 59)::INT AS bin, count(*) AS n FROM results GROUP BY ALL""",
    "console_result_rows": f"WITH {RESULTS} SELECT ticker, {_MODE} AS result_mode, return_pct + 0.0 AS return_pct, hodl_return_pct + 0.0 AS hodl_return_pct, model_trades FROM results WHERE model = 'xgb' AND hodl_return_pct IS NOT NULL",
    "console_mode_counts": f"WITH {RESULTS} SELECT model, {_MODE} AS result_mode, count(*) AS n FROM results GROUP BY ALL",
    "console_coverage": f"""WITH {RESULTS}, t AS (SELECT ticker, count(*) FILTER (model = 'xgb') AS x, count(*) FILTER (model = 'lstm') AS l FROM results WHERE model_trades > 0 GROUP BY ticker)
      SELECT CASE WHEN x > 0 AND l > 0 THEN 'both' WHEN x > 0 THEN 'xgb_only' ELSE 'lstm_only' END AS side, count(*) AS n FROM t GROUP BY ALL""",
    "console_health": """WITH c AS (SELECT c_nationkey AS store, count(*) AS assets, count(*) FILTER (c_acctbal < -950) AS failed FROM customer GROUP BY 1)
      SELECT store, assets, CASE WHEN store % 7 = 0 THEN 'NOT FOUND' WHEN store % 5 = 1 THEN 'SCHEMA MISMATCH' WHEN failed > 0 THEN 'INTEGRITY FAILED' WHEN store % 4 = 2 OR store % 6 = 5 THEN 'PARTIAL' ELSE 'OK' END AS state FROM c""",
    "first_result_rows": f"WITH {RESULTS} SELECT ticker, model, round(-return_pct, 6) + 0.0 AS loss_pct FROM results QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY return_pct DESC, model) = 1",
    "integrity_checks": """WITH c AS (SELECT 'nation-' || c_nationkey AS check_name, CASE WHEN min(c_acctbal) < -900 THEN 'FAIL' ELSE 'PASS' END AS status FROM customer GROUP BY 1)
      SELECT check_name, status, row_number() OVER (ORDER BY check_name)::INT AS place, sum((status = 'PASS')::INT) OVER ()::BIGINT AS passed, count(*) OVER () AS total FROM c""",
    "drawn_basket": f"WITH {RESULTS} SELECT ticker FROM (SELECT DISTINCT ticker FROM results) ORDER BY md5('11-' || ticker), ticker LIMIT (SELECT 5 + ('0x' || left(md5('11'), 8))::BIGINT % 11)",
    "ledger_head": "SELECT o_orderpriority AS ticker, o_orderkey AS trade_id, o_orderstatus, row_number() OVER w::INT AS place, greatest(0, count(*) OVER (PARTITION BY o_orderpriority) - 50) AS more FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey) QUALIFY place <= 50",
    "result_upsert": f"""WITH {RESULTS} SELECT ticker, model, CASE WHEN model = 'xgb' AND ticker LIKE 'T1%' THEN 0.0 ELSE return_pct + 0.0 END AS return_pct, CASE WHEN model = 'xgb' AND ticker LIKE 'T1%' THEN 'rerun' END AS note FROM results""",
    "feature_contributions": """WITH g AS (SELECT p_brand AS ticker, substr(p_type, 1, 3) AS family, p_type AS feature, sum(p_retailprice) AS gain FROM part GROUP BY ALL),
      s AS (SELECT *, gain / sum(gain) OVER (PARTITION BY ticker) AS share FROM g)
      SELECT ticker, family, feature, round(share, 6) AS share, round(sum(share) OVER (PARTITION BY ticker, family), 6) AS family_share, row_number() OVER (PARTITION BY ticker ORDER BY share DESC, feature)::INT AS rank FROM s""",
    "feature_tooltips": "SELECT p_brand AS family, string_agg(p_partkey || ':' || p_name, ',' ORDER BY p_partkey) AS members, count(*) AS n FROM part GROUP BY p_brand",
    "table_profile": f"""WITH {S.BARS_1H}, l AS (SELECT *, (epoch(ts) - epoch(lag(ts) OVER w)) / 3600 AS gap, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY idx)),
      p AS (SELECT ticker, count(*) AS bars, count(DISTINCT close) AS distinct_close, count(*) FILTER (volume = 0) AS zero_volume, count(*) FILTER (high = low) AS flat, count(*) FILTER (gap > 1) AS gaps, max(gap)::BIGINT AS max_gap_hours,
        max(abs(r)) AS max_abs_return, count(*) FILTER (abs(r) > 0.35) AS violent, stddev_samp(r) AS volatility, median(close * volume) AS median_turnover, min(close) AS min_close, max(close) AS max_close FROM l GROUP BY ticker),
      q AS (SELECT *, bars / max(bars) OVER () AS coverage, flat / bars AS flat_share, distinct_close / bars AS resolution FROM p)
      SELECT ticker, bars, distinct_close, zero_volume, flat, gaps, max_gap_hours, violent, {S.rounded(PROFILE)} FROM q""",
    "return_correlations": f"""WITH {S.BARS_1H}, r AS (SELECT ticker, ts, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY idx)) AS r FROM bars)
      SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, round(corr(a.r, b.r), 6) + 0.0 AS corr FROM r a JOIN r b ON a.ts = b.ts AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL HAVING count(*) > 100""",
    "filter_cascade": cascade_sql(S.BARS_1H.replace("event_type", "concat(event_type, '-', user_id % 11)"), coverage="coverage >= 0.7", max_abs_return="max_abs_return <= 6", violent="violent <= bars * 0.97", flat_share="flat_share <= 0.99", max_gap_hours="max_gap_hours <= 60"),
    "sample_cascade": cascade_sql(S.BARS_1D.replace("l_returnflag", "p_brand").replace("FROM lineitem WHERE", "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE")),
    "nearest_rank_quantiles": f"""WITH {S.BARS_1H}, s AS (SELECT ticker, list_sort(list(close)) AS c FROM bars GROUP BY ticker)
      SELECT ticker, round(c[round_even(0.1 * (len(c) - 1), 0)::INT + 1], 6) AS p10, round(c[round_even(0.5 * (len(c) - 1), 0)::INT + 1], 6) AS p50, round(c[round_even(0.9 * (len(c) - 1), 0)::INT + 1], 6) AS p90 FROM s""",
    "sample_digest": "SELECT sha256(string_agg(t, chr(10) ORDER BY t)) AS digest FROM (SELECT DISTINCT event_type AS t FROM events WHERE value > 0)",
    "ledger_chain": """WITH RECURSIVE n AS (SELECT n_nationkey::BIGINT AS seq, n_name AS body FROM nation), c AS (
      SELECT seq, body, '' AS prev, sha256(body) AS checksum FROM n WHERE seq = 0 UNION ALL SELECT n.seq, n.body, c.checksum, sha256(c.checksum || n.body) FROM c JOIN n ON n.seq = c.seq + 1) SELECT * FROM c""",
    "ledger_latest": "SELECT o_custkey AS unit, arg_max(o_orderpriority, o_orderkey) AS body, max(o_orderkey) AS seq FROM orders GROUP BY o_custkey",
    "entry_bins": f"WITH {_BINS} SELECT bin, n, n_entry, round(rate, 6) AS rate, round(lift, 6) AS lift FROM stats",
    "entry_segments": f"""WITH {_BINS}, e AS (SELECT i::INT AS bin, n, n_entry, CASE WHEN n IS NULL THEN NULL WHEN lift >= 1.0 THEN 'hot' ELSE 'cold' END AS c FROM range(0, {len(EDGES) + 1}) r(i) LEFT JOIN stats ON bin = i),
      f AS (SELECT *, last_value(c IGNORE NULLS) OVER (ORDER BY bin) AS k FROM e), g AS (SELECT *, sum(CASE WHEN k IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (ORDER BY bin) AS run FROM (SELECT *, lag(k) OVER (ORDER BY bin) AS p FROM f WHERE k IS NOT NULL)),
      r AS (SELECT min(bin) AS lo_bin, max(bin) AS hi_bin, min(k) AS class, sum(n)::BIGINT AS n, sum(n_entry)::BIGINT AS n_entry FROM g GROUP BY run),
      t AS (SELECT *, n_entry / n AS share, (n_entry / n) / (sum(n_entry) OVER () / sum(n) OVER ()) AS lift FROM r)
      SELECT lo_bin, hi_bin, class, n, n_entry, round(share, 6) + 0.0 AS entry_share, round(lift, 6) + 0.0 AS entry_lift, lift >= 1.0 AND n_entry >= 10 AS candidate_region, n_entry < 10 AS low_evidence FROM t WHERE n >= 20""",
    "split_harvest": """WITH t AS (SELECT p_brand AS feature, p_size::DOUBLE AS split, p_retailprice AS gain FROM part WHERE p_size <= 45), g AS (
      SELECT feature, count(DISTINCT split)::INT AS n_thresholds, min(split) AS lowest, max(split) AS highest, count(*) AS n_splits, sum(gain) AS gain FROM t GROUP BY feature)
      SELECT feature, n_thresholds, lowest, highest, n_splits, round(gain, 6) AS gain, round(gain / sum(gain) OVER (), 6) AS gain_share FROM g""",
    "feature_quantiles": f"{S.core_features(S.BARS_1H)} SELECT ticker, count(rsi_14) AS n, round(quantile_cont(rsi_14, 0.1), 6) AS q10, round(quantile_cont(rsi_14, 0.5), 6) AS q50, round(quantile_cont(rsi_14, 0.9), 6) AS q90 FROM core GROUP BY ticker",
    "trajectory_bands": f"""{S.core_features(S.BARS_1H)}, ok AS (SELECT ticker, idx, direction, count(CASE WHEN log_return_5 IS NOT NULL AND rsi_14 IS NOT NULL THEN 1 END) OVER (PARTITION BY ticker ORDER BY idx ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS n FROM core),
      st AS (SELECT CASE WHEN o.direction > 0 THEN 'entry' ELSE 'rest' END AS "group", (c.idx - o.idx + 11)::INT AS step, c.log_return_5::FLOAT::DOUBLE AS a, c.rsi_14::FLOAT::DOUBLE AS b FROM ok o JOIN core c ON c.ticker = o.ticker AND c.idx BETWEEN o.idx - 11 AND o.idx WHERE n = 12)
      SELECT "group", f::INT AS feature, step, count(*) AS n, round(avg(v), 4) + 0.0 AS mean, round(stddev_pop(v), 4) + 0.0 AS dev FROM (SELECT "group", step, 0 AS f, a AS v FROM st UNION ALL SELECT "group", step, 1, b FROM st) GROUP BY ALL""",
    "interval_overlap": """WITH s AS (SELECT DISTINCT l_orderkey AS key, l_linenumber % 2 AS side, unnest(range(l_quantity::INT, (l_quantity + 3 + l_linenumber)::INT)) AS u FROM lineitem),
      c AS (SELECT key, u, count(*) AS k FROM s GROUP BY ALL) SELECT key, round(count(*) FILTER (k = 2) / count(*), 6) AS jaccard FROM c GROUP BY key""",
    "rank_correlation": """WITH a AS (SELECT p_brand AS key, avg(p_retailprice) AS a, avg(p_size) AS b FROM part GROUP BY ALL), r AS (SELECT row_number() OVER (ORDER BY a DESC, key) - row_number() OVER (ORDER BY b DESC, key) AS d FROM a)
      SELECT count(*) AS n, round(1 - 6 * sum(d * d) / (count(*) * (count(*) * count(*) - 1)), 6) AS rho FROM r""",
    "fold_ranking": """WITH m AS (SELECT p_brand AS feature, p_partkey % 4 AS fold, avg(abs(p_retailprice - 1400)) AS m FROM part GROUP BY ALL), s AS (SELECT feature, avg(m) AS score, count(*) AS folds FROM m GROUP BY feature)
      SELECT feature, round(score, 6) AS score, folds, row_number() OVER (ORDER BY score DESC, feature)::INT AS rank FROM s""",
    "shap_sign_flips": """WITH g AS (SELECT l_linestatus AS feature, floor(l_quantity / 2) AS cell, avg(l_discount) - 0.05 AS mean, count(*) AS n FROM lineitem GROUP BY ALL),
      f AS (SELECT feature, CASE WHEN sign(mean) * lag(sign(mean)) OVER (PARTITION BY feature ORDER BY cell) < 0 THEN 1 ELSE 0 END AS flip FROM g WHERE n >= 25 AND mean <> 0) SELECT feature, sum(flip)::BIGINT AS flips, sum(flip) >= 2 AS reversal FROM f GROUP BY feature""",
    "contribution_cells": f"""{_CELLS} SELECT ticker, feature, cell, lo, hi, n, round(mean, 6) + 0.0 AS mean, round(abs_mean, 6) + 0.0 AS abs_mean, n < 25 AS thin FROM cells""",
    "contribution_features": f"""{_CELLS}, s AS (SELECT ticker, feature, sign(round(mean, 8)) * lag(sign(round(mean, 8))) OVER (PARTITION BY ticker, feature ORDER BY cell) < 0 AS flip FROM cells WHERE n >= 25 AND round(mean, 8) <> 0),
      f AS (SELECT ticker, feature, count(*) FILTER (flip) AS flips FROM s GROUP BY ALL), m AS (SELECT ticker, feature, avg(abs(c)) AS m, bool_or(c <> 0) AS used, avg(v) AS mu, stddev_pop(v) AS sigma FROM x GROUP BY ALL)
      SELECT ticker, feature, row_number() OVER (PARTITION BY ticker ORDER BY m DESC, feature)::INT AS rank, round(m, 6) + 0.0 AS mean_abs, round(m / sum(m) OVER (PARTITION BY ticker), 6) + 0.0 AS share, used, round(mu, 6) + 0.0 AS mu, round(sigma, 6) + 0.0 AS sigma, coalesce(flips, 0) AS flips, coalesce(flips, 0) >= 2 AS reversal FROM m LEFT JOIN f USING (ticker, feature)""",
    "sigma_bounds": """WITH s AS (SELECT p_brand, avg(p_retailprice) AS mu, CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE stddev_pop(p_retailprice) END AS sigma FROM part GROUP BY p_brand)
      SELECT p_partkey, CASE WHEN sigma > 0 AND p_size >= 5 THEN printf('%.4e', (p_retailprice - p_size - mu) / sigma)::DOUBLE + 0.0 END AS lo, CASE WHEN sigma > 0 AND p_size <= 45 THEN printf('%.4e', (p_retailprice + p_size - mu) / sigma)::DOUBLE + 0.0 END AS hi FROM part JOIN s USING (p_brand)""",
    "segment_outcomes": f"""WITH {_BINS.replace("l_returnflag = 'R'", "l_returnflag = 'R' AND l_extendedprice % 25000 > 12000")}, tp AS (SELECT len(list_filter({EDGES}, lambda e: e::FLOAT <= (l_extendedprice / 10000)::FLOAT))::INT AS bin, count(*) FILTER (l_returnflag = 'R' AND l_extendedprice % 25000 > 12000 AND l_discount > 0.06) AS tp, (SELECT avg((l_discount > 0.06)::INT) FROM lineitem) AS base FROM lineitem GROUP BY 1),
      e AS (SELECT i::INT AS bin, n, n_entry, CASE WHEN n IS NULL THEN NULL WHEN lift >= 1.25 THEN 'hot' ELSE 'cold' END AS c FROM range(0, {len(EDGES) + 1}) r(i) LEFT JOIN stats ON bin = i),
      f AS (SELECT *, last_value(c IGNORE NULLS) OVER (ORDER BY bin) AS k FROM e), g AS (SELECT *, sum(CASE WHEN k IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (ORDER BY bin) AS run FROM (SELECT *, lag(k) OVER (ORDER BY bin) AS p FROM f WHERE k IS NOT NULL)),
      r AS (SELECT min(bin) AS lo_bin, max(bin) AS hi_bin, min(k) AS class, sum(n)::BIGINT AS n, sum(n_entry)::BIGINT AS n_entry, coalesce(sum(tp), 0)::BIGINT AS tp_events, max(base) AS base FROM g LEFT JOIN tp USING (bin) GROUP BY run),
      t AS (SELECT *, n_entry / n AS share, (n_entry / n) / (sum(n_entry) OVER () / sum(n) OVER ()) AS lift FROM r)
      SELECT lo_bin, hi_bin, class, n, n_entry, printf('%.4e', share)::DOUBLE + 0.0 AS entry_share, printf('%.4e', lift)::DOUBLE + 0.0 AS entry_lift, lift >= 1.25 AND n_entry >= 10 AS candidate_region, n_entry < 10 AS low_evidence, tp_events, CASE WHEN n_entry > 0 THEN printf('%.4e', tp_events / n_entry)::DOUBLE + 0.0 END AS tp_rate, CASE WHEN n_entry > 0 THEN printf('%.4e', tp_events / n_entry / base)::DOUBLE + 0.0 END AS tp_lift FROM t WHERE n >= 20""",
    "uncorrelated_sample": f"""WITH RECURSIVE {S.BARS_1H}, y AS (SELECT ticker || '-' || half AS ticker, ts, idx, CASE WHEN half = 'b' THEN close * 2 + idx % 3 * 0.01 ELSE close END AS close FROM bars, (SELECT unnest(['a', 'b']) AS half)),
      r AS (SELECT ticker, ts, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY idx)) AS r FROM y),
      c AS (SELECT a.ticker AS a, b.ticker AS b FROM r a JOIN r b ON a.ts = b.ts AND a.ticker <> b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL HAVING count(*) > 20 AND corr(a.r, b.r) > 0.95),
      t AS (SELECT ticker, row_number() OVER (ORDER BY count(*) DESC, ticker)::INT AS place FROM y GROUP BY ticker), n AS (SELECT t.*, (SELECT list(b) FROM c WHERE a = ticker) AS near FROM t),
      w AS (SELECT 0 AS place, NULL::VARCHAR AS ticker, []::VARCHAR[] AS taken, NULL::VARCHAR AS duplicate_of, false AS picked
        UNION ALL SELECT place, ticker, CASE WHEN open AND clash IS NULL THEN list_append(taken, ticker) ELSE taken END, CASE WHEN open THEN clash END, open AND clash IS NULL FROM (
          SELECT n.place, n.ticker, w.taken, len(w.taken) < 4 AS open, [x FOR x IN w.taken IF list_contains(coalesce(n.near, []), x)][1] AS clash FROM w JOIN n ON n.place = w.place + 1))
      SELECT ticker, place, duplicate_of, picked FROM w WHERE place > 0""",
    "five_significant_digits": "SELECT p_partkey, printf('%.4e', p_retailprice / 7)::DOUBLE AS v FROM part",
    "rotation_acceptance": f"""WITH r AS (SELECT {_ROT} FROM orders),
      u AS (SELECT ticker, outer_fold, arm, CASE WHEN arm = 'flat' THEN 'feature:' || picked ELSE 'family:' || family END AS unit, count(*) AS n, sum((confirm_delta > 0)::INT)::BIGINT AS wins, median(confirm_delta) AS med, min(rotation) AS first FROM r WHERE confirm_delta IS NOT NULL GROUP BY ALL),
      e AS (SELECT *, n >= 2 AND wins / n > 0.5 AS ok FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, outer_fold, arm, ok ORDER BY med DESC, first, unit) AS place FROM e)
      SELECT ticker, outer_fold, arm, count(*) AS units, count(*) FILTER (ok) AS units_eligible, max(unit) FILTER (ok AND place = 1) AS unit, coalesce(max(n) FILTER (ok AND place = 1), 0) AS rotations, coalesce(max(wins) FILTER (ok AND place = 1), 0) AS wins,
        max(unit) FILTER (ok AND place = 1 AND med - 0.004 > 0) AS accepted, round(coalesce(max(med) FILTER (ok AND place = 1) - 0.004, 0), 6) + 0.0 AS statistic FROM k GROUP BY ALL""",
    "one_se_representatives": f"WITH {_VARIANTS} SELECT family, id, round(mean, 6) AS mean, best, round(best_mean, 6) AS best_mean, round(se, 6) AS se, in_plateau, representative FROM o",
    "search_pool_order": f"WITH {_VARIANTS} SELECT family, id, representative, row_number() OVER (ORDER BY NOT representative, CASE WHEN representative THEN best_mean ELSE mean END DESC, id)::INT AS place FROM o",
    "search_stage_pool": f"""WITH {_VARIANTS} SELECT family, id, 1 AS stage, row_number() OVER (ORDER BY best_mean DESC, id)::INT AS place FROM o WHERE representative
      UNION ALL SELECT family, id, 2, row_number() OVER (PARTITION BY family ORDER BY mean DESC, id)::INT FROM o WHERE NOT representative""",
    "null_exceedance": f"""WITH x AS (SELECT o_orderpriority AS ticker, o_orderkey % 50 AS permutation, o_totalprice FROM orders),
      n AS (SELECT ticker, permutation, max(o_totalprice) AS t FROM x WHERE NOT (ticker LIKE '5%' AND permutation = 30) GROUP BY ALL), s AS (SELECT ticker, max(o_totalprice) * CASE WHEN ticker < '3' THEN 0.9 ELSE 0.999 END AS statistic FROM x GROUP BY ticker),
      {verdict_sql(["ticker"])}""",
    "wilson_interval": """WITH x AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n, 1.96 AS z FROM orders GROUP BY 1), y AS (SELECT *, k / n AS p, 1 + z * z / n AS d FROM x)
      SELECT o_orderpriority, k, n, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / d, 6) AS lo, round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / d, 6) AS hi FROM y""",
    "time_blocks": f"{blocks_sql(_ONE)} SELECT ticker, t0, block, pos FROM blk",
    "macro_segments": f"{_BASE} {_SEG}",
    "block_permutation": f"{orders_sql(_ONE)} SELECT * FROM moved",
    "segment_permutation": f"{orders_sql(_SEG)} SELECT * FROM moved",
    "permutation_draw": f"{orders_sql(_SEG)} SELECT ticker, draw, displaced, n_blocks, segments, index_hash FROM drawn",
    "family_matrix": f"{_MATRIX} SELECT * FROM m",
    "transfer_prior": f"""{_MATRIX}, c AS (SELECT *, list_position(['universal', 'conditional', 'asset_specific', 'screening_only', 'unconfirmed'], classification) AS k FROM m)
      SELECT row_number() OVER (ORDER BY k, n_confirmed DESC, recurrence DESC, family)::INT AS place, family, classification FROM c""",
}
