"""Queries of cross-fitted selection and of nested outer evaluation, on inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import records
from tidebar.operators import selection as L
from tidebar.operators.search import acceptance, exceedance
from tidebar.plans.catalog_analysis import verdict_sql
from tidebar.plans.catalog_bars import rounded
from tidebar.sources import bars as B
from tidebar.sources import stores

# Line items as scored trades: day of shipping, quantity as score, discount less tax as return. The same expressions for both engines.
_DAY = "CAST(datediff(CAST(l_shipdate AS date), DATE '1992-01-01') AS int)"
_TRADES = ["l_returnflag AS ticker", "cast(l_suppkey % 9 AS int) AS config", f"{_DAY} AS t0", "l_quantity + l_partkey % 7 AS p", "l_discount - l_tax - 0.004 + 0.0004 * (l_suppkey % 9) AS net"]
_SQL_TRADES = ", ".join(_TRADES).replace(_DAY, "datediff('day', DATE '1992-01-01', l_shipdate::DATE)::INT")
#: Quantities that a trade must reach, by level; a later fold's cuts lie a little higher, as if read off its own training rows.
THETAS = (0.2, 0.4, 0.6, 0.8)
SPAN, OUTER, INNER = 2550, 2, 4


def _trades(spark, d):
    return B.read(spark, d, "lineitem").selectExpr(*_TRADES)


def _cut(theta, fold):
    return F.round(theta * 50 + fold * 0.5, 3)


def _splits(spark, d):
    """Inner folds up to where each outer fold's inner part stops, and the outer window (fold null), for every configuration, fold and level."""
    by = _trades(spark, d).select("ticker", "config").distinct()
    fold = F.explode(F.array(*[F.lit(i).cast("int") for i in range(INNER)], F.lit(None).cast("int")))
    x = by.withColumn("outer_fold", F.explode(F.array(*[F.lit(i) for i in range(OUTER)]))).withColumn("fold", fold).withColumn("theta", F.explode(F.array(*[F.lit(t) for t in THETAS])))
    start = F.floor(F.lit(SPAN) * (F.col("outer_fold") + 1) / (OUTER + 1)).cast("int")
    stop = start - 60
    edge = lambda i: F.floor(stop * (i + 1) / (INNER + 1)).cast("int")
    lo = F.coalesce(edge(F.col("fold")), start)
    hi = F.coalesce(edge(F.col("fold") + 1), F.floor(F.lit(SPAN) * (F.col("outer_fold") + 2) / (OUTER + 1)).cast("int"))
    return x.withColumns({"lo": lo, "hi": hi, "cut": _cut(F.col("theta"), F.coalesce("fold", F.lit(INNER)))})


def _grid(spark, d):
    return L.split_grid(_trades(spark, d), _splits(spark, d), ["ticker", "config"])


def split_grid(spark, d):
    """The outer window as fold -1."""
    return rounded(_grid(spark, d).select("ticker", "config", "outer_fold", F.coalesce("fold", F.lit(-1)).alias("fold"), "theta", "growth", "trades"), ["growth"])


def _rotated(spark, d):
    g = _grid(spark, d).where("fold IS NOT NULL").withColumns({
        "candidate": F.when(F.col("config") > 0, F.col("config")), "family": F.concat(F.lit("f"), (F.col("config") % 3).cast("string")), "formula": F.concat(F.lit("rolling_mean(c,"), (F.col("config") * 5).cast("string"), F.lit(")")),
    })
    return L.rotations(stores.kept(g), 20)


def crossfit_rotations(spark, d):
    return rounded(_rotated(spark, d), ["discovery_gain", "confirm_delta"])


def crossfit_acceptance(spark, d):
    return rounded(acceptance(_rotated(spark, d), penalty=0.004), ["statistic"])


def verdict_replay(spark, d):
    """Verdicts that one rotation alone could accept, replayed by the rule of two."""
    x = stores.kept(_rotated(spark, d))
    stored = acceptance(x, penalty=0.0, least=1).select("ticker", "outer_fold", "arm", "accepted")
    return L.verdict_replay(stored, x, penalty=0.02)


_NULL_KEYS = ["kind", "ticker", "outer_fold", "arm"]
_NULL_UNITS = ["CASE l_suppkey % 3 WHEN 0 THEN 'a1' WHEN 1 THEN 'a2' ELSE 'b' END AS kind", "l_returnflag AS ticker", "cast(l_linenumber % 2 AS int) AS outer_fold", "CASE WHEN l_orderkey % 2 = 0 THEN 'flat' ELSE 'hierarchical' END AS arm", "cast(l_partkey % 50 AS int) AS permutation", "l_discount - l_tax - 0.02 AS v"]


def ticker_records(spark, d):
    """From cross-fit to the record: what it accepted, three nulls of it that ran to an end or not, and the ranking score. One ticker has no cross-fit record."""
    rotated = stores.kept(_rotated(spark, d))
    verdicts = acceptance(rotated, penalty=0.0, least=1)
    accepted = verdicts.where("accepted IS NOT NULL").select("ticker", "outer_fold", "arm", "unit", "rotations", "wins", F.col("statistic").alias("median"))
    null = B.read(spark, d, "lineitem").selectExpr(*_NULL_UNITS).where("NOT (kind = 'b' AND ticker = 'N' AND permutation = 20)").groupBy(*_NULL_KEYS, "permutation").agg((F.max("v") / 2).alias("t"))
    observed = accepted.select("ticker", "outer_fold", "arm", F.round("median", 6).alias("statistic")).withColumn("kind", F.explode(F.array(F.lit("a1"), F.lit("a2"), F.lit("b"))))
    nulls = exceedance(null, observed.where("NOT (kind = 'a1' AND ticker = 'R' AND arm = 'flat')"), _NULL_KEYS)
    tickers = B.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("ticker")).agg(F.sum(F.lit(0.5)).alias("seconds")).unionByName(spark.createDataFrame([("Z", None)], "ticker string, seconds double"))
    x = records.ticker_records(tickers, accepted, nulls, rotated, 45)
    p = F.array_join(F.transform("max_null_p", lambda u: F.concat_ws(" ", u["unit"], u["arm"], u["outer_fold"].cast("string"), F.coalesce(F.format_string("%.4f", u["p"]), F.lit("-")))), "; ")
    return rounded(x.withColumn("max_null_p", p).withColumn("selected", F.array_join("selected", ", ")), ["confirmation_win_rate", "outer_delta", "optimism", "j"])


def _arms(grid):
    """core is configuration 0, best_single the best of the odd ones in the first inner fold, greedy the ticker's busiest one; two arms may share one."""
    folds = grid.select("ticker", "outer_fold").distinct()
    single = grid.where("config % 2 = 1 AND fold = 0 AND theta = 0.2").groupBy("ticker", "outer_fold").agg(F.max_by("config", F.struct(F.round("growth", 9), "config")).alias("config"))
    greedy = grid.where("config > 0 AND fold IS NOT NULL AND theta = 0.2").groupBy("ticker", "outer_fold", "config").agg(F.sum("trades").alias("n"))
    greedy = greedy.groupBy("ticker", "outer_fold").agg(F.max_by("config", F.struct("n", "config")).alias("config"))
    arm = lambda x, name, gain: x.select("ticker", "outer_fold", F.lit(name).alias("arm"), "config", gain.alias("inner_gain"))
    none = F.lit(None).cast("double")
    return arm(folds.withColumn("config", F.lit(0)), "core", none).unionByName(arm(single, "best_single", none)).unionByName(arm(greedy, "greedy", F.col("config") / 100))


def outer_evaluation(spark, d):
    g = stores.kept(_grid(spark, d))
    x = L.outer_evaluation(g, stores.kept(_arms(g)), 20)
    return rounded(x, [c for c, kind in x.dtypes if kind == "double"])


def _cuts_sql() -> str:
    return f"""WITH trd AS (SELECT {_SQL_TRADES} FROM lineitem),
cfg AS (SELECT DISTINCT ticker, config FROM trd),
pts AS (SELECT ticker, config, o::INT AS outer_fold, f AS fold, theta, floor({SPAN} * (o + 1) / {OUTER + 1}.0)::INT AS start FROM cfg, range({OUTER}) r(o), (SELECT unnest([{", ".join(map(str, range(INNER)))}, NULL])::INT AS f), (SELECT unnest({list(THETAS)})::DOUBLE AS theta)),
spl AS (SELECT *, CASE WHEN fold IS NULL THEN start ELSE floor((start - 60) * (fold + 1) / {INNER + 1}.0)::INT END AS lo, CASE WHEN fold IS NULL THEN floor({SPAN} * (outer_fold + 2) / {OUTER + 1}.0)::INT ELSE floor((start - 60) * (fold + 2) / {INNER + 1}.0)::INT END AS hi,
  round(theta * 50 + coalesce(fold, {INNER}) * 0.5, 3) AS cut FROM pts),
grid AS (SELECT s.ticker, s.config, s.outer_fold, s.fold, s.theta, coalesce(sum(ln(1 + net)), 0) AS growth, count(net)::INT AS trades FROM spl s LEFT JOIN trd t ON t.ticker = s.ticker AND t.config = s.config AND t0 >= lo AND t0 < hi AND p >= cut GROUP BY ALL)"""


def _point_sql(source: str, keys: str, out: str) -> str:
    """The table `out` (keys, q, lg) of the chosen points from rows (keys, theta, growth, trades) of `source`."""
    return f"""{out}1 AS (SELECT {keys}, theta, sum(growth) AS lg, sum(trades) AS tr, count(*) AS k, coalesce(stddev_samp(growth), 0) / sqrt(count(*)) AS own FROM {source} GROUP BY ALL),
{out}2 AS (SELECT *, bool_or(tr >= 20) OVER (PARTITION BY {keys}) AS met, row_number() OVER (PARTITION BY {keys} ORDER BY tr DESC, lg DESC, theta DESC) AS most, min(theta) OVER (PARTITION BY {keys}) AS t1, max(theta) OVER (PARTITION BY {keys}) AS t2 FROM {out}1),
{out}3 AS (SELECT *, max(lg) OVER (PARTITION BY {keys}) AS top FROM {out}2 WHERE CASE WHEN met THEN tr >= 20 ELSE most = 1 END),
{out}4 AS (SELECT *, arg_max(CASE WHEN lg >= top - 1e-12 THEN own END, CASE WHEN lg >= top - 1e-12 THEN theta END) OVER (PARTITION BY {keys}) AS se FROM {out}3),
{out} AS (SELECT {keys}, theta AS q, lg FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY (theta = t1 OR theta = t2)::INT, theta DESC) AS place FROM {out}4 WHERE lg >= top - se - 1e-12) WHERE place = 1)"""


_TURN = "ticker, outer_fold, rotation"
_ROTATED = f"""{_cuts_sql()}, gi AS (SELECT * FROM grid WHERE fold IS NOT NULL),
dis AS (SELECT g.ticker, g.outer_fold, r.fold AS rotation, g.config, g.fold, g.theta, g.growth, g.trades FROM gi g JOIN (SELECT DISTINCT ticker, outer_fold, fold FROM gi WHERE config = 0) r ON r.ticker = g.ticker AND r.outer_fold = g.outer_fold AND r.fold <> g.fold),
{_point_sql("dis", _TURN + ", config", "pt")},
dd AS (SELECT {_TURN}, config, fold, growth, q, avg(growth) OVER (PARTITION BY {_TURN}, config) AS m FROM dis JOIN pt USING ({_TURN}, config) WHERE theta = q),
cc AS (SELECT p.ticker, p.outer_fold, p.rotation, p.config, g.growth, g.trades FROM pt p JOIN gi g ON g.ticker = p.ticker AND g.outer_fold = p.outer_fold AND g.config = p.config AND g.fold = p.rotation AND g.theta = p.q),
sc AS (SELECT a.ticker, a.outer_fold, a.rotation, a.config AS id, 'f' || a.config % 3 AS family, a.m - b.m AS gain, stddev_samp(a.growth - b.growth) AS dev, count(*) AS k FROM dd a JOIN dd b ON b.ticker = a.ticker AND b.outer_fold = a.outer_fold AND b.rotation = a.rotation AND b.fold = a.fold AND b.config = 0 WHERE a.config > 0 GROUP BY ALL),
dl AS (SELECT sc.*, x.growth - y.growth AS delta, x.trades AS confirm_trades, coalesce(dev, 0) / sqrt(k) AS own FROM sc JOIN cc y ON y.ticker = sc.ticker AND y.outer_fold = sc.outer_fold AND y.rotation = sc.rotation AND y.config = 0 LEFT JOIN cc x ON x.ticker = sc.ticker AND x.outer_fold = sc.outer_fold AND x.rotation = sc.rotation AND x.config = id),
fl AS (SELECT *, row_number() OVER (PARTITION BY {_TURN} ORDER BY gain DESC, id) AS place FROM dl),
fm AS (SELECT *, row_number() OVER (PARTITION BY {_TURN} ORDER BY g DESC, first) AS place FROM (SELECT {_TURN}, family, max(gain) AS g, min(id) AS first FROM dl GROUP BY ALL)),
inn AS (SELECT dl.*, first_value(own) OVER w AS se, max(gain) OVER (PARTITION BY {_TURN.replace("ticker", "dl.ticker").replace("outer_fold", "dl.outer_fold").replace("rotation", "dl.rotation")}) AS best FROM dl JOIN fm ON fm.ticker = dl.ticker AND fm.outer_fold = dl.outer_fold AND fm.rotation = dl.rotation AND fm.family = dl.family AND place = 1
  WINDOW w AS (PARTITION BY dl.ticker, dl.outer_fold, dl.rotation ORDER BY gain DESC, id)),
hi AS (SELECT *, row_number() OVER (PARTITION BY {_TURN} ORDER BY id) AS place FROM inn WHERE gain >= best - se),
rot AS (SELECT {_TURN}, 'flat' AS arm, id AS picked, family, round(gain, 8) AS discovery_gain, round(delta, 8) AS confirm_delta, confirm_trades FROM fl WHERE place = 1
  UNION ALL SELECT {_TURN}, 'hierarchical', id, family, round(gain, 8), round(delta, 8), confirm_trades FROM hi WHERE place = 1)"""


def _accept_sql(name: str, penalty: float, least: int) -> str:
    return f"""{name}u AS (SELECT ticker, outer_fold, arm, CASE WHEN arm = 'flat' THEN 'feature:' || picked ELSE 'family:' || family END AS unit, count(*) AS n, sum((confirm_delta > 0)::INT)::BIGINT AS wins, median(confirm_delta) AS med, min(rotation) AS first FROM rot WHERE confirm_delta IS NOT NULL GROUP BY ALL),
{name}k AS (SELECT *, row_number() OVER (PARTITION BY ticker, outer_fold, arm, ok ORDER BY med DESC, first, unit) AS place FROM (SELECT *, n >= {least} AND wins / n > 0.5 AS ok FROM {name}u)),
{name} AS (SELECT ticker, outer_fold, arm, count(*) AS units, count(*) FILTER (ok) AS units_eligible, max(unit) FILTER (ok AND place = 1) AS unit, coalesce(max(n) FILTER (ok AND place = 1), 0) AS rotations, coalesce(max(wins) FILTER (ok AND place = 1), 0) AS wins,
  max(unit) FILTER (ok AND place = 1 AND med - {penalty} > 0) AS accepted, round(coalesce(max(med) FILTER (ok AND place = 1) - {penalty}, 0), 6) + 0.0 AS statistic FROM {name}k GROUP BY ALL)"""


def _arm_columns(arm: str) -> str:
    return ", ".join(f"round(max({c}) FILTER (arm = '{arm}'), 6) + 0.0 AS {arm}_{n}" for c, n in (("q", "q"), ("lg", "inner"), ("growth", "growth"))) + f", max(trades) FILTER (arm = '{arm}') AS {arm}_trades"


ORACLES = {
    "split_grid": f"{_cuts_sql()} SELECT ticker, config, outer_fold, coalesce(fold, -1) AS fold, theta, round(growth, 6) + 0.0 AS growth, trades FROM grid",
    "crossfit_rotations": f"{_ROTATED} SELECT ticker, outer_fold, rotation, arm, picked, family, round(discovery_gain, 6) + 0.0 AS discovery_gain, round(confirm_delta, 6) + 0.0 AS confirm_delta, confirm_trades FROM rot",
    "crossfit_acceptance": f"{_ROTATED}, {_accept_sql('acc', 0.004, 2)} SELECT * FROM acc",
    "verdict_replay": f"""{_ROTATED}, {_accept_sql("old", 0.0, 1)}, {_accept_sql("new", 0.02, 2)} SELECT ticker, outer_fold, arm, new.unit, old.accepted IS NOT NULL AS accepted_before, new.accepted IS NOT NULL AS accepted_after, (old.accepted IS NOT NULL) <> (new.accepted IS NOT NULL) AS changed
      FROM old FULL JOIN new USING (ticker, outer_fold, arm)""",
    "ticker_records": f"""{_ROTATED}, {_accept_sql("acc", 0.0, 1)}, ac AS (SELECT ticker, outer_fold, arm, unit, round(wins * 1000 / rotations)::BIGINT AS wr, round(statistic, 6) AS delta FROM acc WHERE accepted IS NOT NULL),
n AS (SELECT kind, ticker, outer_fold, arm, permutation, max(v) / 2 AS t FROM (SELECT {", ".join(_NULL_UNITS)} FROM lineitem) WHERE NOT (kind = 'b' AND ticker = 'N' AND permutation = 20) GROUP BY ALL),
s AS (SELECT kind, ticker, outer_fold, arm, delta AS statistic FROM ac, (SELECT unnest(['a1', 'a2', 'b']) AS kind) WHERE NOT (kind = 'a1' AND ticker = 'R' AND arm = 'flat')),
vd AS ({"WITH " + verdict_sql(_NULL_KEYS)}),
wd AS (SELECT ticker, outer_fold, arm, max(verdict) FILTER (kind = 'a1') AS verdict, max(coalesce(p_mc, final_p_lower_bound)) FILTER (kind = 'a1') AS p, max(verdict) FILTER (kind = 'a2') = 'passed' AS a2, max(verdict) FILTER (kind = 'b') = 'passed' AS b FROM vd GROUP BY ALL),
sv AS (SELECT ac.*, verdict, p, CASE WHEN verdict IS NULL THEN 'screening_only' WHEN verdict = 'passed' THEN 'accepted' ELSE 'rejected_by_null' END AS standing, a2 AND b AS stable FROM ac LEFT JOIN wd USING (ticker, outer_fold, arm)),
op AS (SELECT r.ticker, avg(discovery_gain - confirm_delta) AS optimism FROM rot r JOIN sv ON sv.ticker = r.ticker AND sv.outer_fold = r.outer_fold AND sv.arm = r.arm AND sv.unit = CASE WHEN r.arm = 'flat' THEN 'feature:' || picked ELSE 'family:' || family END WHERE standing = 'accepted' AND confirm_delta IS NOT NULL GROUP BY r.ticker),
g AS (SELECT ticker, count(*) FILTER (standing = 'accepted') AS a, count(*) FILTER (standing = 'rejected_by_null') AS rj, count(*) FILTER (standing = 'screening_only') AS sc, count(*) FILTER (standing = 'accepted' AND stable) AS st, min(arm) FILTER (standing = 'accepted') AS mode,
  string_agg(DISTINCT unit, ', ' ORDER BY unit) FILTER (standing = 'accepted') AS units, count(DISTINCT unit) FILTER (standing = 'accepted') AS nu, sum(wr) FILTER (standing = 'accepted') / 1000 / nullif(count(*) FILTER (standing = 'accepted'), 0) AS win, max(delta) FILTER (standing = 'accepted') AS od,
  string_agg(unit || ' ' || arm || ' ' || outer_fold || ' ' || coalesce(printf('%.4f', p), '-'), '; ' ORDER BY unit, arm, outer_fold) FILTER (standing = 'accepted') AS ps FROM sv GROUP BY ticker),
tk AS (SELECT l_returnflag AS ticker, count(*) * 0.5 AS seconds FROM lineitem GROUP BY 1 UNION ALL SELECT 'Z', NULL)
SELECT ticker, CASE WHEN seconds IS NULL THEN 'absent' WHEN st > 0 THEN 'resolved' WHEN a > 0 THEN 'resolved_conditional' ELSE 'resolved_empty' END AS status,
  CASE WHEN seconds IS NULL THEN 'no cross-fit record' WHEN st > 0 THEN 'survived all three nulls' WHEN a > 0 THEN 'passed the primary null, not every sensitivity null' WHEN rj > 0 OR sc > 0 THEN 'no unit exceeded the procedure-level null' ELSE 'cross-fit accepted nothing' END AS stop_reason,
  mode AS selection_mode, coalesce(units, '') AS selected, coalesce(nu, 0)::INT AS n_selected, (45 - coalesce(nu, 0))::INT AS rejected_features, round(win, 3) + 0.0 AS confirmation_win_rate, round(od, 6) + 0.0 AS outer_delta, CASE WHEN a IS NOT NULL THEN coalesce(ps, '') END AS max_null_p,
  coalesce(a, 0) AS n_accepted, coalesce(rj, 0) AS n_rejected_by_null, coalesce(sc, 0) AS n_screening_only, CASE WHEN a > 0 THEN round(coalesce(optimism, 0), 6) + 0.0 END AS optimism, CASE WHEN a > 0 THEN round(od - coalesce(optimism, 0) - 0.5 * (1 - win) - 0.004 * nu - 1e-5 * seconds, 6) + 0.0 END AS j
FROM tk LEFT JOIN g USING (ticker) LEFT JOIN op USING (ticker)""",
    "outer_evaluation": f"""{_cuts_sql()}, gi AS (SELECT * FROM grid WHERE fold IS NOT NULL), {_point_sql("gi", "ticker, outer_fold, config", "pt")},
sg AS (SELECT ticker, outer_fold, arg_max(config, (round(growth, 9), config)) AS config FROM grid WHERE config % 2 = 1 AND fold = 0 AND theta = 0.2 GROUP BY ALL),
gr AS (SELECT ticker, outer_fold, arg_max(config, (n, config)) AS config FROM (SELECT ticker, outer_fold, config, sum(trades) AS n FROM gi WHERE config > 0 AND theta = 0.2 GROUP BY ALL) GROUP BY ALL),
arms AS (SELECT DISTINCT ticker, outer_fold, 'core' AS arm, 0 AS config, NULL::DOUBLE AS inner_gain FROM grid UNION ALL SELECT ticker, outer_fold, 'best_single', config, NULL FROM sg UNION ALL SELECT ticker, outer_fold, 'greedy', config, config / 100 FROM gr),
own AS (SELECT a.*, q, lg, growth, trades FROM arms a LEFT JOIN pt USING (ticker, outer_fold, config) LEFT JOIN (SELECT ticker, outer_fold, config, theta AS q, growth, trades FROM grid WHERE fold IS NULL) o USING (ticker, outer_fold, config, q)),
sw AS (SELECT a.ticker, a.outer_fold, g.growth AS at_core FROM arms a JOIN own c ON c.ticker = a.ticker AND c.outer_fold = a.outer_fold AND c.arm = 'core' JOIN grid g ON g.ticker = a.ticker AND g.outer_fold = a.outer_fold AND g.config = a.config AND g.fold IS NULL AND g.theta = c.q WHERE a.arm = 'greedy'),
w AS (SELECT ticker, outer_fold, {", ".join(map(_arm_columns, L.ARMS))}, max(growth) FILTER (arm = 'greedy') - max(growth) FILTER (arm = 'core') AS dd, max(growth) FILTER (arm = 'core') AS cg, max(inner_gain) AS ig FROM own GROUP BY ALL)
SELECT w.* EXCLUDE (dd, cg, ig), round(dd, 6) + 0.0 AS delta, round(ig - round(dd, 8), 6) + 0.0 AS optimism_gap, dd IS NOT NULL AND (core_trades > 0 OR greedy_trades > 0) AS informative, round(at_core - cg, 6) + 0.0 AS delta_features_only FROM w LEFT JOIN sw USING (ticker, outer_fold)""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
