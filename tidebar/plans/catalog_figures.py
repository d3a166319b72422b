"""Queries of canonical JSON, recipe hashes and stated figures, on inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions import canonical as J
from tidebar.operators import figures as G
from tidebar.plans.catalog_analysis import RESULTS, results
from tidebar.sources import bars as B


def _payload(spark, d):
    """Parts as payloads: a text with quotes and letters beyond ASCII, numbers of all sizes, a list, an object."""
    p = B.read(spark, d, "part").repartition("p_partkey")  # a small file is one task, and the JSON is work for many
    tiny = F.expr("CASE p_size % 5 WHEN 0 THEN double('NaN') WHEN 1 THEN double('-Infinity') WHEN 2 THEN -0.0D WHEN 3 THEN p_retailprice * 1e18D ELSE p_retailprice / 3e9D END")
    x = p.select("p_partkey", F.struct(F.col("p_size").alias("size"), F.concat(F.lit('"ß\\'), "p_name").alias("name"), F.col("p_retailprice").alias("Price"), tiny.alias("edge"), F.array(F.col("p_retailprice") / 7, F.lit(None)).alias("list"), F.struct((F.col("p_size") > 20).alias("large"), F.lit(None).cast("int").alias("none")).alias("flags")).alias("payload"))
    return x, x.schema["payload"].dataType


def payload_hashes(spark, d):
    x, kind = _payload(spark, d)
    return x.select("p_partkey", J.canonical(F.col("payload"), kind).alias("json")).withColumn("sha256", F.sha2("json", 256))  # the JSON is made once


def recipe_hashes(spark, d):
    """The identity of a search for each brand: its candidates, their names and formulas, and the knobs."""
    feature = F.struct(F.col("p_partkey").alias("_1"), F.col("p_name").alias("_2"), F.concat(F.lit("mean(c, "), F.col("p_size").cast("string"), F.lit(")")).alias("_3"))
    knobs = F.struct(F.lit(30).alias("_1"), F.lit(0.005).alias("_2"), F.lit(6).alias("_3"))
    x = B.read(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("cands"), F.array_sort(F.collect_list(feature)).alias("feats"))
    x = x.select("p_brand", F.struct("cands", "feats", knobs.alias("knobs"), F.lit("golden").alias("search_policy")).alias("recipe"))
    return x.select("p_brand", J.recipe_hash(F.col("recipe"), x.schema["recipe"].dataType).alias("recipe_hash"))


def _figures(spark, d):
    """Each store's figures, and a report of each that words them in a style of its own; every fifth was written before the last rows came."""
    r = results(spark, d).withColumn("store", F.expr("cast(substring(ticker, 2) AS bigint) % 40"))
    x = r.groupBy("store").agg(F.sum("model_trades").cast("long").alias("trades"), F.median("return_pct").alias("median"), F.sum("beats_hodl").cast("long").alias("beats"), F.count(F.lit(1)).alias("n"))
    x = x.withColumn("file", F.concat(F.lit("report-"), F.col("store").cast("string")))
    percent = G.signed_percent(F.col("median") + F.when(F.col("store") % 5 == 4, 0.5).otherwise(0.0))
    styled = F.when(F.col("store") % 3 == 0, F.replace(F.replace(percent, F.lit("-"), F.lit("−")), F.lit("%"), F.lit(" %"))).otherwise(percent)
    text = F.concat(F.lit("Sealed in 2024: "), G.spaced(F.col("trades")), F.lit(" trades, a median return of "), styled, F.lit("; "), F.col("beats").cast("string"), F.when(F.col("store") % 2 == 0, " / ").otherwise("/"), F.col("n").cast("string"), F.lit(" beat holding."))
    figure = lambda name, c: x.select("file", F.lit(name).alias("name"), c.alias("expected"))
    figures = figure("trades", G.spaced(F.col("trades"))).unionByName(figure("median return", G.signed_percent(F.col("median")))).unionByName(figure("beats", F.concat(F.col("beats").cast("string"), F.lit("/"), F.col("n").cast("string")))).unionByName(figure("rows alone", F.col("n").cast("string")))
    return x, figures, x.select("file", text.alias("text"))


def figure_verification(spark, d):
    _, figures, prose = _figures(spark, d)
    return G.verified(figures, prose)


def restated_figures(spark, d):
    """The number of each report that gives the median return, whatever its style."""
    x, _, prose = _figures(spark, d)
    y = G.restated(x.select("file", F.lit("median return").alias("name"), F.round("median", 6).alias("value")), prose)
    return y.withColumn("value", F.round("value", 6) + 0.0)


_JSON = """SELECT p_partkey, '{"Price":' || p_retailprice::VARCHAR || ',"edge":' || CASE p_size % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"-inf"' WHEN 2 THEN '0.0' WHEN 3 THEN (p_retailprice * 1e18)::VARCHAR ELSE (p_retailprice / 3e9)::VARCHAR END
  || ',"flags":{"large":' || CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END || ',"none":null},"list":[' || (p_retailprice / 7)::VARCHAR || ',null],"name":"\\"\\u00df\\\\' || p_name || '","size":' || p_size || '}' AS json FROM part"""
_REPORTS = f"""WITH {RESULTS}, x AS (SELECT substr(ticker, 2)::BIGINT % 40 AS store, sum(model_trades)::BIGINT AS trades, median(return_pct) AS med, sum(beats_hodl)::BIGINT AS beats, count(*) AS n FROM results GROUP BY 1),
s AS (SELECT *, 'report-' || store AS file, trim(replace(format('{{:,}}', trades), ',', ' ')) AS spaced, printf('%+.2f%%', med) AS pct, printf('%+.2f%%', med + CASE WHEN store % 5 = 4 THEN 0.5 ELSE 0 END) AS said FROM x),
t AS (SELECT *, 'Sealed in 2024: ' || spaced || ' trades, a median return of ' || said || '; ' || beats || '/' || n || ' beat holding.' AS text FROM s)"""
_HIT = "regexp_matches(text, '(^|[^0-9])' || regexp_escape({0}) || '([^0-9]|$)')"

ORACLES = {
    "payload_hashes": f"WITH j AS ({_JSON}) SELECT p_partkey, json, sha256(json) AS sha256 FROM j",
    "recipe_hashes": """WITH j AS (SELECT p_brand, '{"cands": [' || string_agg(p_partkey::VARCHAR, ', ' ORDER BY p_partkey) || '], "feats": [' || string_agg('[' || p_partkey || ', "' || p_name || '", "mean(c, ' || p_size || ')"]', ', ' ORDER BY p_partkey)
      || '], "knobs": [30, 0.005, 6], "search_policy": "golden"}' AS json FROM part GROUP BY p_brand) SELECT p_brand, left(sha256(json), 16) AS recipe_hash FROM j""",
    "figure_verification": f"""{_REPORTS} SELECT name, expected, file, {_HIT.format("expected")} AS found FROM (SELECT file, text, unnest(['trades', 'median return', 'beats', 'rows alone']) AS name, unnest([spaced, pct, beats || '/' || n, n::VARCHAR]) AS expected FROM t)""",
    "restated_figures": f"{_REPORTS} SELECT 'median return' AS name, round(med, 6) + 0.0 AS value, file, CASE WHEN store % 5 <> 4 THEN replace(pct, '%', '') END AS stated FROM t",
}

QUERIES = {name: globals()[name] for name in ORACLES}
