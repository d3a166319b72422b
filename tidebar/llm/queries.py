"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe_automaton, decontaminate, dual_tree, jaccard_join, radix_dedup, sanitise, secret_crf, substring_dedup, template_extract, tiered_search, token_attribution, toxicity, vector_packing
from tidebar.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_extract.main_texts(table(spark, sf_dir, "pages"))


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  first_value(doc_id) OVER w = doc_id AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""


def held_out(key: Column) -> Column:
    """The fold that no model learns from."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    out = toxicity.toxicity(docs, lexicon)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM d, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


def _span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = secret_crf.secrets(docs, secret_crf.train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "field")
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in secret_crf.KINDS]
    return out.select("doc_id", *counts, F.sha2(_span_list(base), 256).alias("base_sha256"), _span_list(F.col("spans")).alias("spans"))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise.spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in sanitise.PATTERNS]
    return out.select("doc_id", *counts, F.sha2(_span_list(F.col("base")), 256).alias("base_sha256"), _span_list(F.concat("base", "added")).alias("spans"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_attribution.section_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
late AS (
  SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT r, list(DISTINCT p) AS p FROM late, unnest(range(i, i + 13)) AS u(p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
  sha256(array_to_string([x FOR x, i IN w IF p IS NULL OR NOT list_contains(p, i)], ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (
  SELECT row_number() OVER () AS item, item_id,
    list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
corpus AS (SELECT count(*)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
m AS (SELECT doc, doc_id, 100 - 50 + (50 * len(t) * n) // l AS m FROM d, corpus WHERE len(t) > 0),
tf AS (SELECT doc, u.term, count(*)::BIGINT AS tf FROM d, unnest(t) AS u(term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), corpus),
asked AS (SELECT item, item_id, u.term FROM b, unnest(t) AS u(term)),
scores AS (
  SELECT item, item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 50
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.clusters(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(k: int, rounds: int, width: int, scale: int, seed: int) -> str:
    """One pair of tables for each round: who is nearest to whom, and the centroids after it."""
    nearest = "SELECT r, c FROM (SELECT r, c, row_number() OVER (PARTITION BY r ORDER BY sum((v.x - m.x) * (v.x - m.x)), c) AS place FROM v JOIN m{n} AS m USING (i) GROUP BY r, c) WHERE place = 1"
    parts = [
        f"""WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, [floor({scale} * y::DOUBLE)::BIGINT FOR y IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {width} AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y::DOUBLE)]) = {width}),
v AS MATERIALIZED (SELECT r, u.i, x[u.i] AS x FROM kept, unnest(range(1, {width + 1})) AS u(i)),
m0 AS MATERIALIZED (
  SELECT c, i, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS c FROM kept) JOIN v USING (r) WHERE c < {k})"""
    ]
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({nearest.format(n=n)})")
        parts.append(
            f"m{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(s, x) AS x FROM m{n} LEFT JOIN "
            f"(SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS s FROM a{n} JOIN v USING (r) GROUP BY c, i) USING (c, i))"
        )
    parts.append(f"a AS MATERIALIZED ({nearest.format(n=rounds)})")
    parts.append(f"d AS (SELECT r, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS distance FROM a JOIN v USING (r) JOIN m{rounds} AS m USING (c, i) GROUP BY r, c)")
    parts.append(f"digest AS (SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)")
    return ",\n".join(parts) + """
SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM d JOIN digest USING (c) JOIN kept USING (r)
"""


OP12_SQL = _lloyd_sql(8, 10, 64, 1024, 3)


def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.packed(table(spark, sf_dir, "documents"), WORD_BPE)


QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_bpe_encoding": op2_bpe_encoding,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sanitisation": op4_sanitisation,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_sequence_packing": op13_sequence_packing,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op9_decontamination": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL,
}
