"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

The sets are an item's windows of consecutive words, each seen as its shingles. A first pass over all documents counts
their words and the items' shingles, which orders these by rarity. A document that contains a window contains all of
its shingles, so its rarest one is prefix enough: a second pass joins only these with the shingles of the documents
that hold one.
Position and length then bound where the window would lie, and the words there are compared one by one with
the window's.

Shingles of documents travel as (place, hash), never with their text. The items' side of a join is
broadcast while it numbers BROADCAST_ROWS at most; beyond that (place, hash) is shuffled, and the words of
documents that met a prefix are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import stored, text_of

WINDOW, SHINGLE = 10, 5
#: Rows of hashes, or of windows a tenth as many, that are broadcast (16 MB, or 10 words each).
BROADCAST_ROWS = 1_000_000
#: What stands between words, and the letters folded.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(column: str) -> Column:
    """Split at what is between words: regexp_extract_all takes many times as long."""
    return F.array_remove(F.split(F.translate(text_of(column), UPPER, LOWER), BETWEEN), "")


def _hash_at(words: str, at: str, sizes: list[int]) -> Column:
    """Of k words from a place on, k being one of sizes."""
    by = {k: F.xxhash64(*[F.get(words, F.col(at) + F.lit(t)) for t in range(k)]) for k in sizes}
    return reduce(lambda rest, k: F.when(F.col("k") == k, by[k]).otherwise(rest), sizes[1:], by[sizes[0]])


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, check (a hash of the text), words: rows with one id and check are one and the same."""
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text_of(text_column)).alias("check"), words_of(text_column).alias("words"))


def _lengths(words: DataFrame) -> DataFrame:
    return words.select("id", "check", F.size("words").cast("long").alias("n_words"))


def _places(words: DataFrame, sizes: list[int], first: int = 0) -> DataFrame:
    """id, check, words, at, k: the places from first on, at least that one, each with every size. The words are a reference to one array.

    No filter on words alone: Spark moves it below the cut, and below the join that picks documents, and cuts all of them for it.
    """
    each = words.select("id", "check", "words", F.explode(F.sequence(F.lit(first), F.greatest(F.size("words") - 1, F.lit(first)))).alias("at"))
    return each.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("k"))


def _shingles(words: DataFrame, sizes: list[int]) -> DataFrame:
    """id, check, words, at, h: each k words in a row as a hash."""
    return _places(words, sizes).where(F.col("at") + F.col("k") <= F.size("words")).select("id", "check", "words", "at", _hash_at("words", "at", sizes).alias("h"))


def item_windows(items: DataFrame, window: int, item_column: str, text_column: str) -> DataFrame:
    """item, w (the window's words): consecutive words of an item; a shorter item is one window."""
    words = items.select(F.col(item_column).alias("item"), words_of(text_column).alias("words")).where(F.size("words") > 0)
    return words.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("at")).select("item", F.slice("words", F.col("at") + 1, F.least(F.size("words"), F.lit(window))).alias("w")).distinct()


def _counted(words: DataFrame, wanted: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """id, check, n_words of every row, and id, check, h for each place at which a wanted shingle stands. Both come from one pass where wanted is broadcast."""
    if wanted.count() > BROADCAST_ROWS:
        return _lengths(words), stored(_shingles(words, sizes).select("id", "check", "h").join(wanted, "h"))
    own = F.broadcast(wanted.select(F.col("h").alias("own")))
    whole = (F.col("at") >= 0) & (F.col("at") + F.col("k") <= F.size("words"))
    each = _places(words, sizes, -1).select("id", "check", F.size("words").cast("long").alias("n_words"), "at", "k", F.when(whole, _hash_at("words", "at", sizes)).alias("h"))
    row = (F.col("at") == -1) & (F.col("k") == sizes[0])  # stands for the row itself, whatever it holds
    seen = stored(each.join(own, F.col("h") == F.col("own"), "left").where(row | F.col("own").isNotNull()).select("id", "check", "n_words", F.col("own").alias("h")))
    return seen.where("h IS NULL").drop("h"), seen.where("h IS NOT NULL").drop("n_words")


def window_hits(docs: DataFrame, windows: DataFrame, id_column: str, text_column: str, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """id, check, n_words of every row of docs, and id, check, start (word, from 0), w: every occurrence of every window in every document.

    A clash of hashes costs time only: the words decide.
    """
    size = F.least(F.size("w"), F.lit(shingle))
    grams = windows.select("w").distinct().select("w", size.alias("k"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("offset"))
    sizes = sorted(r.k for r in grams.select("k").distinct().collect())  # 1 to SHINGLE
    words = _keyed(docs, id_column, text_column)
    if not sizes:
        return _lengths(words), words.select("id", "check", F.lit(0).alias("start"), F.lit(None).cast("array<string>").alias("w")).limit(0)
    grams = stored(grams.select("w", "offset", _hash_at("w", "offset", sizes).alias("h")))
    lengths, met = _counted(words, grams.select("h").distinct(), sizes)
    rarity = met.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    # a window of which a shingle is nowhere is nowhere
    rarest = grams.join(rarity, "h", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("offset"), F.col("h"))).alias("p"))
    prefix = stored(rarest.where("p.n > 0").select("w", "p.h", "p.offset"))
    few = prefix.count() <= BROADCAST_ROWS // 10
    own = F.broadcast(prefix) if few else prefix
    holders = stored(met.join(own.select("h").distinct(), "h").select(F.col("id").alias("own_id"), F.col("check").alias("own_check")).distinct())
    if holders.count() <= BROADCAST_ROWS:  # documents without a prefix are not cut into words again
        texts = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
        same = F.col("id").eqNullSafe(F.col("own_id")) & (F.xxhash64("text") == F.col("own_check"))
        words = _keyed(texts.join(F.broadcast(holders), same, "left_semi"), "id", "text")
    start = F.col("at") - F.col("offset")
    shingles = _shingles(words, sizes)
    if few:
        near = shingles.join(own, "h").where((start >= 0) & (start + F.size("w") <= F.size("words")))
        return lengths, near.where(F.slice("words", start + 1, F.size("w")) == F.col("w")).select("id", "check", start.alias("start"), "w").distinct()
    met = shingles.drop("words").join(own, "h").where(start >= 0)
    met = met.select(F.col("id").alias("met_id"), F.col("check").alias("met_check"), start.alias("start"), "w").distinct().groupBy("met_id", "met_check").agg(F.collect_list(F.struct("start", "w")).alias("met"))
    near = words.join(met, F.col("id").eqNullSafe(F.col("met_id")) & (F.col("check") == F.col("met_check"))).select("id", "check", "words", F.explode("met").alias("m"))
    near = near.where(F.slice("words", F.col("m.start") + 1, F.size("m.w")) == F.col("m.w"))
    return lengths, near.select("id", "check", "m.start", "m.w").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """Per row of docs: id column, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of any window. Null and empty texts, and items without words, have no
    windows and no hits. Rows are judged each by its own text, whatever their ids. Repeated items are
    found each under its own item id. Other columns are not read. An empty benchmark hits
    nothing; an empty docs table gives an empty one.
    """
    windows = stored(item_windows(benchmark, window, item_column, item_text_column))
    lengths, hits = window_hits(docs, windows, id_column, text_column)
    hits = stored(hits)
    spans = hits.select("id", "check", "start", F.size("w").alias("n")).distinct()
    covered = spans.select("id", "check", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy("id", "check").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("id", "check", "w").distinct().join(windows, "w").select("id", "check", "item").distinct().groupBy("id", "check").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), ",").alias("items"))
    items = items.select(F.col("id").alias("hit_id"), F.col("check").alias("hit_check"), "n_items", "items")
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("check") == F.col("hit_check"))
    per_doc = covered.join(items, same).drop("id", "check")
    out = lengths.join(per_doc, same, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("id").alias(id_column), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
