"""Information-theoretic sanitisation, in DataFrame functions only.

Protected entities are the personal data that the base patterns find. A term that stands in an entity's text may
reveal it even when the entity itself is gone. How strongly is estimated from the whole corpus, each
different text counted once: with IC(e) = -log p(e) and PMI(e; t) = log p(e, t) / (p(e) p(t)), the share
PMI / IC of the entity's information that the term gives away is 1 if the term occurs only with the entity.
Terms with a share of at least GENERALISE are generalised, those with at least REMOVE are removed; pairs
seen in fewer than LEAST_TEXTS texts prove nothing.

All words of the texts that hold an entity are asked about, outside its spans. Pairs that no frequency of the
term in the other texts could make telling are left out before those texts are read for it. A disclosing term
is marked wherever it stands in a text that holds the entity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import stored, text_of

GENERALISE, REMOVE, LEAST_TEXTS = 0.8, 1.0, 2
BROADCAST_TERMS = 500_000
#: Spans of one text that are handled together.
CHUNK = 256
#: The base kinds in order with their patterns. Possessive repeats and the look-behinds change no
#: match; they keep long runs from being tried again from each of their characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth trying.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{M}\p{N}]{2,}"
_SPAN = "array<struct<start: int, end: int, value: string>>"


def _valid(kind: str) -> Callable[[Column], Column]:
    """Whether a match counts."""

    def digits(m: Column) -> Column:
        return F.regexp_replace(m["value"], "[^0-9]", "")

    def luhn(d: Column) -> Column:
        back = F.reverse(d)
        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + _doubled(F.substring(back, i, F.lit(1)).cast("int"), i))
        return total % 10 == 0

    def card(m: Column) -> Column:
        d = digits(m)
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))

    def ip(m: Column) -> Column:
        return F.forall(F.split(m["value"], r"\."), lambda p: F.when(F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3, F.regexp_replace(p, "^0+(?=.)", "").cast("int") <= 255).otherwise(F.lit(False)))

    return {"email": lambda m: F.lit(True), "ip": ip, "card": card, "phone": lambda m: F.length(digits(m)).between(9, 15)}[kind]


def _doubled(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)


def _located(found: str, gaps: str) -> Column:
    """Matches with their places, from the matches and the stretches between them; CHUNK at a time, so that many are not copied for each one."""
    every = F.arrays_zip(found, gaps)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x[gaps])
        end = begin + F.length(x[found])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), x[found].alias("value"))).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("out"))
        part = F.aggregate(F.slice(every, c * CHUNK + 1, F.lit(CHUNK)), start, step)
        return _bound(part, lambda p: F.struct(p["at"].alias("at"), F.array_append(acc["out"], p["out"]).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(found) / CHUNK).cast("int")), start, chunk, lambda acc: F.flatten(acc["out"]))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rewritten(text: Column, spans: Column, mark: Callable[[Column, Column], Column]) -> Column:
    """The text with mark(span, end of the text written so far) in place of each span; spans come in order. CHUNK at a time, so that
    the text is not cut from its beginning for each span."""

    def chunk(acc: Column, c: Column) -> Column:
        some = F.slice(spans, c * CHUNK + 1, F.lit(CHUNK))
        end = F.greatest(acc["at"], F.coalesce(F.array_max(F.transform(some, lambda s: s["end"])), acc["at"]))
        cut = F.struct(acc["at"].alias("at"), acc["out"].alias("out"), some.alias("some"), end.alias("end"), F.substring(text, acc["at"] + 1, end - acc["at"]).alias("text"))
        return _bound(cut, lambda z: F.struct(z["end"].alias("at"), F.array_append(z["out"], written(z)).alias("out")))

    def written(z: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            kept = F.substring(z["text"], acc["at"] - z["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(F.array_append(acc["out"], kept), mark(s, acc["at"])).alias("out"))

        start = F.struct(z["at"].alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(z["some"], start, step, lambda acc: F.array_join(acc["out"], ""))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(spans) / CHUNK).cast("int")), start, chunk, rest)


def base_spans(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """row, id, text_key, one array of spans for each kind, and rest: the text with blanks in place of spans, null where there are none."""
    t = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("t"))
    none = F.array().cast("array<string>")
    columns = []
    for kind, pattern in PATTERNS.items():
        hint = F.col("t").contains(HINTS[kind]) if kind == "email" else F.col("t").rlike(pattern)
        columns += [F.when(hint, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m_{kind}"), F.when(hint, F.split("t", pattern, -1)).otherwise(none).alias(f"s_{kind}")]
    cut = t.select("id", "t", F.xxhash64("t").alias("text_key"), *columns)
    zipped = cut.select("id", "t", "text_key", *[c for k in PATTERNS for c in (F.col(f"m_{k}"), F.slice(f"s_{k}", F.lit(1), F.size(f"m_{k}")).alias(f"g_{k}"))])
    placed = zipped.select("id", "t", "text_key", *[_located(f"m_{k}", f"g_{k}").alias(k) for k in PATTERNS])
    valid = placed.select("id", "t", "text_key", *[F.filter(k, _valid(k)).alias(k) for k in PATTERNS])
    every = F.array_sort(F.transform(F.concat(*PATTERNS), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return valid.select(F.monotonically_increasing_id().alias("row"), "id", "text_key", *PATTERNS, F.when(F.size(every) > 0, _blanked(F.col("t"), every)).alias("rest"))


def _blanked(text: Column, places: Column) -> Column:
    """The text with as many blanks in place of each span."""
    return _rewritten(text, places, lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0))))


def _entities(spans: DataFrame) -> DataFrame:
    """row, text_key, entity: each entity once for each row that holds it."""
    each = reduce(DataFrame.unionAll, [spans.select("row", "text_key", F.lit(k).alias("kind"), F.explode(k).alias("s")) for k in PATTERNS])
    return each.select("row", "text_key", F.concat_ws(":", "kind", "s.value").alias("entity")).distinct()


def _words(text: str) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def disclosing_pairs(docs: DataFrame, found: DataFrame, entities: DataFrame, text_column: str) -> DataFrame:
    """entity, term, share: pairs in which the term gives away at least GENERALISE of the entity's information."""
    texts = docs.select(text_of(text_column).alias("t"))
    total = texts.select(F.xxhash64("t").alias("text_key")).distinct().agg(F.count(F.lit(1)).alias("n"))
    seen = entities.select("entity", "text_key").distinct()
    often = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= LEAST_TEXTS)
    rest = found.where("rest IS NOT NULL").dropDuplicates(["text_key"]).select("text_key", F.explode(_words("rest")).alias("term"))
    both = seen.join(often, "entity").join(rest, "text_key").groupBy("entity", "term", "n_entity").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= LEAST_TEXTS)
    # a term stands in at least as many texts as in those with entities
    beside = rest.groupBy("term").agg(F.count(F.lit(1)).alias("n_least"))

    def share(n_term: str) -> Column:
        return F.ln(F.col("n") * F.col("n_both") / (F.col("n_entity") * F.col(n_term))) / F.ln(F.col("n") / F.col("n_entity"))

    known = both.join(beside, "term").join(F.broadcast(total), how="cross").where(F.col("n") > F.col("n_entity"))  # one row
    pairs = stored(known.where(share("n_least") >= GENERALISE - 1e-9))
    terms = stored(pairs.select("term").distinct())
    wanted = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    words = texts.select(F.xxhash64("t").alias("text_key"), F.explode(_words("t")).alias("term"))
    counts = words.join(wanted, "term", "left_semi").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    out = pairs.join(counts, "term", "left").withColumn("n_term", F.greatest("n_term", "n_least"))  # a word that ends at a span is none in the whole text
    return out.select("entity", "term", share("n_term").alias("share")).where(F.col("share") >= GENERALISE - 1e-9)


def _occurrences(found: DataFrame, marked: DataFrame) -> DataFrame:
    """row, share, start, end: every place of the marked terms (row, term, share) in their rows."""
    t = found.join(marked.select("row").distinct(), "row", "left_semi").select("row", F.regexp_extract_all("rest", F.lit(WORD), F.lit(0)).alias("m"), F.split("rest", WORD, -1).alias("g"))
    each = t.select("row", F.posexplode(F.arrays_zip("m", F.slice("g", F.lit(1), F.size("m")).alias("g"))).alias("k", "w"))
    end = F.sum(F.length("w.g") + F.length("w.m")).over(Window.partitionBy("row").orderBy("k")).cast("int")
    placed = each.select("row", F.lower("w.m").alias("term"), (end - F.length("w.m")).alias("start"), end.alias("end"))
    return placed.join(marked, ["row", "term"]).select("row", "share", "start", "end")


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id column, base and added spans (arrays of kind, start, end in code points, by kind, then start).

    Added spans have the kind "general" (generalise) or "remove". Null and empty texts have none. Equal
    texts count once as evidence, whatever their ids; rows are numbered on their own, so repeated and null ids
    are kept apart. Other columns are not read. An empty table gives an empty one.
    """
    found = stored(base_spans(docs, id_column, text_column))
    entities = stored(_entities(found))
    telling = stored(disclosing_pairs(docs, found, entities, text_column))
    marked = stored(entities.join(telling, "entity").groupBy("row", "term").agg(F.max("share").alias("share")))
    kind = F.when(F.col("share") >= REMOVE - 1e-9, F.lit("remove")).otherwise(F.lit("general"))
    terms = _occurrences(found, marked).select("row", F.struct(kind.alias("kind"), "start", "end").alias("s"))
    added = terms.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("added"))
    base = F.concat(*[F.transform(k, _named(k)) for k in PATTERNS])
    out = found.select("row", "id", base.alias("base")).join(added, "row", "left")
    return out.select(F.col("id").alias(id_column), "base", F.coalesce("added", F.array().cast("array<struct<kind: string, start: int, end: int>>")).alias("added"))


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def sanitised(text: Column, base: Column, added: Column) -> Column:
    """The text with base spans and generalised terms replaced by a mark, and removed terms left out."""
    every = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def mark(s: Column, at: Column) -> Column:
        own = F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "general", F.lit("<word>")).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.when(s["start"] < at, F.lit("")).otherwise(own)  # one mark for spans that overlap

    return _rewritten(text, every, mark)
