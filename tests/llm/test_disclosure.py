"""Terms far from an entity disclose it too, and go wherever they stand in its texts."""

from __future__ import annotations

from tidebar.llm import sanitise


def test_terms_of_whole_texts(spark):
    far = "and so on and on " * 6
    texts = [f"Zebedee Bo R2D2 {far} z@q.org {w} {far} Zebedee" for w in ("one", "two", "three")] + [f"{far} item {w}" for w in ("four", "five", "six", "seven", "eight")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.added] for r in sanitise.spans(d).collect()}
    assert got[0] == got[1] == got[2] and sorted(got[0]) == ["Bo", "R2D2", "Zebedee", "Zebedee"]
    assert not any(got[i] for i in range(3, 8))


def test_fifty_thousand_matches_in_one_text(spark):
    from brute import personal
    from pyspark.sql import functions as F

    text = "é ".join(f"a{i}@b.org, 10.0.0.{i % 300};" for i in range(25_000))
    d = spark.createDataFrame([(1, text), (2, "a1@b.org é"), (3, None)], "doc_id long, text string")
    out = sanitise.spans(d).withColumnRenamed("doc_id", "own").join(d, F.col("own") == F.col("doc_id"))
    got = {r.doc_id: r for r in out.select("doc_id", "base", "added", sanitise.sanitised(F.coalesce("text", F.lit("")), F.col("base"), F.col("added")).alias("clean")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1].base] == personal(text) and len(got[1].base) > 45_000
    assert got[1].clean.count("<email>") == 25_000 and "@" not in got[1].clean and "10.0.0.299;" in got[1].clean
    assert got[2].clean.replace("<word>", "") in ("<email> é", "<email> ") and got[3].clean == ""
