"""Rows are told apart by id and text together: null and repeated ids mix nothing up."""

from __future__ import annotations

import fixtures
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidebar.llm import decontaminate, jaccard_join, radix_dedup

LONG = [f"w{i}" for i in range(60)]
BENCH = "the quick brown fox jumps over the lazy dog and then sleeps"


def documents(spark, some: list[tuple]):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in some], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def folder(tmp_path):
    return fixtures.write(tmp_path)


def test_stages_with_null_and_repeated_ids(spark, folder):
    near = [*LONG[:59], "other"]
    docs = documents(spark, [(None, " ".join(LONG)), (None, "a clean text"), (None, " ".join(near)), (7, "one text of seven"), (7, f"x {BENCH} y"), (7, "one text  of seven"), (8, "one text of seven"), (8, "eight"), (8, "eight")])
    left = [(r.doc_id, r.text) for r in corpus_pipeline.without_copies(spark, docs, folder).collect()]
    assert sorted(left, key=str) == sorted([(None, " ".join(LONG)), (None, "a clean text"), (None, " ".join(near)), (7, f"x {BENCH} y"), (7, "one text  of seven"), (8, "eight")], key=str)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.without_near_copies(spark, docs, folder).collect()]
    assert sum(i is None for i, _ in left) == 2 and (None, "a clean text") in left
    assert sum(t == "eight" for _, t in left) == 1 and sum(t.split() == "one text of seven".split() for _, t in left) == 1 and (7, f"x {BENCH} y") in left
    left = [(r.doc_id, r.text) for r in corpus_pipeline.without_benchmark(spark, docs, folder).collect()]
    assert len(left) == 8 and (7, f"x {BENCH} y") not in left


def test_texts_that_share_an_id_share_no_hits(spark):
    docs = documents(spark, [(None, f"x {BENCH}"), (None, "clean words here"), (3, f"{BENCH} z"), (3, "clean too")])
    bench = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    got = decontaminate.contamination(docs.withColumn("key", F.col("doc_id")), bench)
    assert sorted((r.n_words, r.contaminated) for r in got.collect()) == [(2, False), (3, False), (13, True), (13, True)]


def test_one_text_of_a_million_words(spark):
    spark.createDataFrame([(1,)], "doc_id long").createOrReplaceTempView("one")
    docs = spark.sql("SELECT doc_id, concat_ws(' ', transform(sequence(1, 1000000), i -> concat('w', i % 9973))) || ' " + BENCH + "' AS text FROM one")
    bench = spark.createDataFrame([(1, BENCH), (2, "nothing like it")], "item_id long, text string")
    (got,) = decontaminate.contamination(docs, bench).collect()
    assert (got.n_words, got.n_hit, got.n_items) == (1_000_012, 12, 1)


def test_benchmark_larger_than_a_broadcast(spark, monkeypatch):
    docs = documents(spark, [(i, f"{'lead ' * (i % 7)}{BENCH if i % 3 == 0 else 'nothing'} {i}") for i in range(40)] + [(None, f"short {BENCH[:40]}")])
    bench = spark.createDataFrame([(1, BENCH), (2, "lead lead lead"), (3, None), (4, "lead")], "item_id long, text string")
    small = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(str, decontaminate.contamination(docs, bench).collect())) == small


def test_radix_levels(spark):
    long = "a" * 70_000
    docs = documents(spark, [(i, t) for i, t in enumerate([long, long, long + "b", long[:65], long[:64], long[:64], long[:1088], long[:1088], "", None, "x"])])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in radix_dedup.exact_groups(docs).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1), 4: (4, 2), 5: (4, 2), 6: (6, 2), 7: (6, 2), 8: (8, 2), 9: (8, 2), 10: (10, 1)}


def test_outliers_of_a_large_group(spark):
    """Many copies of one text, and many texts a little too far from all of them: brute force agrees."""
    import random

    from brute import components

    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    some = []
    for i in range(160):
        words = base.copy()
        for _ in range(1 if i < 80 else rng.randrange(2, 7)):
            words[rng.randrange(120)] = f"x{rng.randrange(30 if i % 2 else 10_000)}"
        some.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(spark, some)).collect()}
    assert got == components(dict(some))
