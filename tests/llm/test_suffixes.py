"""Suffix groups: common phrases, long prefixes, and the field's bounded sample."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import jaccard_join, secret_crf, substring_dedup, word_hashes


def brute(docs: dict[int, str]) -> dict[int, str]:
    first: dict[tuple, int] = {}
    words = {i: t.split() for i, t in docs.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


@pytest.mark.parametrize("in_group", [600_000, 40])
def test_one_common_phrase_in_many_contexts(spark, monkeypatch, in_group):
    monkeypatch.setattr(substring_dedup, "SUFFIXES_IN_GROUP", in_group)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    docs = {}
    for i in range(120):
        words = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(30)]
        for _ in range(4):
            k = rng.randrange(len(words))
            words[k:k] = ["all", "rights", "are", "reserved"]
        if i % 3 == 0:
            words[5:5] = passage
        docs[i * 7 % 120] = " ".join(words)
    got = {r.doc_id: r.kept_text for r in substring_dedup.without_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(docs)


def test_a_large_group_is_dealt_out_by_the_window():
    rng = np.random.default_rng(1)
    phrase = rng.integers(1, 2**63, 4, dtype=np.uint64)
    docs = [(i, i * 7, np.concatenate([x for _ in range(40) for x in (phrase, rng.integers(1, 2**63, 9, dtype=np.uint64))])) for i in range(20)]
    chunk = substring_dedup._Chunk(docs, 13)
    found, n = chunk.counts(4, 1)
    assert n.sum() == (~chunk.known).sum()
    whole, split = (list(chunk.runs(4, parts)) for parts in ({}, {int(found[n.argmax()]): 6}))
    assert len({(g, p) for g, p, _ in split}) == len({g for g, _, _ in whole}) + 5
    nodes = lambda some: sorted(tuple(map(int, r)) for _, _, b in some for r in zip(*substring_dedup._repeats([b])))
    assert nodes(whole) == nodes(split)


def test_nodes_whose_sums_agree_are_kept_apart():
    seed, tail = np.array([5, 5, 9], np.uint64), np.array([1, 1, 7], np.uint64)
    order, heads = substring_dedup._nodes(seed, tail)
    assert len(heads) == 2 and len(order) == 3


def words_of(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))


def test_rows_without_an_id_and_rows_that_share_one(spark):
    w, u, z = (words_of(20, k) for k in range(3))
    rows = [(1, w), (None, w), (None, u), (5, w), (5, u), (5, z), (5, z), (9, z), (9, f"{z} {w}"), (4, None), (4, "")]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=str)
    want = [(1, 20, 0), (None, 20, 0), (None, 20, 0), (5, 20, 20), (5, 20, 0), (5, 20, 0), (5, 20, 0), (9, 20, 20), (9, 40, 40), (4, 0, 0), (4, 0, 0)]
    assert got == sorted(want, key=str)


def test_random_rows_with_null_and_repeated_ids_against_brute_force(spark):
    rng = random.Random(9)
    parts = [words_of(n, 50 + n) for n in (3, 9, 13, 14, 20)]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), " ".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for _ in range(60)]
    first: dict[tuple, int] = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(t.split()) - 12):
            first.setdefault(tuple(t.split()[k : k + 13]), i)
    want = []
    for i, t in rows:
        w = t.split()
        gone = {p for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_defeat_hashes_by_powers_are_kept_apart(spark):
    one, two = thue_morse(1024)
    assert len({int(word_hashes.word_hashes(x.encode(), seed=s)[0]) for x in (one, two) for s in range(8)}) == 16
    rest = words_of(30, 1).split()
    docs = spark.createDataFrame([(1, " ".join([*rest[:6], one, *rest[6:12]])), (2, " ".join([*rest[:6], two, *rest[6:12]]))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.without_repeats(docs).orderBy("doc_id").collect()] == [0, 0]
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert [r.component_id for r in jaccard_join.jaccard_components(docs).orderBy("doc_id").collect()] == [1, 2]


def test_a_clash_under_every_seed_is_an_error(spark, monkeypatch):
    real = jaccard_join._Join.sets
    monkeypatch.setattr(jaccard_join._Join, "sets", lambda self: real(self).withColumn("set", F.lit(7).cast("long")))
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    with pytest.raises(Exception, match="equal hashes"):
        jaccard_join.jaccard_components(docs)


def test_one_repeated_id_gives_no_more_rows_than_asked_for(spark):
    docs = spark.createDataFrame([(1, f"password=abcdef{i % 700} row") for i in range(3000)] + [(1, f"plain row {i % 700}") for i in range(3000)], "doc_id long, text string")
    assert secret_crf.training_texts(docs, 50, "doc_id", "text").count() == 50
