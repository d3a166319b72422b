"""Ranked search against scores of every document, with tiers that let items fall through."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pandas as pd
import pytest

from tests.llm import fixtures
from tests.llm.brute import LOWER
from tidebar.llm import queries, tiered_search


def terms(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)) if isinstance(text, str) else []


def brute(docs, items, k):
    """(item, rank, id, score) of every item, the items in their order."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def rows(frame) -> list:
    return sorted(((r[0], r[1], r[2], r[3]) for r in frame.collect()), key=str)


def random_tables():
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, make(rng.choice([1, 5, 40, 300]))) for i in range(600)]
    docs += [(i, docs[7][1]) for i in (900, 901, None)] + [(5, make(9)), (None, None), (700, ""), (701, " -- "), (702, "w1 " * 3000)]
    items = [(j, make(rng.choice([1, 3, 12]))) for j in range(30)] + [(3, docs[7][1]), (3, "w1 W1 w2"), (None, "w3 w9"), (40, None), (41, "unheardof"), (42, "")]
    return docs, items


@pytest.mark.parametrize(("tiers", "block"), [(((0.05, 1), (0.3, 3)), 40), (((0.2, 10),), 10**6), ((), 10**6)])
def test_every_tier_gives_the_exact_list(spark, tiers, block):
    docs, items = random_tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS score", "3 AS item").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS term")
    got = tiered_search.ranked(d, b, 7, tiers=tiers, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == sorted(brute(docs, items, 7), key=str)


def test_items_are_proven_in_upper_tiers_and_fall_through(spark, monkeypatch):
    """Rare terms are proven at once; an item of common words is not, and still gets its exact list."""
    seen = []
    real = tiered_search._rounds

    def spy(*a):
        for t, found in enumerate(real(*a)):
            seen.append({r.item for r in found.select("item").distinct().collect()})
            yield found

    monkeypatch.setattr(tiered_search, "_rounds", spy)
    docs = [(i, f"common{' common' * (i % 3)} filler{i % 5} " + ("rare " * (1 + i)) * (i < 3)) for i in range(300)]
    items = [(1, "rare"), (2, "filler0 filler1 filler2 filler3 filler4"), (3, "rare common")]
    got = tiered_search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3, tiers=((0.05, 5),))
    assert rows(got) == sorted(brute(docs, items, 3), key=str)
    assert len(seen) == 2 and all(seen) and not seen[0] & seen[1] and seen[0] | seen[1] == {0, 1, 2}


def test_fixture_and_empty_tables(spark, tmp_path):
    folder = fixtures.write(tmp_path)
    d, b = pd.read_parquet(f"{folder}/documents.parquet"), pd.read_parquet(f"{folder}/benchmark.parquet")
    want = brute(list(zip(d.doc_id.tolist(), d.text, strict=True)), list(zip(b.item_id.tolist(), b.text, strict=True)), 50)
    assert rows(queries.op11_ranked_search(spark, folder)) == sorted(want, key=str)
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    for x, y in ((docs.limit(0), items), (docs, items.limit(0))):
        assert tiered_search.ranked(x, y).collect() == []
