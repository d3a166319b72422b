"""Connected components keep long chains whole, whatever the order of their ids."""

from __future__ import annotations

import random

import pytest

from tidebar.llm import components as module
from tidebar.llm import jaccard_join
from tidebar.llm.components import components


def test_chains_stay_whole(spark):
    edges, chains, at = [], [], 0
    for n in (2, 10, 50, 1000, 1000):
        ids = list(range(at, at + n))
        if len(chains) == 4:
            random.Random(n).shuffle(ids)
        chains.append(ids)
        edges += zip(ids, ids[1:])
        at += n
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == at
    for ids in chains:
        assert len({got[i] for i in ids}) == 1 and got[ids[0]] in ids


def grouped(df) -> set[frozenset]:
    by: dict[int, set] = {}
    for r in df.collect():
        by.setdefault(r.root, set()).add(r.node)
    assert all(root in nodes for root, nodes in by.items())
    return {frozenset(nodes) for nodes in by.values()}


@pytest.mark.parametrize("finish", [0, 10, 10_000])
def test_edges_added_to_known_components_give_those_of_all(spark, finish):
    rng = random.Random(finish)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    later = [(rng.randrange(200), rng.randrange(200)) for _ in range(30)]
    table = lambda some: spark.createDataFrame(some, "a long, b long")
    known = components(table(edges), finish=finish)
    assert grouped(components(table(later), known, finish)) == grouped(components(table(edges + later), finish=0))
    assert grouped(components(table([(a, a) for a, _ in later]), known, finish)) == grouped(known)


def test_the_join_stores_few_tables_where_groups_share_passages(spark, monkeypatch):
    """Each stored table is a job of its own: contracting all links anew in every round stores too many of them."""
    rng = random.Random(3)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    bases = [words(120) for _ in range(12)]
    for one, two in zip(bases[::2], bases[1::2], strict=True):
        two[:60] = one[:60]
    rows = []
    for k, base in enumerate(bases):
        for _ in range(1 + k % 4):
            at = rng.randrange(120)
            rows.append((len(rows), " ".join([*base[:at], *words(1), *base[at + 1 :]]), k))
    times = []
    for m in (module, jaccard_join):
        monkeypatch.setattr(m, "stored", lambda df, real=m.stored: times.append(1) or real(df))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, base int")).orderBy("doc_id").collect()
    least = {k: i for i, _, k in reversed(rows)}
    assert [r.component_id for r in got] == [least[k] for _, _, k in rows]
    assert len(times) <= 50, len(times)
