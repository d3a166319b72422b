"""Pairs that opened groups of the Jaccard join give."""

from __future__ import annotations

from tidebar.llm import jaccard_join


def test_a_set_asks_with_no_more_tokens_than_a_link_needs(spark):
    """Links of sets of 100 tokens share 9 first tokens: a set with 13 in a group's row meets who holds one of its first, not the last ones."""
    held = {1: (1, range(13)), 2: (10, range(13)), 3: (10, [10]), 4: (4, range(14))}
    rows = [(token, s, 100, token, 0.0, group) for s, (group, tokens) in held.items() for token in tokens]
    split = spark.createDataFrame(rows, "token long, set long, n int, at int, central double, group long")
    join = jaccard_join._Join.__new__(jaccard_join._Join)
    join.percent = 80
    assert {(r.a, r.b) for r in jaccard_join._opened(join, split).collect()} == {(1, 2), (1, 4), (2, 4)}
