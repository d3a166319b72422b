"""Dual-tree clustering against plain Lloyd in Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tidebar.llm import dual_tree
from tidebar.llm.dual_tree import CoverTree


def lloyd(rows, k, rounds, width, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    m = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    of = lambda: [min(range(len(m)), key=lambda c: (far(v, m[c]), c)) for _, v in kept]
    for _ in range(rounds):
        own = of()
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            m[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = of()
    apart = [far(v, m[c]) for (_, v), c in zip(kept, own, strict=True)]
    by = {c: sum(d for d, o in zip(apart, own, strict=True) if o == c) for c in own}
    return sorted(((i, c, d, by[c], sum(apart), hashlib.sha256(",".join(map(str, m[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, own, apart, strict=True)), key=str)


def vectors(n: int, width: int, spread: float):
    rng = random.Random(n)
    centers = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(centers)]) for i in range(n)]
    rows += [(rows[0][0], rows[0][1]), (None, rows[1][1]), (None, rows[2][1]), (n + 1, None), (n + 2, []), (n + 3, [0.5] * (width - 1)), (n + 4, [float("nan")] * width), (n + 5, [float("inf")] + [0.0] * (width - 1)), (n + 6, [None] + [0.0] * (width - 1))]
    return rows + [(n + 10 + i, [0.25] * width) for i in range(n // 3)]  # copies: a third of all


@pytest.mark.parametrize(("n", "width", "spread", "k"), [(700, 2, 0.05, 6), (500, 3, 0.5, 9), (300, 64, 0.2, 8), (0, 4, 0.1, 8), (6, 2, 0.1, 50)])
def test_equals_plain_lloyd(spark, n, width, spread, k, monkeypatch):
    monkeypatch.setattr(dual_tree, "BLOCK", 400)
    rows = vectors(n, width, spread) if n else [(1, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS cluster", "3 AS v")
    read = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = dual_tree.clusters(frame.repartition(3), k, 6, width)
    assert sorted(map(tuple, got.collect()), key=str) == lloyd(read, k, 6, width, 1024, 3)


def test_lattice_ties(spark):
    """Whole-number points midway between centroids go to the smaller number."""
    rows = [(i, [float(i % 8), float(i // 8 % 8)]) for i in range(192)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, dual_tree.clusters(frame, 5, 4, 2, 1).collect()), key=str) == lloyd(rows, 5, 4, 2, 1, 3)


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [60_000.0 * (-1) ** i + i, 1.0 * i]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, dual_tree.clusters(frame, 3, 3, 2).collect()), key=str) == lloyd(rows, 3, 3, 2, 1024, 3)
    with pytest.raises(Exception, match="fit no long"):
        dual_tree.clusters(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>"), 3, 3, 2).collect()


def test_cover_tree_invariants_and_pruning():
    rng = np.random.Generator(np.random.PCG64(4))
    points = (rng.normal(size=(3000, 2)) * 40 + rng.integers(-4, 5, (3000, 2)) * 900).astype(np.int64)
    tree = CoverTree.build(points)
    assert sorted(tree.order) == list(range(3000))
    for v in range(len(tree.center)):
        members = points[tree.order[tree.begin[v] : tree.end[v]]]
        away = np.sqrt(((members - points[tree.center[v]]) ** 2).sum(1))
        assert away.max() <= tree.radius[v] + 1e-9
        children = range(tree.child[v], tree.child_end[v])
        if children:
            assert tree.center[children[0]] == tree.center[v]  # nesting
            level = math.ceil(math.log2(tree.radius[v]))
            own = points[tree.center[list(children)]]
            apart = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1))[~np.eye(len(own), dtype=bool)]
            assert apart.min() > 2.0 ** (level - 1)  # separation
            assert all(tree.radius[c] <= 2.0 ** (level - 1) for c in children)  # covering
            assert [tree.begin[c] for c in children] + [tree.end[v]] == [tree.begin[v]] + [tree.end[c] for c in children]
    centroids = points[rng.choice(3000, 25, replace=False)]
    whole = compared = 0
    for nodes, of, open_to in dual_tree.walk(tree, CoverTree.build(centroids, 1)):
        sizes = (tree.end - tree.begin)[nodes]
        whole += sizes.sum() if open_to is None else 0
        compared += 0 if open_to is None else (sizes * open_to.sum(1)).sum()
    assert whole > 1500 and compared < 3000 * 25 / 5  # most vectors never meet a centroid
