"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import forget, stored

#: Contracted edges that one task joins, at most: what few are left would take as many rounds again, each of them all overhead.
FINISH = 10_000


def components(edges: DataFrame, known: DataFrame | None = None, finish: int = FINISH) -> DataFrame:
    """node, root for every node of edges (a, b); root is one node of the component, the same for all of it.

    known: the result for earlier edges, to which these are added. Only the groups that the new edges join are worked on.

    Each round sends every node to its first neighbour in an order drawn anew by hash, or keeps it if it comes
    before them, follows the pointers to the fourth, and contracts. The order keeps chains of rising ids from shrinking
    by a few nodes a round. Edges within a merged node vanish, so the table shrinks geometrically and
    a hub of any degree is one partial aggregate and one join that adaptive execution may split. If a round, or what
    is known, has left no more than `finish` edges, they are joined at once.
    """
    rounds: list[DataFrame] = []
    ends = edges.select("a", "b") if known is None else _moved(edges, known)
    left = stored(_edges(ends))
    while many := left.count():
        if (rounds or known is not None) and many <= finish:
            rounds.append(stored(left.coalesce(1).mapInArrow(_joined, "node long, root long")))
            break
        place = lambda c, turn=len(rounds): F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.min(place("b")).alias("first")).select(F.col("a").alias("node"), F.least("first", place("a"))["v"].alias("root")))
        further = to
        for _ in range(3):
            further = _followed(further, to)
        rounds.append(stored(further))
        # the ends of edges are labels, so they move by this round's pointers alone
        rest = stored(_edges(_moved(left, rounds[-1])))
        forget(to, left)
        left = rest
    forget(left)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, root long") if known is None else known
    roots = rounds[0]
    for to in rounds[1:]:
        roots = _followed(roots, to)
    if known is not None:
        if len(rounds) > 1:
            rounds.append(roots := stored(roots))
        roots = _followed(known, roots).unionAll(roots.join(known.select("node"), "node", "left_anti"))
    out = stored(roots)
    forget(*rounds)
    return out


def _edges(ends: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _moved(edges: DataFrame, to: DataFrame) -> DataFrame:
    """a, b: each end at its root, if it has one."""
    a = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))


def _followed(roots: DataFrame, to: DataFrame) -> DataFrame:
    """node, root with each root sent on to where `to` has it."""
    on = to.select(F.col("node").alias("via"), F.col("root").alias("further"))
    return roots.join(on, F.col("root") == F.col("via"), "left").select("node", F.coalesce("further", "root").alias("root"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all edges that come."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent[top(a)] = top(b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])
