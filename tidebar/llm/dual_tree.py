"""Lloyd's clustering over whole-number vectors by dual-tree traversal.

Vectors are dealt into blocks; over each block a cover tree is built once and stored with it: a node is a vector
with a level, its children lie within 2^level of it and more than 2^(level-1) apart from each other,
and it knows the true distance to its farthest descendant, its number of descendants and their sum. A node of few vectors is a leaf.
Each round a cover tree over the centroids is walked against every block's tree. A pair of nodes goes when even the closest
vectors they may hold are farther apart than some centroid is from everything below the node; where one
centroid is left, the node's count and sum go to it whole. Leaves are compared with what is left exactly, in
whole numbers, ties to the smaller number.

A round sends number and sum for each centroid from every block, summed before the shuffle; the driver holds the centroids only.
Bounds are in doubles and give way by a margin far above their error, so they never decide a tie.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm.common import forget, stored

BLOCK, LEAF = 4096, 32
#: Components beyond it have squared distances that do not fit a long.
LARGEST = 2**26
#: Up to this, products of whole numbers are exact in doubles.
_EXACT = 2**21
_MARGIN = 1e-6


@dataclass
class CoverTree:
    """Nodes in the order of their making, each with its vectors as a range of `order`; children of a node are a range too."""

    points: np.ndarray
    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    child_end: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        """points: whole numbers as int64, at least one row."""
        real = points.astype(np.float64)
        order = np.arange(len(points))
        away = _distances(real, real[0])
        level = int(np.ceil(np.log2(max(away.max(), 1.0))))
        nodes = [(0, 0, len(points), level)]
        center, radius, begin, end, child, child_end = [], [], [], [], [], []
        at = 0
        while at < len(nodes):
            own, a, b, level = nodes[at]
            members = order[a:b]
            away = _distances(real[members], real[own])
            center.append(own), radius.append(away.max()), begin.append(a), end.append(b), child.append(len(nodes))
            if b - a > leaf and radius[-1] > 0:
                level = min(level, int(np.ceil(np.log2(radius[-1]))))
                nearest, which = away, np.zeros(b - a, np.int64)  # the node's own vector is its first child
                chosen = [own]
                while True:  # vectors farther than the separation from all children so far become children, the farthest first
                    far = int(nearest.argmax())
                    if nearest[far] <= 2.0 ** (level - 1):
                        break
                    chosen.append(int(members[far]))
                    rival = _distances(real[members], real[members[far]])
                    closer = rival < nearest
                    nearest, which = np.where(closer, rival, nearest), np.where(closer, len(chosen) - 1, which)
                by = np.argsort(which, kind="stable")
                order[a:b] = members[by]
                edges = a + np.searchsorted(which[by], np.arange(len(chosen) + 1))
                nodes += [(c, int(edges[i]), int(edges[i + 1]), level - 1) for i, c in enumerate(chosen)]
            child_end.append(len(nodes))
            at += 1
        ints = lambda x: np.array(x, np.int32)
        return cls(points, order.astype(np.int32), ints(center), np.array(radius), ints(begin), ints(end), ints(child), ints(child_end))

    @functools.cached_property
    def sums(self) -> np.ndarray:
        """Sum of the vectors before each place of `order`; a node's sum is a difference of two."""
        return np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points[self.order], axis=0)])

    @functools.cached_property
    def real(self) -> np.ndarray:
        return self.points.astype(np.float64)


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    apart = points - to
    return np.sqrt(np.einsum("ij,ij->i", apart, apart))


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by centroids, as int64."""
    if max(abs(points).max(initial=0), abs(centroids).max(initial=0)) <= _EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def _real_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances in doubles, points by centers, without cancellation."""
    return np.stack([_distances(points, c) for c in centers], axis=1)


def walk(tree: CoverTree, centroids: CoverTree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs the nodes; yields (nodes, centroid of each) decided whole, and lastly leaves: (nodes, None, centroids they may belong to as a mask)."""
    k = len(centroids.points)
    nodes = np.zeros(1, np.int64)
    alive = np.zeros((1, len(centroids.center)), bool)
    alive[0, 0] = True
    leaf_of = centroids.child == centroids.child_end
    while len(nodes):
        # go down among the centroids, pruning at each level
        while True:
            used = np.flatnonzero(alive.any(axis=0))
            rep = centroids.real[centroids.center[used]]
            apart = _real_distances(tree.real[tree.center[nodes]], rep)
            radius = tree.radius[nodes][:, None]
            most = np.where(alive[:, used], apart + radius, np.inf).min(axis=1, keepdims=True)
            least = apart - radius - centroids.radius[used]
            alive[:, used] &= least <= most * (1 + _MARGIN) + _MARGIN
            inner = [c for c in used if not leaf_of[c]]
            if not inner:
                break
            for c in inner:
                alive[:, centroids.child[c] : centroids.child_end[c]] |= alive[:, [c]]
                alive[:, c] = False
        open_to = np.zeros((len(nodes), k), bool)
        for c in np.flatnonzero(alive.any(axis=0)):  # a leaf may stand for equal centroids
            for i in centroids.order[centroids.begin[c] : centroids.end[c]]:
                open_to[:, i] = alive[:, c]
        single = open_to.sum(axis=1) == 1
        yield nodes[single], open_to[single].argmax(axis=1), None
        nodes, alive, open_to = nodes[~single], alive[~single], open_to[~single]
        last = tree.child[nodes] == tree.child_end[nodes]
        yield nodes[last], None, open_to[last]
        nodes, alive = nodes[~last], alive[~last]
        times = tree.child_end[nodes] - tree.child[nodes]
        first = np.repeat(tree.child[nodes] - (np.cumsum(times) - times), times)
        nodes, alive = first + np.arange(len(first)), np.repeat(alive, times, axis=0)


def assigned(tree: CoverTree, centroids: CoverTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and number and sum of each centroid's vectors."""
    k, width = centroids.points.shape
    cluster, n, total = np.full(len(tree.points), -1, np.int32), np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for nodes, of, open_to in walk(tree, centroids):
        if open_to is None:
            np.add.at(n, of, (tree.end - tree.begin)[nodes])
            np.add.at(total, of, tree.sums[tree.end[nodes]] - tree.sums[tree.begin[nodes]])
            for node, c in zip(nodes, of, strict=True):
                cluster[tree.order[tree.begin[node] : tree.end[node]]] = c
            continue
        if not len(nodes):
            continue
        sizes = (tree.end - tree.begin)[nodes]
        place = np.repeat(tree.begin[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        own, allowed = tree.order[place], np.repeat(open_to, sizes, axis=0)
        far = squared(tree.points[own], centroids.points)
        best = np.where(allowed, far, np.iinfo(np.int64).max).argmin(axis=1)
        cluster[own] = best
        n += np.bincount(best, minlength=k)
        np.add.at(total, best, tree.points[own])
    return cluster, n, total


_PARTS = ("center", "radius", "begin", "end", "child", "child_end", "order")


def _packed(tree: CoverTree) -> list[bytes]:
    return [getattr(tree, p).tobytes() for p in _PARTS]


def _unpacked(points: np.ndarray, parts: list[bytes]) -> CoverTree:
    return CoverTree(points, **{p: np.frombuffer(b, np.float64 if p == "radius" else np.int32) for p, b in zip(_PARTS, parts, strict=True)})


def whole_numbers(vectors: DataFrame, width: int, scale: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, v: vectors of `width` components, none null or non-finite, each turned into floor(scale * x)."""
    v = F.col(vector_column).cast("array<double>")
    fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.lit(scale) * x))
    beyond = F.raise_error(F.lit(f"a component beyond {LARGEST} in whole numbers: its distances fit no long")).cast("array<long>")
    held = F.when(F.forall(v, lambda x: F.abs(x) * scale < LARGEST), scaled).otherwise(beyond)
    return vectors.where(v.isNotNull() & fine).select(F.col(id_column).alias("id"), held.alias("v"))


def _blocks(kept: DataFrame, width: int) -> DataFrame:
    """Vectors in blocks with their trees: ids, vectors and tree, one row for each block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                points = part.column(1).flatten().to_numpy().reshape(-1, width)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([points.tobytes()]), *(pa.array([b]) for b in _packed(CoverTree.build(points)))], ["ids", "points", *_PARTS])

    kind = kept.schema["id"].dataType.simpleString()
    return stored(kept.mapInArrow(build, f"ids array<{kind}>, points binary, " + ", ".join(f"{p} binary" for p in _PARTS)))


def _trees(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, CoverTree]]:
    """ids and tree of each block in a batch whose columns are ids, points and the tree's parts."""
    for row in range(batch.num_rows):
        points = np.frombuffer(batch.column(1)[row].as_buffer(), np.int64).reshape(-1, width)
        yield batch.column(0)[row].values, _unpacked(points, [batch.column(2 + i)[row].as_buffer() for i in range(len(_PARTS))])


def _first(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id; null ids come last, equal ids by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def _means(blocks: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after one round."""
    tree = CoverTree.build(centroids, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in _trees(batch, width):
                _, n, total = assigned(own, tree)
                some = np.flatnonzero(n)
                of, place = np.repeat(some, width + 1), np.tile(np.arange(width + 1), len(some))
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(np.column_stack([total[some], n[some]]).ravel())], ["cluster", "place", "s"])

    sums = blocks.mapInArrow(run, "cluster int, place int, s long").groupBy("cluster", "place").agg(F.sum(F.col("s").cast(T.DecimalType(38, 0))).alias("s"))
    found = {(r.cluster, r.place): int(r.s) for r in sums.collect()}  # a number and the components of each centroid
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i] // found[c, width] for i in range(width)]
    return out


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per kept vector: id column, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another width or with null or non-finite components are left out. With fewer kept
    vectors than k there are as many clusters as vectors. Equal and null ids are vectors of their own; equal
    vectors may be several centroids, of which the smallest number gets them all. Other columns are not
    read. Without kept vectors the result is empty. Components beyond LARGEST raise an error.
    """
    kept = whole_numbers(vectors, width, scale, id_column, vector_column)
    start = _first(kept, k, seed)
    kind = kept.schema["id"].dataType.simpleString()
    if not len(start):
        return kept.selectExpr(f"id AS `{id_column}`", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)
    blocks = _blocks(kept, width)
    for _ in range(rounds):
        start = _means(blocks, start, width)
    tree, final = CoverTree.build(start, 1), start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own in _trees(batch, width):
                cluster, _, _ = assigned(own, tree)
                apart = ((own.points - final[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(apart)], ["id", "cluster", "distance"])

    found = stored(blocks.mapInArrow(run, f"id {kind}, cluster int, distance long"))
    forget(blocks)
    inertia = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    by = found.sparkSession.createDataFrame([(c, d, sum(inertia.values()), digests[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster").select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
