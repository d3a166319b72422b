"""Repeated passages by suffix trees over words, built in groups that share a prefix.

Only the tree's nodes at a depth of WINDOW words matter: the suffixes below one of them begin with the same
window, and all but those of its smallest document are repeats. So suffixes are cut at that depth, and one
subtree after the other is built from the suffixes that its group holds: they are sorted by prefix and
window, and neighbours that agree in both are the leaves of one node.

A fixed prefix would put every suffix that begins with a common word into one group. The prefix is
therefore of variable length. It first ends after the window's SEED words of the smallest hash, which any
two equal windows have at the same place. Neighbouring suffixes mostly share them, so they travel as one
run: the seed's hash, document, first word, and five bytes for each suffix. A first pass over the texts
counts how many suffixes each group would get; where they are more than SUFFIXES_IN_GROUP the prefix is lengthened
to the whole window, and the group is dealt out to as many as hold it. So a common phrase is one prefix but no
large group.

Within one task's chunk of documents equal windows are found before anything is sent: only the smallest
document's go to their group, the others are known repeats and travel with their document. So a passage
that a third of all documents hold reaches its group once from each chunk.

A row is told by its id and a hash of its text, so rows that share an id keep their own cuts; its windows are
compared with those of other ids. Rows without an id are no larger and no smaller than others: nothing of them
is removed, and nothing because of them.

Words are seen as 64-bit hashes. Suffixes of one node agree in the hash of the seed (64 bits) and in 40 bits more
of the window's; the words themselves are not compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import text_of
from tidebar.llm.word_hashes import mixed, sequence_hashes, word_hashes

WINDOW, SEED = 13, 4
SUFFIXES_IN_GROUP = 600_000
CHUNK_WORDS = 700_000
_RUN = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("check", "<i8"), ("start", "<u4"), ("n", "u1"), ("known", "u1")])


class _Chunk:
    """The suffixes of some documents: hash of window and seed, row and first word, and whether it is a known repeat."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray]], window: int):
        docs = sorted(docs, key=lambda d: d[0])
        words = np.concatenate([w for _, _, w in docs])
        sizes = np.array([len(w) for _, _, w in docs])
        ids, checks = (np.repeat(np.array([d[k] for d in docs], np.int64), sizes) for k in (0, 1))
        begin = np.cumsum(sizes) - sizes
        self.at = at = np.flatnonzero(np.arange(len(words)) < np.repeat(begin + sizes - window + 1, sizes))
        self.hashes = hashes = sequence_hashes(words, window)[at]
        seeds = sequence_hashes(words, SEED)
        spread = window - SEED + 1
        least, where = seeds[: len(seeds) - spread + 1].copy(), np.zeros(len(seeds) - spread + 1, np.int64)
        for j in range(1, spread):
            rival = seeds[j : j + len(least)]
            better = rival < least
            least[better], where[better] = rival[better], j
        self.seed, self.seat = least[at], where[at] + at
        self.start = (at - np.repeat(begin, sizes)[at]).astype(np.uint32)
        self.doc, self.check = ids[at], checks[at]
        doc = self.doc
        # equal windows of this chunk: documents come in order of their ids, so the first is the smallest
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
        smallest = np.empty(len(at), np.int64)
        smallest[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        self.known = doc > smallest

    def group(self, groups: int) -> np.ndarray:
        """The group of each suffix by its seed; known repeats go with their document."""
        return (mixed(np.where(self.known, self.check.view(np.uint64), self.seed)) % np.uint64(groups)).astype(np.int64)

    def counts(self, groups: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups that would get at least `least` suffixes of this chunk, and how many."""
        found, n = np.unique(self.group(groups)[~self.known], return_counts=True)
        return found[n >= least], n[n >= least]

    def runs(self, groups: int, parts: dict[int, int]) -> Iterator[tuple[int, int, bytes]]:
        """(group, part, packed runs); a group with parts is dealt out by the whole window."""
        group, part = self.group(groups), np.zeros(len(self.at), np.int64)
        for g, n in parts.items():
            split = (group == g) & ~self.known
            part[split] = (mixed(self.hashes[split]) % np.uint64(n)).astype(np.int64)
        known = self.known
        apart = np.array([True]), (self.seat[1:] != self.seat[:-1]) | (self.at[1:] != self.at[:-1] + 1) | (known[1:] != known[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(np.concatenate(apart))
        run = np.zeros(len(first), _RUN)
        run["seed"], run["doc"], run["check"], run["start"], run["known"] = self.seed[first], self.doc[first], self.check[first], self.start[first], known[first]
        run["n"] = np.diff(np.concatenate([first, [len(self.at)]]))
        # a document's known repeats are no part of a tree, whatever the parts of its group
        key = group * (max(parts.values(), default=1) + 1) + part
        sent = np.flatnonzero(~known)
        sent = sent[np.argsort(key[sent], kind="stable")]
        tails = np.ascontiguousarray(self.hashes[sent].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        sent_key, run_key = key[sent], key[first]
        by_key = np.argsort(run_key, kind="stable")
        run, run_key, run_first = run[by_key], run_key[by_key], first[by_key]
        for k in np.unique(run_key):
            a, b = np.searchsorted(run_key, [k, k + 1])
            c, d = np.searchsorted(sent_key, [k, k + 1])
            yield int(group[run_first[a]]), int(part[run_first[a]]), int(b - a).to_bytes(8, "little") + run[a:b].tobytes() + tails[c:d].tobytes()


def _nodes(seed: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order, by prefix and window, and where in it the nodes at the depth of the window begin."""
    order = np.argsort(mixed(seed) + tail)
    s, t = seed[order], tail[order]
    key = mixed(s) + t
    if ((key[1:] == key[:-1]) & ((s[1:] != s[:-1]) | (t[1:] != t[:-1]))).any():  # different suffixes with one sum
        order = np.lexsort((tail, seed))
        s, t = seed[order], tail[order]
    return order, np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])]))


def _repeats(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, check, first start and number of consecutive repeated windows, from one group's runs."""
    runs, tails = [], []
    for b in blobs:
        n = int.from_bytes(b[:8], "little")
        runs.append(np.frombuffer(b, _RUN, n, 8))
        tails.append(np.frombuffer(b, np.uint8, -1, 8 + n * _RUN.itemsize).reshape(-1, 5))
    run = np.concatenate(runs)
    known, run = run[run["known"] > 0], run[run["known"] == 0]
    doc, check, start = (np.zeros(0, np.int64) for _ in range(3))
    if len(run):
        wide = np.zeros((int(run["n"].sum()), 8), np.uint8)
        wide[:, :5] = np.concatenate(tails)
        of = np.repeat(run["doc"], run["n"])
        place = np.repeat(run["start"].astype(np.int64), run["n"]) + np.arange(len(of)) - np.repeat(np.cumsum(run["n"], dtype=np.int64) - run["n"], run["n"])
        order, heads = _nodes(np.repeat(run["seed"], run["n"]), wide.view("<u8")[:, 0])
        smallest = np.repeat(np.minimum.reduceat(of[order], heads), np.diff(np.concatenate([heads, [len(order)]])))
        late = order[of[order] > smallest]
        late.sort()
        doc, check, start = of[late], np.repeat(run["check"], run["n"])[late], place[late]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (check[1:] != check[:-1]) | (start[1:] != start[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([new, [len(doc)]]))
    return np.concatenate([doc[new], known["doc"]]), np.concatenate([check[new], known["check"]]), np.concatenate([start[new], known["start"].astype(np.int64)]), np.concatenate([counts, known["n"].astype(np.int64)])


def _chunks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[_Chunk]:
    """Documents of a task in chunks of about CHUNK_WORDS words."""
    held, size = [], 0
    for batch in batches:
        for i, check, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = word_hashes(text.as_py())
            if len(words) >= window:
                held.append((i, check, words))
                size += len(words)
            if size >= CHUNK_WORDS:
                yield _Chunk(held, window)
                held, size = [], 0
    if held:
        yield _Chunk(held, window)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """own_id, id, check, text of every row."""
    x = docs.select(F.col(id_column).alias("own_id"), F.col(id_column).cast("long").alias("id"), text_of(text_column).cast("binary").alias("text"))
    return x.withColumn("check", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, check, start, n: runs of n windows, from word `start` on, that also start in a document with a smaller id; check is a hash of the row's text.

    A run may be given in parts. Null and empty texts have no windows. Rows with a null id are left out.
    """
    source = _rows(docs, id_column, text_column).where("id IS NOT NULL").select("id", "check", "text")
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(64, chars // (6 * SUFFIXES_IN_GROUP))
    # of a group's suffixes, chunks that send fewer than this hold no more than one group's worth together
    least = max(1, SUFFIXES_IN_GROUP // (chars // (6 * CHUNK_WORDS) + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, window):
            found, n = chunk.counts(groups, least)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["group", "n"])

    large = source.mapInArrow(count, "group long, n long").groupBy("group").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * SUFFIXES_IN_GROUP)
    parts = {r.group: 2 + r.n // SUFFIXES_IN_GROUP for r in large.collect()}  # at most half as many as there are groups

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, window):
            for group, part, blob in chunk.runs(groups, parts):
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([part], pa.int64()), pa.array([blob], pa.binary())], ["group", "part", "runs"])

    def build(group: pa.Table) -> pa.Table:
        doc, check, start, n = _repeats([b.as_py() for b in group.column("runs")])
        return pa.table({"id": doc, "check": check, "start": start.astype(np.int32), "n": n.astype(np.int32)})

    runs = source.mapInArrow(cut, "group long, part long, runs binary")
    return runs.groupBy("group", "part").applyInArrow(build, "id long, check long, start int, n int")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id column, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window that covers it also starts in a document with a smaller id; windows are judged on
    the input. Nulls and empty texts have no words. Rows that share an id are documents of their own, neither smaller than the
    other; of rows without an id nothing is removed, and nothing because of them. Ids are numbers. Other columns are
    not read. An empty table gives an empty one.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    repeats = repeated_windows(docs, window, id_column, text_column).groupBy("id", "check").agg(F.collect_list(F.struct("start", "n")).alias("cut"))
    rows = _rows(docs, id_column, text_column)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, text = [], [], []
            for value, cut in zip(batch.column(1), batch.column(2), strict=True):
                words = value.as_py().split()
                total.append(len(words))
                kept = words
                if cut.is_valid and len(cut):
                    spans = cut.values
                    start = spans.field("start").to_numpy().astype(np.int64)
                    end = np.minimum(start + spans.field("n").to_numpy() + window - 1, len(words))
                    depth = np.cumsum(np.bincount(np.minimum(start, len(words)), minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1))
                    kept = [words[i] for i in np.flatnonzero(depth[:-1] <= 0)]
                gone.append(len(words) - len(kept))
                text.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    joined = rows.join(repeats, ["id", "check"], "left").select("own_id", "text", "cut")
    return joined.mapInArrow(drop, f"id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_column)
