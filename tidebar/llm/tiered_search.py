"""Exact ranked search over a tiered index: postings of high impact first.

A posting's impact is the part of the score that term and document give apart from the term's weight. Each term's
postings are cut by impact into tiers; what lies below a tier is bounded by one number, the largest
impact there. All items are scored over the first tier. An item is proven there once its last wanted place
is above the sum of its terms' residual bounds: then no document unseen so far can reach the list, and only
documents whose score plus the bounds of the terms they have not shown yet reach that place are completed from the lower
tiers. Items without this proof fall through to the next tier; the last leaves nothing below, so it proves all.
Terms in few documents lie in the first tier whole, so their bound, with the largest weights, is 0.

The index is a table of shards, each of some documents, with a column for every tier: a round reads only
the columns it needs, and nothing is shuffled but each shard's best rows. It holds the terms that the items
ask for, found by the words themselves. Items come in blocks of bounded vocabulary, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebar.llm.common import forget, stored, text_of

#: Terms of a block of items, which every task holds; items beyond it form further blocks.
BLOCK_TERMS = 500_000
SHARD_POSTINGS = 2_000_000
#: What the tiers but the last hold of a term's postings: a share, or as many postings if that is more.
TIERS = ((0.05, 1_000), (0.30, 5_000))
#: Impacts are counted by this many steps of their logarithm.
LEVELS = 512
IMPACT = 1_000_000_000
# Fixed value: bytes that part terms, and A-Z as a-z.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_TOP_LEVEL = math.log(1_000_001)


def terms_of(text: str) -> list[bytes]:
    """The terms of a whole text, in order."""
    return text.encode().translate(_FOLD).split()


def _level(impact: np.ndarray) -> np.ndarray:
    """Steps from 0 to LEVELS - 1, never falling as the impact rises."""
    return np.minimum((np.log(impact + 1.0) / _TOP_LEVEL * LEVELS).astype(np.int64), LEVELS - 1)


@dataclass
class Corpus:
    """N, L and the documents that hold each term, by its number."""

    documents: int
    length: int
    holding: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.holding[term] + 1)))

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.documents) // max(self.length, 1)
        return (IMPACT * tf) // (1000 * tf + 20 * m)


def _postings(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """Shards of documents: ids, their numbers of terms, and postings (term, document's place, tf), sorted by term."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        n: list[int] = []
        term: list[int] = []
        doc: list[int] = []
        tf: list[int] = []

        def shard() -> pa.RecordBatch:
            own = np.zeros((3, len(term)), np.int32)
            own[0], own[1], own[2] = term, doc, tf
            own = own[:, np.argsort(own[0], kind="stable")]
            ids = pa.concat_arrays(held)
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.array(n, np.int64).tobytes()]), pa.array([own.tobytes()])]
            return pa.RecordBatch.from_arrays(arrays, ["ids", "n", "postings"])

        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                counts = Counter(words)
                for w in vocabulary.keys() & counts.keys():
                    term.append(vocabulary[w]), doc.append(len(n)), tf.append(counts[w])
                n.append(len(words))
                held.append(batch.column(0).slice(row, 1))
                if len(term) + len(n) >= SHARD_POSTINGS:
                    yield shard()
                    held, n, term, doc, tf = [], [], [], [], []
        if n:
            yield shard()

    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    return source.mapInArrow(read, f"ids array<{kind}>, n binary, postings binary")


def _unpacked(n: pa.Scalar, postings: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.frombuffer(n.as_buffer(), np.int64)
    return size, *np.frombuffer(postings.as_buffer(), np.int32).reshape(3, -1)


def _counted(shards: DataFrame) -> Corpus:
    """What the weights and impacts need of the whole corpus; a row for each term of the block comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, term, _, _ = _unpacked(batch.column(0)[row], batch.column(1)[row])
                found, df = np.unique(term, return_counts=True)
                out = np.concatenate([[-1, -2], found]), np.concatenate([[len(size), size.sum()], df])
                yield pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int32)), pa.array(out[1].astype(np.int64))], ["term", "n"])

    rows = shards.select("n", "postings").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return Corpus(found.pop(-1, 0), found.pop(-2, 0), found)


def _borders(shards: DataFrame, corpus: Corpus, tiers: tuple[tuple[float, int], ...]) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
    """By term and tier: the lowest level in it, and the largest impact below it (the last tier has none below)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, term, doc, tf = _unpacked(batch.column(0)[row], batch.column(1)[row])
                impact = corpus.impacts(tf.astype(np.int64), size[doc])
                key = term.astype(np.int64) * LEVELS + _level(impact)
                order = np.lexsort((impact, key))
                last = np.flatnonzero(np.concatenate([key[order][1:] != key[order][:-1], [True]])) if len(key) else np.zeros(0, np.int64)
                found, largest = key[order][last], impact[order][last]
                yield pa.RecordBatch.from_arrays([pa.array((found // LEVELS).astype(np.int32)), pa.array((found % LEVELS).astype(np.int32)), pa.array(np.diff(np.concatenate([[-1], last]))), pa.array(largest)], ["term", "level", "n", "largest"])

    levels = shards.select("n", "postings").mapInArrow(run, "term int, level int, n long, largest long").groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))
    by = Window.partitionBy("term")
    ranked = levels.withColumns({"before": F.sum("n").over(by.orderBy(F.desc("level"))) - F.col("n"), "all": F.sum("n").over(by)})
    inside = lambda share, least: F.col("before") < F.greatest(F.ceil(F.col("all") * share), F.lit(least))
    columns: list[Column] = []
    for t, (share, least) in enumerate(tiers):
        columns += [F.min(F.when(inside(share, least), F.col("level"))).alias(f"low{t}"), F.coalesce(F.max(F.when(~inside(share, least), F.col("largest"))), F.lit(0)).alias(f"below{t}")]
    low, below = {}, {}
    for r in ranked.groupBy("term").agg(F.max("all").alias("all"), *columns).collect():  # one row for each term of the block
        low[r.term] = tuple(r[f"low{t}"] for t in range(len(tiers)))
        below[r.term] = (*(r[f"below{t}"] for t in range(len(tiers))), 0)
    return low, below


def _tiered(shards: DataFrame, corpus: Corpus, low: dict[int, tuple[int, ...]], tiers: int) -> DataFrame:
    """The index: ids and a column for each tier, with term, document's place and impact of its postings."""

    lows = np.zeros((max(low, default=0) + 1, tiers - 1), np.int64)
    for term, levels in low.items():
        lows[term] = levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size, term, doc, tf = _unpacked(batch.column(1)[row], batch.column(2)[row])
                impact = corpus.impacts(tf.astype(np.int64), size[doc])
                tier = (_level(impact)[:, None] < lows[term]).sum(axis=1)
                cells = [pa.array([np.stack([term, doc, impact.astype(np.int32)])[:, tier == t].tobytes()]) for t in range(tiers)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *cells], ["ids", *(f"tier{t}" for t in range(tiers))])

    kind = shards.schema["ids"].dataType.simpleString()
    return stored(shards.mapInArrow(run, f"ids {kind}, " + ", ".join(f"tier{t} binary" for t in range(tiers))))


@dataclass
class _Item:
    number: int
    terms: list[int]
    weights: np.ndarray


class _Shard:
    """A shard's postings of the tiers read so far, by term."""

    def __init__(self, cells: list[pa.Scalar], documents: int):
        self.documents = documents
        self.tiers = []
        for cell in cells:
            term, doc, impact = np.frombuffer(cell.as_buffer(), np.int32).reshape(3, -1)
            self.tiers.append((term, doc, impact))

    def of(self, term: int, tiers: range) -> tuple[np.ndarray, np.ndarray]:
        docs, impacts = [], []
        for t in tiers:
            terms, doc, impact = self.tiers[t]
            a, b = np.searchsorted(terms, [term, term + 1])
            docs.append(doc[a:b])
            impacts.append(impact[a:b])
        return np.concatenate(docs), np.concatenate(impacts).astype(np.int64)

    def scores(self, item: _Item, tiers: range, below: dict[int, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Per document: its score over these tiers, and by how much what the lower tiers may add falls short of the sum of the item's bounds."""
        score, shown = np.zeros(self.documents, np.int64), np.zeros(self.documents, np.int64)
        for term, weight in zip(item.terms, item.weights, strict=True):
            doc, impact = self.of(term, tiers)  # a document is in a term's postings once
            score[doc] += weight * impact
            shown[doc] += weight * below[term][tiers[-1]]
        return score, shown


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of positive scores that may be among the k largest, ties at the last place whole."""
    some = np.flatnonzero(score > 0)
    if len(some) <= k:
        return some
    least = np.partition(score[some], len(some) - k)[len(some) - k]
    return some[score[some] >= least]


def _rounds(index: DataFrame, items: list[_Item], below: dict[int, tuple[int, ...]], tiers: int, k: int) -> Iterator[DataFrame]:
    """For each tier, the best documents of the items that are proven there: item, id, score."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"item int, id {kind}, score long"
    left = items

    def scored(own: list[_Item], reach: int, read: int, least: dict[int, int] | None) -> DataFrame:
        """Best rows over `reach` tiers; with `least`, exact scores over all tiers of documents that may come to it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    ids = batch.column(0)[row].values
                    shard = _Shard([batch.column(1 + t)[row] for t in range(read)], len(ids))
                    number, place, value = [], [], []
                    for item in own:
                        score, shown = shard.scores(item, range(reach), below)
                        if least is not None:
                            bound = sum(int(w) * below[t][reach - 1] for t, w in zip(item.terms, item.weights, strict=True))
                            may = score + bound - shown >= least[item.number]
                            rest, _ = shard.scores(item, range(reach, read), below)
                            score = np.where(may, score + rest, 0)
                        best = _best(score, k)
                        number.append(np.full(len(best), item.number, np.int32)), place.append(best), value.append(score[best])
                    if number:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number)), ids.take(pa.array(np.concatenate(place))), pa.array(np.concatenate(value))], ["item", "id", "score"])

        return index.select("ids", *(f"tier{t}" for t in range(read))).mapInArrow(run, schema)

    for t in range(tiers):
        if not left:
            return
        if t == tiers - 1:
            yield scored(left, tiers, tiers, None)
            return
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
        last = scored(left, t + 1, t + 1, None).withColumn("place", place).where(F.col("place") == k)
        least = {r.item: r.score for r in last.select("item", "score").collect()}  # a row for each item of the block
        bound = {i.number: sum(int(w) * below[term][t] for term, w in zip(i.terms, i.weights, strict=True)) for i in left}
        proven = [i for i in left if bound[i.number] < least.get(i.number, 0)]
        if proven:
            yield scored(proven, t + 1, tiers, {i.number: least[i.number] for i in proven})
        left = [i for i in left if bound[i.number] >= least.get(i.number, 0)]


def _item_blocks(items: DataFrame, id_column: str, text_column: str, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """(id, distinct terms) of items in blocks that hold at most `most` terms, or one item."""
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for r in items.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).toLocalIterator():
        terms = sorted(set(terms_of(r.text)))
        if block and size + len(terms) > most:
            yield block
            block, size = [], 0
        block.append((r.id, terms))
        size += len(terms)
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", tiers: tuple[tuple[float, int], ...] = TIERS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per item its k best documents with a score above 0: item column, rank (from 1), id column, score.

    Equal scores go by ascending id, a null id last. Null and empty texts hold no term: such a document is not
    counted, such an item has no rows. Every row is a document, and an item, of its own, also where ids repeat or are null. Other columns are not read.
    Empty tables give an empty result.
    """
    kinds = f"`{item_column}` {items.schema[item_column].dataType.simpleString()}"
    spark, parts = docs.sparkSession, []
    for block in _item_blocks(items, item_column, item_text, block_terms):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, terms in block for w in terms}))}
        shards = stored(_postings(docs, vocabulary, id_column, text_column))
        corpus = _counted(shards)
        low, below = _borders(shards, corpus, tiers)
        index = _tiered(shards, corpus, low, len(tiers) + 1)
        forget(shards)
        own = [_Item(i, held := [vocabulary[w] for w in terms if vocabulary[w] in corpus.holding], np.array([corpus.weight(t) for t in held], np.int64)) for i, (_, terms) in enumerate(block)]
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, {kinds}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        for found in _rounds(index, [i for i in own if i.terms], below, len(tiers) + 1, k):
            best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            parts.append(best.join(F.broadcast(names), "item").select(item_column, "rank", F.col("id").alias(id_column), "score"))
    if not parts:
        return spark.createDataFrame([], f"{kinds}, rank int, `{id_column}` {docs.schema[id_column].dataType.simpleString()}, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
