"""Documents as token pieces, packed into sequences by vector best fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths, as
attention stays within a document). Pieces come longest first; each goes to the sequence that can take it
under every capacity and whose residual is best: by the weighted norm of what would be left (rule "norm"), or by the
weighted dot product of piece and residual direction, the smaller norm among equals (rule "dot").

Pieces of one length are alike, and so are sequences of one residual. So the choice is made once for all
pieces of a length, over residuals with the number of sequences that have them: the driver sees a histogram
of at most `tokens` lengths, whatever the number of documents, and returns patterns with how often each is used.
Under the norm rule that gives what piece by piece would give: of a length, the next piece's best
sequence is the one that has just taken one, as long as it can.
Then every piece finds its place from its rank among those of its length. A task numbers its own pieces
while it encodes them; the numbers of the tasks before it are added by a join over (length, task), so a length
that many documents share is never one group.

The vocabulary file cuts texts before it merges letters, so a text's ids are those of its parts one after
the other, and parts seen before are looked up. Texts of plain letters are cut just as the file does it;
others, where normalisation may join letters, only at spaces, which no token spans.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import stored, text_of

#: Parts of texts kept with their ids in a task, and the longest that is kept; the store starts anew when full.
CACHED_PARTS, CACHED_CHARS = 1_000_000, 64
# Fixed value: how the vocabulary file splits texts that hold only ASCII and the precomposed letters below \xFF.
PARTS = re.compile(r"'(?:[sS]|[tT]|[rR][eE]|[vV][eE]|[mM]|[lL][lL]|[dD])|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+", re.ASCII)
UNEVEN = re.compile(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]")


@dataclass(frozen=True)
class Capacities:
    """What one sequence holds. documents and attention: None leaves only the bound that the tokens set."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2

    def longest(self) -> int:
        """The longest piece that an empty sequence takes."""
        tokens, _, attention = self.vector()
        return min(tokens, math.isqrt(attention))


class _Open:
    """Residuals of open sequences, with how many have each and what they hold."""

    def __init__(self, least: int):
        self.least = least
        self.residual, self.count = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        self.holds: list[tuple] = []
        self.closed: list[tuple[int, tuple]] = []

    def put(self, residual: np.ndarray, count: int, holds: tuple) -> None:
        if residual[0] < self.least or residual[1] < 1 or residual[2] < self.least**2:
            self.closed.append((count, holds))
            return
        self.residual = np.vstack([self.residual, residual])
        self.count = np.append(self.count, count)
        self.holds.append(holds)

    def take(self, at: int, n: int) -> None:
        self.count[at] -= n
        if not self.count[at]:
            self.residual, self.count = np.delete(self.residual, at, 0), np.delete(self.count, at)
            del self.holds[at]


def best_fit(lengths: dict[int, int], capacities: Capacities = Capacities(), rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of sequences, [(length, pieces of it), ...]) for a histogram of piece lengths."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    whole = np.array(capacities.vector(), np.int64)
    scale = np.sqrt(np.array(weights)) / whole
    bins = _Open(min(lengths, default=1))
    for length in sorted(lengths, reverse=True):
        need, left = np.array([length, 1, length**2], np.int64), lengths[length]
        if length < 1 or (need > whole).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((bins.residual >= need).all(axis=1))
            if len(fits):
                after = (((bins.residual[fits] - need) * scale) ** 2).sum(axis=1)
                if rule == "dot":
                    room = bins.residual[fits] * scale
                    along = (room * (need * scale)).sum(axis=1) / np.sqrt((room**2).sum(axis=1))
                    best = fits[np.lexsort((after, -along))[0]]
                else:
                    best = fits[after.argmin()]
                residual, count, holds = bins.residual[best], int(bins.count[best]), bins.holds[best]
            else:
                best, residual, count, holds = -1, whole, left, ()
            each = int((residual // need).min())
            full, rest = min(count, left // each), 0
            if full < count:
                rest = left - full * each
            if best >= 0:
                bins.take(best, full + (rest > 0))
            for n, k in ((full, each), (1, rest)):
                if n and k:
                    bins.put(residual - need * k, n, (holds, length, k))
                    left -= n * k
    out = []
    for count, holds in [*bins.closed, *zip(bins.count.tolist(), bins.holds, strict=True)]:
        runs = []
        while holds:
            holds, length, k = holds
            runs.append((length, k))
        out.append((int(count), runs[::-1]))
    return out


@dataclass
class _Places:
    """For ranks of a length from `start` on: the first sequence, pieces of that length in each, and the offset of the first."""

    key: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, patterns: list[tuple[int, list[tuple[int, int]]]]) -> _Places:
        rows, begun, base = [], {}, 0
        for count, runs in patterns:
            offset = 0
            for length, k in runs:
                start = begun.get(length, 0)
                rows.append((length << 48 | start, base, k, offset))
                begun[length] = start + count * k
                offset += length * k
            base += count
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(*(np.ascontiguousarray(c) for c in table.T))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << 48 | rank
        at = np.searchsorted(self.key, key, side="right") - 1
        nth = key - self.key[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


class _Known(dict):
    """Ids of parts, filled as they are asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.make(part, add_special_tokens=False).ids, "<u4").tobytes()
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHED_PARTS:
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers; each part of a text is asked for once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(tokenizer.encode)

    def encode(self, text: str) -> bytes:
        plain = text.isascii() or not UNEVEN.search(text)
        parts = PARTS.findall(text) if plain and not any(s in text for s in self.special) else text.split(" ")
        return b"".join(map(self.known.__getitem__, parts))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, longest: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id column, piece, start, length, ids_crc32, the task that made it and its number there among those of its length; on wish `ids` too.

    A document's ids are those of its whole text and end_id; only what is longer than `longest` is cut. A null text
    counts as empty: it is the one id end_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * longest
        for batch in batches:
            row, piece, length, nth, crc, blobs = [], [], [], [], [], []
            for i, raw in enumerate(map(own.encode, batch.column(1).to_pylist())):
                raw += end
                for k, at in enumerate(range(0, len(raw), step)):
                    blob = raw[at : at + step]
                    n = len(blob) // 4
                    row.append(i), piece.append(k), length.append(n), crc.append(zlib.crc32(blob)), nth.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        blobs.append(blob)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * longest), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<u4").astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [*names, "ids"][: len(columns)])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def packed(docs: DataFrame, tokenizer_path: str, capacities: Capacities = Capacities(), rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0), end_id: int = 1, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id column, piece, start, length, ids_crc32, sequence_id, offset; on wish `ids` too.

    Null and empty texts are pieces of one id. Rows with equal or null ids are documents of their own. Other
    columns are not read, so their names cannot clash. An empty table gives an empty one.
    """
    made = stored(token_pieces(docs, tokenizer_path, capacities.longest(), end_id, id_column, text_column, with_ids))
    own = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r.length: r.n for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # as many as a sequence has tokens, at most
    places = _Places.of(best_fit(lengths, capacities, rule, weights))
    before = own.selectExpr("length AS of_length", "part AS of_part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")
    ranked = made.join(before, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part"))).withColumn("rank", F.col("before") + F.col("nth"))
    names = [id_column, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    source = ranked.select(*names, "rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", sequence_id long, offset long"
    return source.mapInArrow(place, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, and where each of its documents begins, from packed(..., with_ids=True); a sequence is bounded by its capacity."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(held.alias("held")).select("sequence_id", F.flatten(F.col("held.ids")).alias("ids"), F.col("held.offset").alias("starts"))
