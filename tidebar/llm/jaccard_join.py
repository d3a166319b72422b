"""Exact Jaccard join of documents' word shingles with a token-group matrix.

1. Sets. Each text becomes its set of shingle hashes; texts with one set are one set from here on.
2. Candidates. Two sets that link share one of their first n - ceil(t n) + 1 tokens in any fixed order of
   tokens. Ours is (frequent, hash): a sketch of all documents' shingles, of fixed size, tells which tokens
   are frequent. They come last, so passages that many documents hold are seldom among the first; what
   the sketch errs in costs time only.
3. Groups. In each round every set is compared with two leaders of each of its first tokens that still meets
   several groups. Linked sets become one group. The first round's leaders are the most central sets, whose
   first tokens are the most shared ones: the text that near copies come from has none of their changes.
   Other rounds draw leaders at random, as long as that finds links. Copies thus hang together after comparisons
   in proportion to their number.
4. The matrix. For first tokens that still meet several groups, a row (group, token) says that the union of
   the group's first tokens holds the token, in sets of which sizes, and how early. Two bounds close groups.
   By place: of two linked sets the first common token stands so early in both that enough tokens follow; so
   (100 + t) times its place is at most 100 times the own size less t times the other's. By number: of the
   tokens that two sets share, those up to the earlier end of their first tokens are first tokens of both; so c,
   the number of a set's first tokens in a group's row, and the tokens that are not first bound the overlap with
   every member. Of two groups the smaller one asks. Only groups where both bounds allow a link are opened.
5. In an opened group the set meets the members that hold a common token early enough for the pair, and is
   compared with those whose common first tokens allow a link. Where a group shows one set only, the bounds
   have decided on that pair already. Of the set's c tokens in the group's row a linked member shares some
   number at least, so the first shared one is not among the last of the row; those do not ask. So no link between groups is missed; links
   within a group change nothing. A set with too many tokens of its own meets nobody, however large the group.

Nothing but the sketch reaches the driver. Set ids are 64-bit hashes, checked against 128-bit digests; if two
sets shared an id, another seed would be drawn.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import forget, stored, text_of
from tidebar.llm.components import components
from tidebar.llm.word_hashes import mixed, sequence_hashes, word_hashes

SHINGLE, PERCENT = 5, 80
ROUNDS = 3
#: A round that finds fewer links than one in so many of all so far is the last: the matrix decides on the rest as well.
PAYING = 100
#: The sketch: one counter for each of 2**SKETCH_BITS values of a hash, in rows of 2**ROW_BITS.
SKETCH_BITS, ROW_BITS = 22, 16
#: Tasks' counters meet in this many lanes, then in fewer: a group of the tree has as many members as there are tasks for each lane of the first, and 64 in the second.
LANES = (4096, 64, 1)
EMPTY = 0


def shingle_set(text: bytes, shingle: int = SHINGLE, seed: int = 0) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; the whole sequence if it has fewer words."""
    words = word_hashes(text, fold=True, seed=seed)
    if not len(words):
        return words
    hashes = sequence_hashes(words, min(shingle, len(words)))
    hashes.sort()  # np.unique collects them in a hash table first, which takes five times as long
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]


def set_id(tokens: np.ndarray) -> tuple[int, bytes]:
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), digest


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _long(tokens: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(tokens).view(np.int64))


def _first_batch(tokens: list, sets: list, sizes: list, places: list) -> pa.RecordBatch:
    n, at = (pa.array(np.concatenate(x).astype(np.int32)) for x in (sizes, places))
    return pa.RecordBatch.from_arrays([_long(np.concatenate(tokens)), pa.array(np.concatenate(sets)), n, at], ["token", "set", "n", "at"])


class _Join:
    def __init__(self, docs: DataFrame, id_column: str, text_column: str, shingle: int, percent: int, seed: int):
        self.shingle, self.percent, self.seed = shingle, percent, seed
        text = text_of(text_column)
        self.source = docs.select(F.col(id_column).alias("id"), text.cast("binary").alias("text"))
        self.texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("check"), text.cast("binary").alias("text"))

    def sets(self) -> DataFrame:
        """id, check, n, set, digest of every row; and the sketch's rows, which have `part`."""
        shingle, seed = self.shingle, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["id", "check", "n", "set", "digest", "part", "lane", "counts"]
            counters = np.zeros(1 << SKETCH_BITS, np.uint8)
            kind = None
            for batch in batches:
                kind = batch.column(0).type
                n, sets, digests = [], [], []
                for value in batch.column(2):
                    tokens = shingle_set(value.as_py(), shingle, seed)
                    n.append(len(tokens))
                    s, d = set_id(tokens) if len(tokens) else (EMPTY, b"")
                    sets.append(s)
                    digests.append(d)
                    at = (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                    counters[at] += counters[at] < 255  # once for a document, also where several tokens meet one counter
                none = pa.nulls(batch.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.int64()), pa.array(digests, pa.binary()), none, none, pa.nulls(batch.num_rows, pa.binary())], names)
            if kind is not None:
                parts, blobs = [], []
                for part, row in enumerate(counters.reshape(-1, 1 << ROW_BITS)):
                    some = np.flatnonzero(row)
                    if len(some):
                        parts.append(part)
                        blobs.append(b"\0" + row.tobytes() if 3 * len(some) > len(row) else b"\1" + some.astype("<u2").tobytes() + row[some].tobytes())
                m, lane = len(parts), TaskContext.get().partitionId() % LANES[0]
                yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.binary()), pa.array(parts, pa.int32()), pa.array([lane] * m, pa.int32()), pa.array(blobs, pa.binary())], names)

        kind = self.texts.schema["id"].dataType.simpleString()
        return self.texts.mapInArrow(run, f"id {kind}, check long, n long, set long, digest binary, part int, lane int, counts binary")

    @staticmethod
    def frequent(sketch: DataFrame) -> np.ndarray:
        """One flag for each counter: more documents than chance gives. 2**SKETCH_BITS bits, whatever the input.

        Counters are summed in a tree, lane by lane, so no task gathers those of all tasks.
        """

        def total(part: pa.Table) -> np.ndarray:
            counts = np.zeros(1 << ROW_BITS, np.int64)
            for blob in part.column("counts"):
                raw = np.frombuffer(blob.as_py(), np.uint8)
                if raw[0] == 2:
                    counts += np.frombuffer(raw[1:].tobytes(), "<i8")
                elif raw[0]:
                    m = (len(raw) - 1) // 3
                    counts[np.frombuffer(raw[1 : 1 + 2 * m].tobytes(), "<u2")] += raw[1 + 2 * m :]
                else:
                    counts += raw[1:]
            return counts

        def summed(lanes: int) -> Callable[[pa.Table], pa.Table]:
            def run(part: pa.Table) -> pa.Table:
                lane = part.column("lane")[0].as_py() % lanes
                return pa.table({"part": part.column("part")[:1], "lane": pa.array([lane], pa.int32()), "counts": pa.array([b"\2" + total(part).astype("<i8").tobytes()], pa.binary())})

            return run

        def flagged(part: pa.Table) -> pa.Table:
            counts = total(part)
            mean = float(np.median(counts))
            flags = counts > mean + 5 * math.sqrt(mean) + 6
            return pa.table({"part": part.column("part")[:1], "flags": pa.array([np.packbits(flags).tobytes()], pa.binary())})

        for lanes in LANES[1:]:
            sketch = sketch.groupBy("part", "lane").applyInArrow(summed(lanes), "part int, lane int, counts binary")
        flags = np.zeros((1 << (SKETCH_BITS - ROW_BITS), (1 << ROW_BITS) // 8), np.uint8)
        for row in sketch.groupBy("part").applyInArrow(flagged, "part int, flags binary").collect():
            flags[row.part] = np.frombuffer(row.flags, np.uint8)
        return flags.reshape(-1)

    def first_tokens(self, frequent: np.ndarray) -> DataFrame:
        """token, set, n, at: of every document, the tokens of which two linked sets share one, with their places; n tokens in all."""
        shingle, percent, seed = self.shingle, self.percent, self.seed
        flags = self.source.sparkSession.sparkContext.broadcast(frequent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common = np.unpackbits(flags.value).view(bool)
            for batch in batches:
                tokens, sets, sizes, places, size = [], [], [], [], 0
                for value in batch.column(0):
                    every = shingle_set(value.as_py(), shingle, seed)
                    if not len(every):
                        continue
                    some = len(every) - -(-percent * len(every) // 100) + 1
                    late = common[(every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first = np.concatenate([every[~late], every[late]])[:some]
                    tokens.append(first)
                    sets.append(np.full(len(first), set_id(every)[0]))
                    sizes.append(np.full(len(first), len(every)))
                    places.append(np.arange(len(first)))
                    size += len(first)
                    if size > 200_000:
                        yield _first_batch(tokens, sets, sizes, places)
                        tokens, sets, sizes, places, size = [], [], [], [], 0
                if size:
                    yield _first_batch(tokens, sets, sizes, places)

        return self.source.select("text").mapInArrow(run, "token long, set long, n int, at int")

    def texts_of(self, sets: DataFrame, rows: DataFrame) -> DataFrame:
        """set, text: one text of each set."""
        one = rows.where("n > 0").groupBy("set").agg(F.min(F.struct("id", "check")).alias("one"))
        wanted = sets.join(one, "set").select("set", F.col("one.id").alias("id"), F.col("one.check").alias("check"))
        found = wanted.withColumnRenamed("id", "wanted_id").join(self.texts, F.col("id").eqNullSafe(F.col("wanted_id")) & (self.texts["check"] == wanted["check"]))
        return stored(found.select("set", "text"))

    def links(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        shingle, percent, seed = self.shingle, self.percent, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, y = None, None
            for batch in batches:
                keep = []
                for i, b in enumerate(batch.column(1).to_pylist()):
                    if b != last:
                        last, y = b, shingle_set(batch.column(3)[i].as_py(), shingle, seed)
                    keep.append(linked(shingle_set(batch.column(2)[i].as_py(), shingle, seed), y, percent))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        a = texts.select(F.col("set").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("set").alias("b"), F.col("text").alias("text_b"))
        return stored(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))

    def enough(self, c: Column, na: Column, nb: Column) -> Column:
        """Whether sets of na and nb tokens that share c of their first tokens may link."""
        t = self.percent
        rest = F.greatest(F.floor(na * t / 100.0 - 1e-9), F.floor(nb * t / 100.0 - 1e-9))
        return (100 + t) * (c + rest) >= t * (na + nb)

    def least_common(self, na: Column, nb: Column) -> Column:
        """The number of common first tokens below which enough() fails."""
        t = self.percent
        rest = F.greatest(F.floor(na * t / 100.0 - 1e-9), F.floor(nb * t / 100.0 - 1e-9))
        return F.ceil(t * (na + nb) / (100.0 + t) - 1e-9) - rest

    def room(self, at: Column, n: Column) -> Column:
        """A set of m tokens links with one of n tokens only if t m is at most the room behind their first common token, in either."""
        return 100 * n.cast("long") - (100 + self.percent) * at

    def near_in_size(self, na: Column, nb: Column) -> Column:
        return 100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)

    def promising(self, pairs: DataFrame, shared: DataFrame) -> DataFrame:
        """The pairs (a, b) whose common first tokens allow a link."""
        a = shared.select(F.col("set").alias("a"), "token", F.col("n").alias("na"))
        b = shared.select(F.col("set").alias("b"), "token", F.col("n").alias("nb"))
        counts = pairs.join(a, "a").join(b, ["b", "token"]).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
        return counts.where(self.enough(F.col("c"), F.col("na"), F.col("nb"))).select("a", "b")


def _split(shared: DataFrame, groups: DataFrame | None) -> DataFrame:
    """token, set, n, at, central, group for the tokens whose sets lie in several groups."""
    if groups is None:
        return shared.withColumn("group", F.col("set"))
    of = shared.join(groups.withColumnRenamed("node", "set"), "set", "left").select("token", "set", "n", "at", "central", F.coalesce("root", "set").alias("group"))
    of = stored(of)
    several = stored(of.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("token"))
    return stored(of.join(several, "token"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id column, n_shingles, component_id (smallest id reachable by links, itself included).

    Null and empty texts have no shingles and link with nothing; their component is their own id. Repeated
    rows have the same set and so one component. A null id is the component's id only if no other member
    has an id. Other columns are not read. An empty table gives an empty one.
    """
    for seed in range(8):
        join = _Join(docs, id_column, text_column, shingle, percent, seed)
        every = stored(join.sets())
        rows = every.where("part IS NULL")
        clash = rows.groupBy("set").agg((F.min("digest") != F.max("digest")).alias("clash")).where("clash")
        if clash.isEmpty():
            break
        forget(every)
    else:
        raise ValueError("different sets of shingles had equal hashes under every seed")
    frequent = join.frequent(every.where("part IS NOT NULL").select("part", "lane", "counts"))
    first = stored(join.first_tokens(frequent))
    several = stored(first.groupBy("token").agg(F.min("set").alias("low"), F.max("set").alias("high"), F.count(F.lit(1)).alias("sets")).where("low < high").select("token", "sets"))
    met = stored(first.join(several, "token").distinct())
    forget(first, several)
    central = stored(met.groupBy("set").agg((F.sum("sets") / F.first("n")).alias("central")))
    shared = stored(met.join(central, "set").select("token", "set", "n", "at", "central"))
    forget(met, central)
    texts = join.texts_of(shared.select("set").distinct(), rows)
    tried = groups = None
    links, split = 0, _split(shared, None)
    for turn in range(ROUNDS):
        order = F.xxhash64("set", F.lit(turn))
        first_choice = F.struct((-F.col("central") if turn == 0 else F.lit(0.0)).alias("c"), order.alias("o"), F.col("set").alias("s"), F.col("group").alias("g"), F.col("n").alias("n"))
        second = F.struct(F.lit(0.0).alias("c"), order.alias("o"), F.col("set").alias("s"), F.col("group").alias("g"), F.col("n").alias("n"))
        leaders = stored(split.groupBy("token").agg(F.min(first_choice).alias("one"), F.max(second).alias("two")))
        met = split.join(leaders, "token").select("set", "n", "group", F.explode(F.array("one", "two")).alias("leader"))
        met = met.where((F.col("leader.g") != F.col("group")) & join.near_in_size(F.col("n"), F.col("leader.n")))
        pairs = met.select(F.least("set", "leader.s").alias("a"), F.greatest("set", "leader.s").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        ahead = stored(join.promising(pairs, shared))
        new = join.links(ahead, texts)
        forget(ahead, leaders)
        tried = pairs if tried is None else tried.unionAll(pairs)
        found = new.count()
        links += found
        if found or groups is None:
            groups = components(new, groups)
            forget(split)
            split = _split(shared, groups)
        if PAYING * found < links or split.isEmpty():
            break
    if not split.isEmpty():
        pairs = stored(_opened(join, split).join(tried, ["a", "b"], "left_anti"))
        ahead = stored(join.promising(pairs, shared))
        groups = components(join.links(ahead, texts), groups)
        forget(pairs, ahead)
    forget(texts, split, shared)

    of = rows.join(groups.withColumnRenamed("node", "set"), "set", "left").select("id", "n", "set", F.coalesce("root", "set").alias("group"))
    of = stored(of)
    least = stored(of.where("n > 0").groupBy("group").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    out = of.withColumn("group", F.when(F.col("n") > 0, F.col("group"))).join(least, "group", "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _opened(join: _Join, split: DataFrame) -> DataFrame:
    """(a, b): sets of two groups that share a first token early enough to link, one of which opens the other's group."""
    t = join.percent
    rank = split.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    rows = stored(split.join(rank, "group").select("token", "set", "n", "group", "size", join.room(F.col("at"), F.col("n")).alias("room")))
    matrix = stored(rows.groupBy("token", F.col("group").alias("other"), F.col("size").alias("other_size")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("most_room")))
    asks = F.struct("size", "group") < F.struct(F.col("other_size").alias("size"), F.col("other").alias("group"))
    early = (t * F.col("n") <= F.col("most_room")) & (t * F.col("low") <= F.col("room")) & (t * F.col("n") <= 100 * F.col("high"))
    met = stored(rows.join(matrix, "token").where(asks & early).select("set", "n", "other").distinct())
    # the number of the set's first tokens in the group's row of the matrix
    held = met.join(rows.select("set", "token"), "set").join(matrix.select("token", "other", "low", "high"), ["token", "other"])
    bound = held.groupBy("set", "n", "other").agg(F.count(F.lit(1)).alias("c"), F.min("low").alias("least"), F.max("high").alias("most"))
    low, high = F.greatest("least", F.floor(F.col("n") * t / 100.0)), F.least("most", F.ceil(F.col("n") * 100.0 / t))
    more = F.col("c") + 1  # sizes between the two differ by rounding
    may = (low <= high) & (join.enough(more, F.col("n"), low) | join.enough(more, F.col("n"), high))
    opened = stored(bound.where(may).select("set", "other", (F.col("c") - F.least(join.least_common(F.col("n"), low), join.least_common(F.col("n"), high)) + 2).alias("asking")))
    # a group that shows one set: its rows of the matrix are that set's, so the bounds held for the pair itself
    alone = rows.groupBy(F.col("group").alias("other")).agg(F.min("set").alias("b"), F.max("set").alias("last")).where("b = last").select("other", "b")
    single = opened.join(alone, "other").select("set", "b")
    # of c tokens in the group's row, at least so many common ones: the first of these is among the first `asking`
    members = rows.join(alone, rows["group"] == alone["other"], "left_anti").select("token", F.col("set").alias("b"), F.col("n").alias("nb"), F.col("room").alias("room_b"), F.col("group").alias("other"))
    asked = rows.join(opened.join(alone, "other", "left_anti"), "set").select("token", "set", "n", "room", "other", "asking").join(matrix.select("token", "other"), ["token", "other"])
    place = F.row_number().over(Window.partitionBy("set", "other").orderBy(F.desc("room")))
    asked = asked.withColumn("place", place).where("place <= asking")
    pairs = asked.join(members, ["token", "other"]).where((t * F.col("n") <= F.col("room_b")) & (t * F.col("nb") <= F.col("room")))
    pairs = pairs.select("set", "b").unionByName(single)
    return stored(pairs.select(F.least("set", "b").alias("a"), F.greatest("set", "b").alias("b")).distinct())
