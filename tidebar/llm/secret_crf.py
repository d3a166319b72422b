"""Secrets by patterns and by a linear-chain conditional random field.

The patterns give the base spans. The field tags every token of a text as begin, inside or outside of a
secret, from the token's shape, its neighbours' shapes and words, and the file's kind, decoded by Viterbi;
its spans that no base span touches are added.

It is trained here, by stochastic gradient on the exact likelihood (forward-backward), on a bounded sample:
half of TRAINING_ROWS from the rows in which a pattern may match and half from the others, by the smallest hash
of id and text, whose base spans are the labels. Of each row it takes at most PER_ROW stretches around spans, as many around other tokens with
digits (numbers, addresses and dates are what a secret's shape must be told from) and one from anywhere, of all rows at most TRAINING_ROWS of either kind, all by hash. Neighbouring
words are features of the training, the secret's own text is not, only its shape; and each secret drawn is learned again in the midst of other text, by parts of its shape. So the field also marks a
token that looks like a secret where no pattern matches.

Decoding is exact and whole-text, yet cheap: a token outside the training's words has only its shape's weights,
which are summed once for each different shape, and a token whose "outside" leads by more than all transitions and its successor's "inside" could win back is
outside in the best sequence, so only the stretches between such tokens need Viterbi's steps.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import text_of

TRAINING_ROWS = 2_000
#: Of the tokens of a training row, those within this many of a span, and as many elsewhere.
NEAR = 6
#: Stretches around spans that one row may give.
PER_ROW = 8
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
CACHED_TOKENS = 200_000
# The base kinds in order, as patterns.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST_VALUE, LEAST_ACCESS = 6, 20
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+|[^\sA-Za-z0-9+/_.-]")


#: ASCII characters by class, so that tokens of one shape look alike.
_CLASSES = {i: "a" if chr(i).islower() else "A" if chr(i).isupper() else "0" if chr(i).isdigit() else "_" for i in range(128)}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE] if ":" in text or "=" in text else []
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(token: str) -> str:
    """Classes of characters, whether they mix, and the length's magnitude."""
    classes = ("a" if any("a" <= c <= "z" for c in token) else "") + ("A" if any("A" <= c <= "Z" for c in token) else "") + ("0" if any(c.isdigit() for c in token) else "") + ("_" if any(not c.isalnum() for c in token) else "") + ("é" if any(ord(c) > 127 for c in token) else "")
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    return f"{classes}{min(len(token).bit_length(), 7)}{min(changes, 3)}"


def shape_features(token: str) -> tuple[list[str], list[str], list[str]]:
    """What a token's shape says of itself, of the next token, and of the one before.

    Beside the whole shape there are its parts, in which capitals count as other letters do, so that a shape which the training lacks is judged by what it has in common with others.
    """
    s = shape(token)
    odd = sum(c.isdigit() for c in token) * 4 >= len(token) >= 8
    kinds = ("a" if any(c.isalpha() for c in token) else "") + ("0" if any(c.isdigit() for c in token) else "") + ("_" if any(not c.isalnum() for c in token) else "")
    return [f"s={s}", *(["odd"] if odd else []), f"mix={kinds}{s[-1]}", f"size={kinds}{s[-2]}"], [f"ps={s}"], [f"ns={s}"]


def word_features(token: str) -> tuple[list[str], list[str], list[str]]:
    """What a word says of its neighbours; of itself it says nothing."""
    w = token.lower()
    return [], [f"p={w}"], [f"n={w}"]


def token_features(token: str) -> tuple[list[str], list[str], list[str]]:
    return tuple(a + b for a, b in zip(shape_features(token), word_features(token), strict=True))


def file_kind(text: str) -> str:
    """A feature of the file: does it look like code or settings?"""
    signs = sum(text.count(c) for c in "={};")
    return f"file={min(3, int(400 * signs / max(len(text), 1)))}"


@dataclass
class Field:
    index: dict[str, int]  # the features of the training
    weights: np.ndarray  # features x 3
    moves: np.ndarray  # 3 x 3, from row to column
    start: np.ndarray  # 3

    @classmethod
    def blank(cls, features: list[str]) -> Field:
        moves = np.zeros((3, 3))
        moves[OUTSIDE, INSIDE] = -20.0  # nothing begins inside
        start = np.array([0.0, -20.0, 0.0])
        return cls({f: i for i, f in enumerate(features)}, np.zeros((len(features), 3)), moves, start)

    def weight(self, features: list[str]) -> np.ndarray:
        """Their sum; features that the training did not see weigh nothing."""
        return self.weights[[self.index[f] for f in features if f in self.index]].sum(0)

    def step(self, features: list[list[int]], tags: list[int], rate: float) -> None:
        """One gradient step on the log-likelihood of one sequence."""
        n = len(tags)
        e = np.array([self.weights[f].sum(0) for f in features])
        forward, backward = np.zeros((n, 3)), np.zeros((n, 3))
        forward[0] = self.start + e[0]
        for i in range(1, n):
            forward[i] = e[i] + np.logaddexp.reduce(forward[i - 1][:, None] + self.moves, axis=0)
        for i in range(n - 2, -1, -1):
            backward[i] = np.logaddexp.reduce(self.moves + e[i + 1] + backward[i + 1], axis=1)
        z = np.logaddexp.reduce(forward[-1])
        gold = np.eye(3)[tags]
        error = gold - np.exp(forward + backward - z)
        for f, g in zip(features, error, strict=True):
            np.add.at(self.weights, f, rate * g)
        if n > 1:
            joint = np.exp(forward[:-1, :, None] + self.moves + (e[1:] + backward[1:])[:, None, :] - z).sum(0)
            seen = np.zeros((3, 3))
            np.add.at(seen, (tags[:-1], tags[1:]), 1)
            self.moves += rate * 0.2 * np.clip(seen - joint, -4, 4)
            self.moves[OUTSIDE, INSIDE] = -20.0


def _spans_to_tags(tokens: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    tags = [OUTSIDE] * len(tokens)
    for _, start, end in spans:
        inside = [i for i, (a, b) in enumerate(tokens) if a < end and b > start]
        for k, i in enumerate(inside):
            tags[i] = INSIDE if k and tags[i] != BEGIN else BEGIN
    return tags


def _hash(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "big")


def bounded(sequences: list, limit: int) -> list:
    """At most `limit` sequences with secrets and as many without, those with the smallest hashes."""
    ordered = sorted(sequences, key=lambda s: (_hash(repr(s).encode("utf-8", "surrogatepass")), s[1]))
    kinds = [[s for s in ordered if any(t != OUTSIDE for t in s[1]) == secret] for secret in (True, False)]
    return kinds[0][:limit] + kinds[1][:limit]


def examples(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """Sequences for training: around base spans, around other tokens that have digits, and as long a stretch from anywhere, all drawn by hash.

    Each secret drawn comes twice more, put into the stretch from anywhere, so that its shape must tell where nothing around it does: once without its
    whole shape, once without its size too, so that the parts must tell where the whole was never seen.
    """
    spans = base_spans(text)
    # the secret value itself, without the key before it
    values = [(k, m.start(2), m.end(2)) for k, m in (("assign", m) for m in ASSIGN.finditer(text)) if len(m.group(2)) >= LEAST_VALUE] + [s for s in spans if s[0] != "assign"]
    tokens = [m.span() for m in TOKEN.finditer(text)]
    words = [text[a:b] for a, b in tokens]
    if not words:
        return []
    tags = _spans_to_tags(tokens, values)
    kind = file_kind(text)
    marked = [i for i, t in enumerate(tags) if t != OUTSIDE]
    seed = _hash(text.encode("utf-8", "surrogatepass"))
    some = lambda places: sorted(sorted(places, key=lambda i: _hash(b"%d %d" % (i, seed)))[:PER_ROW])
    numbers = [i for i, w in enumerate(words) if tags[i] == OUTSIDE and len(w) > 3 and any(c.isdigit() for c in w)]
    windows = [(max(0, i - NEAR), min(len(words), i + NEAR + 1)) for i in some(marked[::NEAR]) + some(numbers)]
    at = seed % max(1, len(words) - 2 * NEAR + 1)
    windows.append((at, min(len(words), at + 2 * NEAR)))
    stretches = [(words[max(0, a - 1) : b + 1], tags[a:b], 1 if a else 0, ()) for a, b in windows]
    if all(t == OUTSIDE for t in tags[at : at + 2 * NEAR]):
        held, middle = words[at : at + 2 * NEAR], min(NEAR, len(words) - at)
        moved = [i for i in some(marked[::NEAR]) if tags[i] == BEGIN]
        stretches += [([*held[:middle], words[i], *held[middle:]], [OUTSIDE] * middle + [BEGIN] + [OUTSIDE] * (len(held) - middle), 0, without) for i in moved for without in (("s=",), ("s=", "size="))]
    out = []
    for held, own, shift, without in stretches:
        feats = [token_features(w) for w in held]
        seq = []
        for i in range(len(own)):
            at = i + shift
            before = feats[at - 1][1] if at else []
            after = feats[at + 1][2] if at + 1 < len(feats) else []
            itself = [x for x in feats[at][0] if own[i] == OUTSIDE or not x.startswith(without)] if without else feats[at][0]
            seq.append(itself + before + after + [kind])
        out.append((seq, own))
    return out


def training_texts(docs: DataFrame, limit: int, id_column: str, text_column: str) -> DataFrame:
    """text of at most `limit` rows, half of them such that a pattern may match: those with the smallest hashes of id and text, repeated rows once."""
    text = text_of(text_column)
    hint = text.rlike(r"AKIA|[0-9a-f]{24}|[:=]")
    rows = docs.select(text.alias("text"), hint.cast("int").alias("hint"), F.xxhash64(F.col(id_column), text).alias("o"))
    parts = [rows.where(f"hint = {k}").select("o").distinct().orderBy("o").limit(limit // 2) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1]).distinct()  # so small a table may be broadcast
    return rows.join(F.broadcast(chosen), "o").groupBy("o").agg(F.first("text").alias("text")).select("text")


def train(docs: DataFrame, limit: int = TRAINING_ROWS, epochs: int = 2, id_column: str = "doc_id", text_column: str = "text") -> Field:
    """Fit the field on at most `limit` rows: half of them such that a pattern may match, half others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                for seq, tags in examples(value.as_py()):
                    flat = [len(f) for f in seq]
                    yield pa.RecordBatch.from_arrays([pa.array([flat]), pa.array([[x for f in seq for x in f]]), pa.array([tags])], ["sizes", "features", "tags"])

    got = training_texts(docs, limit, id_column, text_column).mapInArrow(run, "sizes array<long>, features array<string>, tags array<long>").toPandas()  # bounded by `limit`
    field = Field.blank(sorted({f for row in got["features"] for f in row}))
    sequences = []
    for sizes, features, tags in zip(got["sizes"], got["features"], got["tags"], strict=True):
        cuts = np.cumsum(sizes)[:-1]
        sequences.append(([[int(i) for i in x] for x in np.split(np.array([field.index[f] for f in features], np.int64), cuts)], [int(t) for t in tags]))
    sequences = bounded(sequences, limit)
    order = np.random.Generator(np.random.PCG64(7))
    for epoch in range(epochs):
        for i in order.permutation(len(sequences)):
            field.step(*sequences[i], rate=0.2 / (1 + epoch))
    return field


class _Rows(dict):
    """Row numbers of tokens in a table of weights: own, for the next token, for the one before."""

    def __init__(self, field: Field):
        self.field = field
        self.words = {f[2:] for f in field.index if f.startswith(("p=", "n="))}
        self.shapes: dict[str, int] = {}
        self.table = np.zeros((1024, 9), np.float32)
        self.used = 0

    def _add(self, parts: tuple[list[str], list[str], list[str]]) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = np.concatenate([self.field.weight(f) for f in parts])
        self.used += 1
        return self.used - 1

    def __missing__(self, token: str) -> int:
        if token.lower() in self.words:
            i = self._add(token_features(token))
        else:
            plain = token.translate(_CLASSES)
            i = self.shapes.get(plain)
            if i is None:
                i = self._add(shape_features(token))
                if len(plain) <= 64:
                    self.shapes[plain] = i
        if len(token) <= 64:
            self[token] = i
        return i


class Tagger:
    """Decodes whole texts with a trained field."""

    def __init__(self, field: Field):
        self.field = field
        # a tag made outside changes two transitions, and a third where the next tag must turn from inside to begin
        self.bound = float(6 * np.abs(np.delete(field.moves.ravel(), OUTSIDE * 3 + INSIDE)).max() + 1e-3)
        self.rows = _Rows(field)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each run of begin and inside."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        if len(self.rows) >= CACHED_TOKENS or self.rows.used >= CACHED_TOKENS:
            self.rows = _Rows(self.field)
        at = np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))
        every = self.rows.table[at]
        e = every[:, :3] + self.field.weight([file_kind(text)])
        e[1:] += every[:-1, 3:6]
        e[:-1] += every[1:, 6:9]
        lead = e[:, OUTSIDE] - e[:, :OUTSIDE].max(1)
        lead[:-1] -= np.maximum(e[1:, INSIDE] - e[1:, BEGIN], 0)
        unsure = np.flatnonzero(lead <= self.bound)
        if not len(unsure):
            return []
        out = []
        for stretch in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1):
            a, b = int(stretch[0]), int(stretch[-1]) + 1
            tags = self._viterbi(e[a:b], first=a == 0, last=b == len(e))
            for k, tag in enumerate(tags):
                if tag == BEGIN or (tag == INSIDE and (not out or out[-1][1] != a + k - 1)):
                    out.append([a + k, a + k])
                elif tag == INSIDE:
                    out[-1][1] = a + k
        if not out:
            return []
        found = [m.span() for m in TOKEN.finditer(text)]
        return [(found[a][0], found[b][1]) for a, b in out]

    def _viterbi(self, e: np.ndarray, first: bool, last: bool) -> list[int]:
        """The best tags of a stretch that stands between two tokens known to be outside, or at an end."""
        moves = self.field.moves
        score = e[0] + (self.field.start if first else moves[OUTSIDE])
        back = []
        for row in e[1:]:
            every = score[:, None] + moves
            back.append(every.argmax(0))
            score = every.max(0) + row
        if not last:
            score = score + moves[:, OUTSIDE]
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def secrets(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id column, spans (array of kind, start, end in code points; base spans and kind "field").

    Null and empty texts have no spans. Rows are tagged one by one, whatever their ids; other columns are
    not read. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py()
                base = base_spans(text)
                more = [("field", a, b) for a, b in tagger.spans(text) if not any(a < y and b > x for _, x, y in base)]
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in base + more])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["id", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("id", id_column)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with a mark in place of each span; overlapping spans get one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])
