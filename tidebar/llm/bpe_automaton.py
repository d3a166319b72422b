"""Byte-level BPE as a deterministic automaton over tokens.

Compilation adds one merge gadget after another, in rank order. States are tokens (all arcs with one
label lead to one state), arcs say which token may follow which. It starts with the 256 byte tokens,
every byte allowed after every byte. The gadget of merge (u, v) -> w

* deletes the arc v from state u: those two are from now on written w;
* adds the label w wherever u stood (its column is u's column at that moment);
* adds the state w, which goes on as v did (its row is v's row at that moment).

Rows and columns are stored as these references with their moment, not copied, so that the table of
50,000 gadgets takes a few MB; a cell is looked up by following the references and kept once read.
The correct encoding of a pre-split word is the one path whose labels spell it; `Automaton.walk` finds it
by table look-ups, longest label first, and never enters a dead position twice. Decoding writes the
labels of the ids' arcs one after the other.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import text_of

# Fixed value: the byte-level pre-tokenisation pattern of the vocabulary file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in a task, and look-ups kept; both start anew when full.
CACHED_WORDS, CACHED_ARCS = 300_000, 1_000_000
NEVER = 1 << 30


def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files of this kind write bytes: printable ones as themselves, others from 256 up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Automaton:
    """States are token ids; `may_follow` is the transition table, `walk` and `emit` use it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = _byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        size = 1 + max([*vocab.values(), *special.values()])
        self.label: list[bytes] = [b""] * size
        self.ids: dict[bytes, int] = {}
        for token, i in vocab.items():
            if token not in special:
                self.label[i] = spell(token)
                self.ids[self.label[i]] = i
        self.born = [-1] * size
        self.row_of, self.column_of = [0] * size, [0] * size
        self.deleted: dict[tuple[int, int], int] = {}
        for moment, (left, right) in enumerate(merges):
            self._gadget(moment, vocab[left], vocab[right], vocab[left + right])
        self.special = special
        for token, i in special.items():
            self.label[i] = token.encode()
        self.longest = max(map(len, self.ids), default=1)
        self.arcs: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        return cls(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})

    def _gadget(self, moment: int, u: int, v: int, w: int) -> None:
        self.deleted[u, v] = moment
        self.column_of[w], self.row_of[w], self.born[w] = u, v, moment

    def may_follow(self, state: int, label: int) -> bool:
        """Whether the finished table has an arc `label` at `state`."""
        key = state << 32 | label
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= CACHED_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._cell(state, label)
        return found

    def _cell(self, x: int, y: int) -> bool:
        moment = NEVER  # the cell as it stood once the gadgets before this moment were in
        while True:
            if self.deleted.get((x, y), NEVER) < moment:
                return False
            bx, by = self.born[x], self.born[y]
            if bx == by:
                if x != y or bx < 0 or self.column_of[x] == self.row_of[x]:
                    return True
                moment, x, y = bx, self.row_of[x], self.column_of[y]
            elif by > bx:  # the column was taken from its left part, after that gadget's deletion
                moment, y = by + 1, self.column_of[y]
            else:  # the row was taken from its right part, before that gadget's deletion
                moment, x = bx, self.row_of[x]

    def walk(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        whole = self.ids.get(word)
        if len(word) == 1:
            return [whole]
        path: list[int] = []
        ends = [0]
        dead: set[int] = set()
        limit = self.longest
        at, most = 0, min(len(word), limit)
        get, n = self.ids.get, len(word)
        while at < n:
            state = path[-1] if path else -1
            for k in range(most, 0, -1):
                i = get(word[at : at + k])
                if i is not None and (at + k, i) not in dead and (state < 0 or self.may_follow(state, i)):
                    path.append(i)
                    at += k
                    ends.append(at)
                    most = min(n - at, limit)
                    break
            else:  # no arc leads on: the last token was wrong here
                last = path.pop()
                dead.add((ends.pop(), last))
                at = ends[-1]
                most = min(n - at, limit)
        return path

    def emit(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


@functools.cache
def compiled(path: str) -> Automaton:
    """One automaton for each worker process and file."""
    return Automaton.from_file(path)


class _Spaced(dict):
    """Ids of chunks that follow one space, filled as they are asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(" " + chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Splits texts into words and walks each new word once.

    A space between two non-spaces always begins a word, so a text is cut there first and known chunks
    are not split again; texts with other white space beside a space are split as a whole.
    """

    def __init__(self, path: str):
        self.automaton = compiled(path)
        self.words = regex.compile(WORDS)
        self.uneven = re.compile(r" (?:\s|\Z)|\A ")
        special = sorted(self.automaton.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, bytes] = {}
        self.spaced = _Spaced(self._split)

    def _split(self, text: str) -> bytes:
        known, walk, out = self.known, self.automaton.walk, []
        for word in self.words.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = b"".join(i.to_bytes(4, "little") for i in walk(word.encode()))
                if len(word) <= 64:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if self.uneven.search(text):
            return self._split(text)
        first, *rest = text.split(" ")
        return self._split(first) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Strings of special tokens become those tokens."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), self.automaton.special[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: list[int]) -> str:
        return self.automaton.emit(ids).decode("utf-8", errors="replace")


def encode_texts(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id column, `ids` (array of int) and `decoded`, in one pass without a shuffle.

    A null text counts as empty and gives no ids. Rows with equal or null ids are encoded each for itself.
    Other columns of docs are not read, so their names cannot clash. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            for row in range(batch.num_rows):
                raw = encoder.encode(batch.column(1)[row].as_py())
                ids = memoryview(raw).cast("I").tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([ids], pa.list_(pa.int32())), pa.array([encoder.decode(ids)])], ["id", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)


def encode_digests(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """encode_texts() with digests instead of ids and texts, which then never leave the task.

    Per row: id column, n_tokens, ids_sha256, decoded_sha256. Nulls, repeats and empty tables as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        emit = encoder.automaton.emit
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                raw = encoder.encode(value.as_py())
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                spelt = emit(memoryview(raw).cast("I").tolist())
                text_sha.append(hashlib.sha256(spelt.decode("utf-8", errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
