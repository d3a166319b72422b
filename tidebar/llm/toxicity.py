"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Folding makes spellings alike: case, accents, letters of other scripts that look Latin, digits and signs that
stand for letters. Everything else between words becomes one space. Entries are whole words and word
beginnings; an exception phrase (an entry with the word before or after it) that clean texts use takes back
the match inside it. Entries, weights (log-odds) and exceptions are learned from labelled rows.
A text's matched weight and its weight by length give the score through a logistic fit.

Training reads at most TRAINING_ROWS labelled rows, those with the smallest hash of their id; labels
enter nowhere else.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import stored, text_of

TRAINING_ROWS = 20_000
#: Word beginnings of these lengths may become entries.
BEGINNINGS = (4, 5, 6)
LEAST_ROWS, LEAST_WEIGHT = 3, 2.0

# Characters read as a Latin letter, as text.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "i", "ø": "o", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "l": "i",
}
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE or unicodedata.combining(c):
            out = ""
        else:
            base = unicodedata.normalize("NFKD", c).lower()
            out = "".join(LOOK_ALIKES.get(x, x) for x in base if not unicodedata.combining(x))
            out = "".join(x if x.isalnum() else " " for x in out)
        self[code] = out
        return out


_FOLD = _Fold()


#: Signs that stand for a letter inside a word, but after one are what they are.
_ENDS = re.compile(r"[!|]++(?!\w)")


def folded(text: str) -> str:
    """Folded words, each between two spaces. Any number of "!" or "|" at the end of a word end it instead of being letters."""
    words = _ENDS.sub(" ", text).lower().translate(_FOLD).split()
    return f" {' '.join(words)} "


def _terms(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        out.update(f" {w[:k]}" for k in BEGINNINGS if len(w) > k)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    fit: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a

    def matched(self, a: ahocorasick.Automaton, text: str) -> tuple[float, int]:
        """Weight of the words that entries match, the largest for each word, and the number of words."""
        found: dict[int, float] = {}
        taken: list[tuple[int, int]] = []
        if len(a):
            for end, (size, w) in a.iter(text):
                begin = end - size + 1
                if w is None:
                    taken.append((begin, end))
                elif w > found.get(begin, 0.0):
                    found[begin] = w
        # how far the exception phrases reach that begin at or before a place
        taken.sort()
        begins, reach = [x for x, _ in taken], list(accumulate((y for _, y in taken), max))
        free = lambda b: not (k := bisect_right(begins, b)) or reach[k - 1] <= b
        weight = sum(w for b, w in sorted(found.items()) if free(b))
        return weight, text.count(" ") - 1

    @staticmethod
    def features(weight: float, words: int) -> tuple[float, float]:
        return math.log1p(weight), math.log1p(1000 * weight / max(words, 1))

    def score(self, weight: float, words: int) -> float:
        if not self.weights:
            return self.prior
        x, y = self.features(weight, words)
        z = self.fit[0] + self.fit[1] * x + self.fit[2] * y
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """label, text: different texts of at most `limit` labelled rows."""
    some = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("key")).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    some = some.orderBy(F.xxhash64("key"), "key").limit(limit)  # so small a table may be broadcast
    texts = docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text")).join(F.broadcast(some), "key")
    return texts.groupBy(F.xxhash64("text").alias("same")).agg(F.max("label").alias("label"), F.first("text").alias("text")).select("label", "text")


def _counted(rows: DataFrame, terms_of) -> DataFrame:
    """term, toxic, clean: the numbers of rows of each kind that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                kinds[1 if label else 0].update(terms_of(folded(text.as_py())))
            names = sorted(kinds[0] | kinds[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([kinds[1][n] for n in names], pa.int64()), pa.array([kinds[0][n] for n in names], pa.int64())], ["term", "toxic", "clean"])

    return rows.select("label", "text").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.05 * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(3)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Lexicon:
    """Learn a lexicon. Null labels and ids are left out; without toxic rows the lexicon is empty."""
    rows = stored(training_rows(docs, labels, limit, id_column, text_column, label_column))
    totals = {r.label: r["count"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    out = Lexicon(prior=toxic / (toxic + clean) if toxic else 0.0)
    if not toxic:
        return out

    def terms(text: str) -> set[str]:
        return _terms(set(text.split()))

    # log-odds, and whether they are above 0 by two deviations
    odds = F.ln((F.col("toxic") + 0.5) / (toxic + 1)) - F.ln((F.col("clean") + 0.5) / (clean + 1))
    sure = odds > 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = _counted(rows, terms).where((F.col("toxic") >= LEAST_ROWS) & (odds >= LEAST_WEIGHT) & sure).select("term", odds.alias("w"), "toxic")
    out.weights = {r.term: r.w for r in telling.orderBy("term").collect()}  # at most the words and beginnings of the toxic ones of `limit` rows

    words = frozenset(t.strip() for t in out.weights if t.endswith(" "))

    def phrases(text: str) -> set[str]:
        w = text.split()
        return {f" {a} {b} " for a, b in zip(w, w[1:]) if a in words or b in words}

    if words:
        clearing = _counted(rows, phrases).where((F.col("clean") >= LEAST_ROWS) & (odds <= 0))
        out.exceptions = {r.term for r in clearing.select("term").collect()}  # at most the phrases of `limit` rows that hold an entry

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = out.automaton()
        for batch in batches:
            both = [out.features(*out.matched(a, folded(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in both], pa.float64()), pa.array([y for _, y in both], pa.float64())], ["label", "x", "y"])

    got = rows.select("label", "text").mapInArrow(measured, "label int, x double, y double").toPandas()  # at most `limit` rows of numbers
    out.fit = _logistic(got[["x", "y"]].to_numpy(), (got["label"] > 0).to_numpy().astype(float))
    return out


def toxicity(docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id column, score (0 to 1), predicted (1 if score >= 0.5), matched_weight, n_words.

    Null and empty texts match nothing and get the score of no match. Rows are scored one by one, whatever
    their ids; other columns are not read. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            found = [lexicon.matched(a, folded(t.as_py())) for t in batch.column(1)]
            scores = [lexicon.score(*f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([w for w, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["id", "score", "predicted", "matched_weight", "n_words"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int, matched_weight double, n_words long").withColumnRenamed("id", id_column)


def accepted(docs: DataFrame, lexicon: Lexicon, text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below 0.5. Null and empty texts are accepted if no match is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            at = batch.schema.get_field_index(text_column)
            keep = [lexicon.score(*lexicon.matched(a, folded(t.as_py() or ""))) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
