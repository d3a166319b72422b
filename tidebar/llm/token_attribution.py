"""Token counts of sections, from one encoding of the whole document.

Encoding each section by itself would count other tokens than the model sees, as words and white space
merge across borders. So the document is encoded once, every token keeps its span, and the spans are
joined with the sections' intervals (both are sorted: a binary search for each border).
A token that crosses a border goes, by `rule`, to the section of its first byte ("first") or to the one
that holds most of its bytes, the earlier one in a tie ("largest").
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.bpe_automaton import Encoder
from tidebar.llm.common import text_of


def attribute(ends: np.ndarray, borders: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section. ends: end byte of each token; borders: end byte of each section."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    last = len(borders) - 1
    home = np.minimum(np.searchsorted(borders, starts, side="right"), last)
    if rule == "largest":
        for t in np.flatnonzero(borders[home] < ends):  # tokens across a border
            cuts = np.unique(np.clip(np.concatenate([[starts[t]], borders[home[t] :], [ends[t]]]), starts[t], ends[t]))
            best = cuts[int(np.argmax(np.diff(cuts)))]
            home[t] = min(int(np.searchsorted(borders, best, side="right")), last)
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(home, minlength=len(borders))


def section_tokens(docs: DataFrame, tokenizer_path: str, separator: str = "\n", rule: str = "first", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per section of each row: id column, section (from 0), start_char, end_char, n_tokens.

    Sections end after each separator. A null or empty text is one empty section without tokens. Repeated
    rows give repeated sections; other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        lengths = np.array([len(x) for x in encoder.automaton.label], np.int64)
        for batch in batches:
            rows, section, start, end, n = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                text = value.as_py()
                parts = text.split(separator)
                parts = [p + separator for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])
                ids = np.frombuffer(encoder.encode(text), np.uint32)
                borders = np.cumsum([len(p.encode()) for p in parts])
                chars = np.cumsum([len(p) for p in parts])
                rows += [row] * len(parts)
                section += range(len(parts))
                start += [0, *chars[:-1].tolist()]
                end += chars.tolist()
                n += attribute(np.cumsum(lengths[ids]), borders, rule).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(section, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int64())], ["id", "section", "start_char", "end_char", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).mapInArrow(run, f"id {kind}, section int, start_char long, end_char long, n_tokens long").withColumnRenamed("id", id_column)
