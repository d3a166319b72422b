"""Packing against the library's ids, best fit piece by piece, and the bounds of every capacity."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import fixtures
from tidebar.llm import queries, vector_packing
from tidebar.llm.vector_packing import Capacities, best_fit, packed


@pytest.fixture(scope="module")
def library() -> Tokenizer:
    t = Tokenizer.from_file(queries.WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def one_by_one(lengths, capacities) -> int:
    """Sequences that best fit by the norm takes, one piece after the other."""
    whole = capacities.vector()
    bins: list[list[int]] = []
    for n in sorted(lengths, reverse=True):
        need = (n, 1, n * n)
        best = min((i for i, b in enumerate(bins) if all(r >= x for r, x in zip(b, need, strict=True))), key=lambda i: sum(((r - x) / w) ** 2 for r, x, w in zip(bins[i], need, whole, strict=True)), default=None)
        if best is None:
            best = len(bins)
            bins.append(list(whole))
        bins[best] = [r - x for r, x in zip(bins[best], need, strict=True)]
    return len(bins)


@pytest.mark.parametrize("capacities", [Capacities(100), Capacities(100, 5), Capacities(100, 7, 3000), Capacities(1), Capacities(100, None, 2500)])
def test_histogram_packs_as_piece_by_piece(capacities):
    rng = random.Random(2)
    for _ in range(40):
        lengths = [min(capacities.longest(), rng.choice([rng.randint(1, 100), rng.randint(1, 12)])) for _ in range(rng.randint(0, 250))]
        for rule in ("norm", "dot"):
            patterns = best_fit(dict(Counter(lengths)), capacities, rule)
            got: Counter = Counter()
            for count, runs in patterns:
                tokens, documents, attention = capacities.vector()
                assert sum(n * k for n, k in runs) <= tokens and sum(k for _, k in runs) <= documents and sum(n * n * k for n, k in runs) <= attention
                got.update({n: 0 for n, _ in runs})
                for n, k in runs:
                    got[n] += k * count
            assert got == Counter(lengths)
            if rule == "norm":
                assert sum(c for c, _ in patterns) == one_by_one(lengths, capacities)


def test_no_sequence_for_a_piece():
    with pytest.raises(ValueError, match="fits no sequence"):
        best_fit({50: 1}, Capacities(100, None, 2000))
    with pytest.raises(ValueError, match="no such rule"):
        best_fit({}, rule="first")


def test_ids_of_odd_texts(library):
    rng = random.Random(3)
    odd = [*"abcXYZ\t\n\x0b\x0c\r\x1c\x1f\x85\xa0  09²½<|>'’!?.ÀéñÿŸİıſßΣσς́̈e일漢🙂क़", "'s", "'RE", "'ll", "<|endoftext|>", "<|startoftext|>", "é"]
    plain = list("abXY's'tREllD \t\n\x0b\x1c\x1f09<|>!À éñÿ×÷ª")
    own = vector_packing.encoder(queries.WORD_BPE)
    for letters in (odd, plain):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
            assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def check(pieces, ids_of, capacities):
    """pieces: (id, piece, start, length, crc, sequence, offset); ids_of: each row's ids, in any order."""
    want = Counter()
    for i, ids in ids_of:
        step = capacities.longest()
        for p, a in enumerate(range(0, len(ids), step)):
            part = ids[a : a + step]
            want[i, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(p[:5] for p in pieces) == want
    sequences = defaultdict(list)
    for *_, length, _, sequence, offset in pieces:
        sequences[sequence].append((offset, length))
    for held in sequences.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:j]) for j in range(len(held))]  # gapless
        for bound, used in zip(capacities.vector(), (sum(n for _, n in held), len(held), sum(n * n for _, n in held)), strict=True):
            assert used <= bound
    return len(sequences)


@pytest.mark.parametrize(("capacities", "rule"), [(Capacities(), "norm"), (Capacities(256, 4, 30_000), "norm"), (Capacities(256, 4, 30_000), "dot")])
def test_whole_table(spark, tmp_path, library, capacities, rule):
    folder = fixtures.write(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(4)
    ids_of = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    out = packed(docs, queries.WORD_BPE, capacities, rule, with_ids=True)
    got = [tuple(r) for r in out.drop("ids").collect()]
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    n = check(got, ids_of, capacities)
    lengths = Counter(p[3] for p in got)
    if rule == "norm":
        assert n == one_by_one(lengths.elements(), capacities)
    held = vector_packing.sequences(out).collect()
    assert len(held) == n and Counter(x for r in held for x in r.ids) == Counter(x for _, ids in ids_of for x in ids)
    assert all(r.starts[0] == 0 and len(r.ids) <= capacities.tokens for r in held)


def test_contract_on_given_tables(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    ids_of = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in rows]
    got = [tuple(r) for r in queries.op13_sequence_packing(spark, folder).collect()]
    least = -(-sum(len(ids) for _, ids in ids_of) // 4096)
    assert least <= check(got, ids_of, Capacities()) <= least + 1


def test_empty_null_and_hot(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packed(none, queries.WORD_BPE).collect() == []
    same = spark.createDataFrame([(None if i % 7 == 0 else 5, None if i % 2 else "") for i in range(900)], "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS rank").repartition(6)
    got = [tuple(r) for r in packed(same, queries.WORD_BPE, Capacities(100)).collect()]
    assert check(got, [(r.doc_id, [1]) for r in same.collect()], Capacities(100)) == 9
