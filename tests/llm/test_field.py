"""What the field learns from, and that its pruning loses no path."""

from __future__ import annotations

import random
from itertools import product

import numpy as np

from tidebar.llm import secret_crf
from tidebar.llm.secret_crf import BEGIN, INSIDE, OUTSIDE


def test_sequences_without_secrets_are_kept():
    with_secrets = [([[i]], [BEGIN]) for i in range(500)]
    without = [([[i]], [OUTSIDE]) for i in range(20)]
    got = secret_crf.bounded(with_secrets + without, 30)
    assert sum(t == [OUTSIDE] for _, t in got) == 20 and sum(t == [BEGIN] for _, t in got) == 30


def test_stretches_come_from_anywhere_and_one_text_gives_few():
    rows = [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(20)]
    firsts = {f for r in rows for seq, _ in secret_crf.examples(r) for f in seq[0] if f.startswith("p=")}
    assert len(firsts) > 10
    # around spans, around other numbers, from anywhere, and twice for each span put elsewhere
    assert len(secret_crf.examples("password=abcdef12 word x1y2z3 " * 500)) <= 4 * secret_crf.PER_ROW + 1


def test_the_end_of_a_long_text_draws_as_its_beginning_does():
    head = "plain words here " * 1000
    one, two = (secret_crf.examples(f"{head} token = abcdef0123456789 {tail} " + "token = abcdef0123456789 and so on " * 40) for tail in ("x", "y"))
    assert one != two and len(one) == len(two)
    long_word = "w" * 40
    assert secret_crf.word_features(long_word + "a") != secret_crf.word_features(long_word + "b")


def test_secrets_that_no_pattern_matches_are_found_and_numbers_are_not(spark):
    """Planted in the plain texts of the given table, on which the field is trained: random letters and digits of 20 to 40 characters in forms that no pattern knows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = secret_crf.Tagger(secret_crf.train(docs))
    rng, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = [r.text for r in docs.where("length(text) > 200").orderBy("doc_id").select("text").limit(600).collect()]
    planted = found = wrong = 0
    for text in texts:
        if secret_crf.base_spans(text):
            continue
        secret = "".join(rng.choice(letters) for _ in range(rng.randint(20, 40)))
        words = text.split(" ")
        words.insert(rng.randrange(len(words)), rng.choice(["the key is %s", "Bearer %s", "use %s to log in", "%s"]) % secret)
        with_it = " ".join(words)
        at = with_it.index(secret)
        spans = tagger.spans(with_it)
        planted += 1
        found += (at, at + len(secret)) in spans
        wrong += sum(not (a < at + len(secret) and b > at) for a, b in spans)
    assert planted > 300 and found >= 0.85 * planted and wrong <= 0.01 * planted
    plain = "on 2024-05-17 at 12:30:11 from 152.143.123.131 call +1 (555) 010-9999 card 4111 1111 1111 1111 v1.2.3 of 10.0.0.1:8080 see http://example.org/a/b/c123 mail a.b99@c-d.org order 12345678901234567890 size 1,234,567 or 3.14159265"
    assert tagger.spans(plain) == []


def test_length_alone_is_no_code():
    text = "a plain line; of words that goes on for very long indeed " * 4
    text += "x" * (500 - len(text))
    assert secret_crf.file_kind(text) == secret_crf.file_kind(text * 6000)


def test_pruning_keeps_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(300):
        field = secret_crf.Field.blank(["s=a12", "s=a21", "s=a30", "s=A11", "s=A20", "s=012", "s=010", "s=A10"] + [f"s={secret_crf.shape(w)}" for w in ("a", "abc", "A1", "77777", "+")])
        field.weights[:] = rng.normal(0, 12, field.weights.shape)
        field.moves += rng.uniform(-5, 5, (3, 3))
        field.moves[OUTSIDE, INSIDE] = -20
        words = [str(w) for w in rng.permutation(["a", "abc", "A1", "77777", "+"])]
        tagger = secret_crf.Tagger(field)
        got = tagger.spans(" ".join(words))
        e = np.array([field.weight(secret_crf.token_features(w)[0]) for w in words])
        best = max(product(range(3), repeat=5), key=lambda t: field.start[t[0]] + sum(e[i][x] for i, x in enumerate(t)) + sum(field.moves[x, y] for x, y in zip(t, t[1:])))
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        want: list[list[int]] = []
        for i, tag in enumerate(best):
            if tag == BEGIN or tag == INSIDE and not (i and best[i - 1] != OUTSIDE):
                want.append([int(ends[i]) - len(words[i]), int(ends[i])])
            elif tag == INSIDE:
                want[-1][1] = int(ends[i])
        assert got == [tuple(w) for w in want]
