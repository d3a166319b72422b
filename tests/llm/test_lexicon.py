"""Rare words that only toxic rows have are learned, however many toxic rows there are."""

from __future__ import annotations

import random

from tidebar.llm import toxicity


def test_rare_words_enter_the_lexicon(spark):
    word = lambda k: f"quux{chr(97 + k // 5)}{'bcdfg'[k % 5]}"
    rows = [(i, f"{word(i % 65)} common words here {i}", 1) for i in range(650)]
    rows += [(1000 + i, f"common words here number {i}", 0) for i in range(650)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic")).weights
    assert all(toxicity.folded(t.split()[0]) in weights for _, t, k in rows if k)


def test_exceptions_take_back_what_they_hold_also_in_very_long_texts():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon(weights={" bad ": 2.0, " wor": 1.0, " worse ": 3.0}, exceptions={" not bad ", " bad luck ", " worse off "})
    a = lexicon.automaton()
    words = ["bad", "worse", "world", "not", "luck", "off", "fine"]
    for _ in range(300):
        text = f" {' '.join(rng.choice(words) for _ in range(rng.randint(0, 12)))} "
        w = text.split()
        taken = {k for k in range(len(w) - 1) if f" {w[k]} {w[k + 1]} " in lexicon.exceptions}
        own = [{"bad": 2.0, "worse": 3.0, "world": 1.0}.get(x, 0.0) for x in w]
        want = sum(v for k, v in enumerate(own) if k not in taken and k - 1 not in taken)
        assert lexicon.matched(a, text)[0] == want
    long = " " + "not bad fine worse " * 200_000
    assert lexicon.matched(a, long) == (600_000.0, 800_000 - 1 + 1)
