"""Words are cut once, and as the pattern of the contract has them."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from tidebar.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLDED = str.maketrans(decontaminate.UPPER, decontaminate.LOWER)
ODD = [None, "", " ", "--", "a", " a ", "A,b;;C\n", "\x00x\x00\x00y\x7f", "0/9:@`{|}~", "ÄB äb ÉCOLE", "İstanbul KK Å Σ", "a b c\x85d", "x😀Y 😀", "_a_B_", "[a]^b\\c", "é", "é ß ﬁ", "1a 2B3"]


def test_words_are_those_of_the_pattern(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r.words for r in docs.select("doc_id", decontaminate.words_of("text").alias("words")).collect()}
    assert got == {i: WORD.findall((t or "").translate(FOLDED)) for i, t in enumerate(ODD)}


def test_documents_are_read_twice_at_most_and_counted_in_the_first_pass(spark):
    """Items of all lengths ask for shingles of five sizes, each of which was a pass over all documents, and a further one counted words."""
    lines = ["one", "two words", "three of them", "four words in all", "five words are in it", "eleven words are in this item which is longer than one window".upper()]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "item_id long, text string")
    rows = [(i, f"{i} {'lead ' * (i % 4)}{lines[i % 6] if i % 2 else 'NOTHING'} tail") for i in range(60)] + [(None, None), (7, ""), (7, "one"), (7, "one")]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert seen.value <= 2 * len(rows), seen.value

    windows = [(i, w[at : at + 10]) for i, t in enumerate(lines) for w in [WORD.findall(t.translate(FOLDED))] for at in range(max(len(w) - 10, 0) + 1)]
    want = []
    for i, text in rows:
        words = WORD.findall((text or "").translate(FOLDED))
        hits = [(item, range(at, at + len(w))) for item, w in windows for at in range(len(words)) if words[at : at + len(w)] == w]
        items_of = sorted({str(item) for item, _ in hits})
        n_hit = len({at for _, places in hits for at in places})
        want.append((i, len(words), n_hit, len(items_of), hashlib.sha256(",".join(items_of).encode()).hexdigest(), n_hit > 0))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_document_without_a_prefix_is_not_cut_again(spark):
    """In the second pass no word is cut below the join that picks the documents."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("nothing but "), F.col("id")).alias("text"))
    windows = spark.createDataFrame([(1, "nothing but 7 so far".split()[:3])], "item long, w array<string>")
    _, hits = decontaminate.window_hits(docs, windows, "doc_id", "text")
    assert [(r.id, r.start) for r in hits.collect()] == [(7, 0)]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("split(") < plan.index("Join LeftSemi")
    assert plan.count("split(") == 1, plan
