"""Canonical JSON against Python's, and figures in prose."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidebar.functions import canonical as J
from tidebar.operators import figures as G
from tidebar.operators import reports, screening, trades


def clean(x):
    if isinstance(x, dict):
        return {k: clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    if isinstance(x, float):
        return None if math.isnan(x) else ("inf" if x > 0 else "-inf") if math.isinf(x) else x + 0.0 if x == 0 else x
    return x


def test_numbers_and_texts_equal_python_json(spark):
    rng = random.Random(4)
    numbers = [0.0, -0.0, 1.0, 0.1, -2.5, 1e-4, 9.99e-5, 1e-5, 1e15, 1e16, 123456789012345680.0, 1e22, 1e23, 1.7976931348623157e308, 2.2250738585072014e-308, 0.1 + 0.2, 100.0, 1e2, 12345678.9, float("nan"), float("inf"), -float("inf")]
    numbers += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(500)] + [round(rng.uniform(0, 100), rng.randint(0, 6)) for _ in range(500)]
    numbers = [n for n in numbers if not 0 < abs(n) < 2.3e-308]
    texts = ["", "plain", 'a"b\\c/d', "tab\tnew\nline\r\b\f", "ß日本🙂\x7f\x00\x1f", " ", "$1 \\Q \\E {}"]
    texts += ["".join(rng.choice('ab"\\\n\té🙂漢\x01 ') for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = [(n, texts[i % len(texts)], i) for i, n in enumerate(numbers)]
    x = spark.createDataFrame(rows, "z double, a string, i int").select("i", F.struct("z", "a", "i").alias("p"))
    kind = x.schema["p"].dataType
    got = x.select("i", J.canonical(F.col("p"), kind).alias("j"), J.payload_sha256(F.col("p"), kind).alias("h"), J.canonical(F.col("p"), kind, ", ", ": ", False).alias("d")).collect()
    for r in got:
        n, t, i = rows[r.i]
        want = json.dumps(clean({"z": n, "a": t, "i": i}), sort_keys=True, separators=(",", ":"), allow_nan=False)
        assert r.j == want and r.h == hashlib.sha256(want.encode()).hexdigest()
        assert r.d == json.dumps({"z": n, "a": t, "i": i}, sort_keys=True)


def test_nested_payloads(spark):
    x = spark.createDataFrame([({"b": 1.5, "a": None, "é": float("nan")}, [[1, 2], []], (True, None, "x"), None)], "m map<string,double>, l array<array<int>>, t struct<_1:boolean,_2:int,_3:string>, e array<string>")
    x = x.select(F.struct("t", "m", "l", "e").alias("p"))
    got = x.select(J.canonical(F.col("p"), x.schema["p"].dataType).alias("j")).first().j
    assert got == json.dumps({"m": {"b": 1.5, "a": None, "é": None}, "l": [[1, 2], []], "t": [True, None, "x"], "e": None}, sort_keys=True, separators=(",", ":"))
    assert json.loads(got)["t"] == [True, None, "x"]
    y = spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date")
    with pytest.raises(TypeError, match="date"):
        J.canonical(F.col("d"), y.schema["d"].dataType)


@pytest.mark.parametrize(("text", "want", "found"), [
    ("built in 2031", "31", False), ("built in 2031", "20", False), ("of 31 rows", "31", True), ("31", "31", True), ("ends with 31.", "31", True), ("12/31/2", "12/31", True), ("12 / 310", "12/31", False),
    ("fell by −1.50 %", "-1.50%", True), ("fell by -1.50%", "−1.50 %", True), ("rose by +11.50%", "1.50%", False), ("in 16 601 rows", "16 601", True), ("costs (a+b)*2", "(a+b)", True), ("costs ab", "(a+b)", False), ("", "1", False), (None, "1", False),
])
def test_a_figure_stands_as_itself(spark, text, want, found):
    figures = spark.createDataFrame([("n", want, "f"), ("n", want, "missing")], "name string, expected string, file string")
    got = {r.file: r.found for r in G.verified(figures, spark.createDataFrame([("f", text)], "file string, text string")).collect()}
    assert got == {"f": found, "missing": False}


def test_numbers_of_prose_and_what_they_round(spark):
    prose = spark.createDataFrame([("f", "In 2024, 16 601 of 1,234,567 rows: +2.80% and −1.8 %, v1.2.3, 7")], "file string, text string")
    got = [(r.stated, r.value, r.step) for r in G.stated_numbers(prose).orderBy("place").collect()]
    assert got[:5] == [("2024", 2024.0, 1.0), ("16 601", 16601.0, 1.0), ("1,234,567", 1234567.0, 1.0), ("+2.80", 2.8, 0.01), ("-1.8", -1.8, 0.1)] and got[-1][0] == "7"
    figures = spark.createDataFrame([("a", 2.8049, "f"), ("b", -1.849, "f"), ("c", -1.851, "f"), ("d", 16601.0, "f"), ("e", 5.0, "none")], "name string, value double, file string")
    assert {r.name: r.stated for r in G.restated(figures, prose).collect()} == {"a": "+2.80", "b": "-1.8", "c": None, "d": "16 601", "e": None}


def test_message_counts(spark):
    stated = spark.createDataFrame([(1, "xgb=3 lstm=2 status=PASS"), (2, "xgb=3"), (3, "nothing"), (4, "lstm=02 xgb=03")], "store int, message string")
    actual = spark.createDataFrame([(s, m, n) for s in (1, 2, 4) for m, n in (("xgb", 3), ("lstm", 2), ("other", 9))], "store int, name string, n long")
    got = {r.store: (r.xgb, r.lstm, r.agrees) for r in G.count_problems(stated, actual, ["store"], ["xgb", "lstm"]).collect()}
    assert got == {1: (3, 2, True), 2: (3, 2, False), 3: (0, 0, False), 4: (3, 2, True)}


def test_edges_are_measured_by_own_shares(spark):
    x = spark.createDataFrame([(60, 55, 70, 30, 45.4, 54.6), (120, -5, 10, 10, 100.5, 0.5)], "a int, b int, c int, d int, e double, f double")
    got = [r.asDict() for r in x.select(*[v.alias(k) for k, v in reports.shared_wins(*map(F.col, "abcdef")).items()]).collect()]
    assert got[0] == {"xgb": 60, "lstm": 55, "both": 55, "neither": 30, "edge_xgb": 15, "edge_lstm": 0, "edge": 15, "intersection_win_rate": 65}
    assert got[1] == {"xgb": 100, "lstm": 0, "both": 0, "neither": 0, "edge_xgb": 0, "edge_lstm": 0, "edge": 0, "intersection_win_rate": None}


def test_a_feature_that_stood_still_is_scaled_by_the_floor(spark):
    x = spark.createDataFrame([("A", 0, 2.5), ("A", 1, 2.5), ("A", 2, float("inf")), ("A", 3, 2.5), ("A", 4, 3.5)], "ticker string, idx int, v double")
    stats = trades.train_stats(x, ["v"], F.col("idx") < 3)
    assert {r.idx: r.v for r in trades.normalised(x.where("idx > 2"), stats, ["v"]).collect()} == {3: 0.0, 4: pytest.approx(1e8)}
    pooled = trades.train_stats(x, ["v"], F.col("idx") < 3, pooled=True)
    assert trades.normalised(x.where("idx = 4"), pooled, ["v"]).first().v == pytest.approx(1.0)


def test_sample_rules_count_the_first_failure(spark):
    good = dict(coverage=1.0, gaps=0, max_gap_hours=93, violent=0, max_abs_return=0.2, flat_share=0.001, resolution=0.9)
    rows = [good, good | {"coverage": 0.98, "gaps": 3}, good | {"gaps": 1}, good | {"max_gap_hours": 101}, good | {"violent": 1, "max_abs_return": 0.9}, good | {"max_abs_return": 0.36}, good | {"flat_share": 0.0053}, good | {"resolution": 0.7488}, good | {"coverage": None}]
    kind = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in good.items())
    got = screening.cascade(spark.createDataFrame([tuple(r.values()) for r in rows], kind), screening.sample_rules()).orderBy("step").collect()
    assert [(r.rule, r.dropped, r.remaining) for r in got] == [("coverage", 2, 7), ("gaps", 1, 6), ("max_gap_hours", 1, 5), ("violent", 1, 4), ("max_abs_return", 1, 3), ("flat_share", 1, 2), ("resolution", 1, 1)]
