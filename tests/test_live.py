"""Indicators over a stream equal the batch at every bar, however the bars are cut into batches."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest

from tidebar.operators import recurrences
from tidebar.streaming import recurrences as streaming

START = dt.datetime(2024, 1, 1)
KIND = "ticker string, ts timestamp, open double, high double, low double, close double, volume double, idx int"


def bars(n: int, ticker: str):
    rng, price, rows = random.Random(ticker), 100.0, []
    for i in range(n):
        price *= 1 + rng.choice([0, 0.01, -0.01, 0.03])
        rows.append((ticker, START + dt.timedelta(hours=i), price, price + rng.random(), price - rng.random(), price, 1.0, i))
    return rows


def streamed(spark, tmp_path, batches):
    """Rows that the stream gives, one batch of files after the other, with a stop and a new start in between."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, at, name = tmp_path / "in", tmp_path / "state", f"live_{uuid.uuid4().hex}"
    folder.mkdir()
    got = []
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(KIND).parquet(str(folder))
        query = streaming.live(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(at)).trigger(availableNow=True).queryName(name).start()
        query.awaitTermination()
    return got


def test_stream_equals_batch_at_every_bar(spark, tmp_path):
    a, b = bars(70, "A"), bars(40, "B")
    flat = [("F", START + dt.timedelta(hours=i), 1.0, 1.0, 1.0, 1.0, 1.0, i) for i in range(20)]
    first, second, third = a[:5] + b[:30] + flat, a[5:41] + b[20:35], a[30:] + b + [("A", START + dt.timedelta(hours=500), 1.0, None, 1.0, 1.0, 1.0, 0)]
    random.Random(1).shuffle(second)  # a batch's rows come in any order; the third repeats bars already counted
    got = streamed(spark, tmp_path, [first, second, third])
    want = {(r.ticker, r.ts): r for r in recurrences.with_recurrences(spark.createDataFrame(a + b + flat, KIND)).collect()}
    assert len(got) == len(want) == 130
    for r in got:
        w = want[r.ticker, r.ts]
        assert r.n == w.idx + 1
        assert r.atr_14 == pytest.approx(w.atr_14, rel=1e-9) if w.atr_14 is not None else r.atr_14 is None or r.atr_14 != r.atr_14
        assert r.rsi_14 == pytest.approx(w.rsi_14, rel=1e-9) if w.rsi_14 is not None else r.rsi_14 is None or r.rsi_14 != r.rsi_14
