"""Indicators that depend on their own last value, over an unbounded stream of bars."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebar.sources.stores import shared_dir

RANGE, STRENGTH = 14, 14
_STATE = "n long, last long, close double, ranges double, atr double, up double, down double"
_OUT = "ticker string, ts timestamp, n long, atr_14 double, rsi_14 double"


class Recurrences(StatefulProcessor):
    """Average range and relative strength of each ticker, bar by bar. Its state is one row: what the next bar needs of all bars before.

    Bars count in the order of their time. A bar at or before the last one counted (one that comes again when a batch is replayed, or late) changes nothing and gives no row; of bars of one time in one batch the first by its
    prices counts. A bar without a close, high or low is passed over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(rows).dropna(subset=["ts", "high", "low", "close"])
        bars = bars.sort_values(["ts", "close", "high", "low"]).drop_duplicates("ts")
        n, last, close, ranges, atr, up, down = self.held.get() if self.held.exists() else (0, None, None, 0.0, None, None, None)
        out = []
        for ts, high, low, price in bars[["ts", "high", "low", "close"]].itertuples(index=False):
            at = ts.value // 1000
            if last is not None and at <= last:
                continue
            before = price if close is None else close
            span = max(high, before) - min(low, before)
            n += 1
            ranges += span if n <= RANGE else 0.0
            atr = ranges / RANGE if n == RANGE else None if n < RANGE else (1 - 1 / RANGE) * atr + span / RANGE
            if close is not None:
                rise, fall = max(price - close, 0.0), max(close - price, 0.0)
                up = rise if up is None else (1 - 1 / STRENGTH) * up + rise / STRENGTH
                down = fall if down is None else (1 - 1 / STRENGTH) * down + fall / STRENGTH
            rsi = None if n <= STRENGTH else 100 * up / (up + down) if down > 0 else 100.0 if up > 0 else 50.0
            close, last = price, at
            out.append((key[0], ts, n, atr, rsi))
        if out:
            self.held.update((n, last, close, ranges, atr, up, down))
        frame = pd.DataFrame(out, columns=["ticker", "ts", "n", "atr_14", "rsi_14"])
        yield frame.astype({"n": "int64", "atr_14": "float64", "rsi_14": "float64"}).assign(ts=pd.to_datetime(frame["ts"]))

    def close(self) -> None:
        pass


def live(bars: DataFrame) -> DataFrame:
    """ticker, ts, n, atr_14, rsi_14 for every bar of a stream (ticker, ts, high, low, close), in append mode; the session needs the RocksDB state store."""
    return bars.select("ticker", "ts", "high", "low", "close").groupBy("ticker").transformWithStateInPandas(statefulProcessor=Recurrences(), outputStructType=_OUT, outputMode="append", timeMode="None")


def replayed(bars: DataFrame, slices: list[str]) -> DataFrame:
    """What the stream gives for bars that arrive in slices (conditions on them), one start of the query for each; checkpoint, files and output lie in the shared folder."""
    spark = bars.sparkSession
    at = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in slices:
            bars.where(part).write.mode("append").parquet(f"{at}/in")
            stream = live(spark.readStream.schema(bars.schema).parquet(f"{at}/in"))
            stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(_OUT).parquet(f"{at}/out")
