"""Hourly bars of an event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.sources.stores import shared_dir

LATENESS = "2 hours"


def hourly(events: DataFrame) -> DataFrame:
    """ticker, ts, open, high, low, close, volume; state of an hour is dropped once the watermark has passed it."""
    rows = events.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("at"), "value").where("value > 0").withWatermark("at", LATENESS)
    out = rows.groupBy("ticker", F.window("at", "1 hour").alias("w")).agg(
        F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return out.select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def replayed(spark: SparkSession, path: str) -> DataFrame:
    """The bars after the stream has read all files under path; its checkpoint and output lie in the shared folder.

    Append mode: an hour is written once, when the watermark has passed it, and its state is dropped. Where the
    stream ends, the hours that the watermark has not passed are those of the last LATENESS; they are read from
    the files as a batch.
    """
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    query = hourly(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/bars").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(hourly(spark.read.parquet(path)).schema).parquet(f"{at}/bars")
    last = spark.read.parquet(path).where("value > 0").agg(F.max("ts").cast("timestamp")).first()[0]
    rest = hourly(spark.read.parquet(path).where(F.col("ts").cast("timestamp") >= F.date_trunc("hour", F.lit(last).cast("timestamp") - F.expr(f"INTERVAL {LATENESS}"))))
    return done.unionByName(rest.join(done.select("ticker", "ts"), ["ticker", "ts"], "left_anti"))
