"""Sinks with replace-by-key semantics, a hash-chained ledger, and file digests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.functions.folds import running


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only a local session may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or '/tmp/checkpoints').rstrip('/')}/{spark.sparkContext.applicationId}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what follows reads it several times, and no lost executor sends it back to the start."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet, one folder for each ticker, so that a filter on ticker reads no other."""
    bars.repartition("ticker").write.mode("overwrite").option("compression", "zstd").partitionBy("ticker").parquet(path)


def chained(records: DataFrame, order: str, body: str) -> DataFrame:
    """Adds prev and checksum: each record's digest covers its predecessor's. One chain is one ordered fold."""
    x = records.select(F.lit(0).alias("chain"), F.col(order).cast("bigint").alias("seq"), F.col(body).alias("body"))

    def step(state: Column, row: Column) -> Column:
        return F.struct(state["checksum"].alias("prev"), F.sha2(F.concat(state["checksum"], row["body"]), 256).alias("checksum"))

    y = running(x, ["chain"], ["seq"], {"prev": None, "checksum": ""}, "`prev`: string, `checksum`: string", step)
    return y.select("seq", "body", "state.prev", "state.checksum")


def broken_links(ledger: DataFrame) -> DataFrame:
    """Records whose prev is not their predecessor's checksum, or whose checksum is not their own."""
    before = F.coalesce(F.lag("checksum").over(Window.orderBy("seq")), F.lit(""))
    return ledger.withColumn("expected", before).where((F.col("prev") != F.col("expected")) | (F.col("checksum") != F.sha2(F.concat("prev", "body"), 256))).drop("expected")


def latest(ledger: DataFrame, key: str) -> DataFrame:
    return ledger.groupBy(key).agg(F.max_by("body", "seq").alias("body"), F.max("seq").alias("seq"))


def folder_digest(spark: SparkSession, path: str) -> DataFrame:
    """One digest over the sorted names and digests of a folder's files."""
    files = spark.read.format("binaryFile").load(path)
    named = files.select(F.concat_ws(":", F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)).alias("line"))
    return named.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
