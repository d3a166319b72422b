"""A corpus pipeline over the documents: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe_automaton, decontaminate, jaccard_join, queries, radix_dedup, toxicity
from tidebar.llm.common import stored, table, text_of


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each row, and its name: id (null last) and a hash of the text, so rows with one key are repeats of one document."""
    name = _free(docs, "row_key")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.xxhash64(text_of()).alias("check"))
    return docs.withColumn(name, key), name


def _without(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of keyed whose key is not among gone's."""
    other = _free(keyed, "gone_key")
    return keyed.join(gone.select(F.col(key).alias(other)).distinct(), F.col(key) == F.col(other), "left_anti")


def _once(keyed: DataFrame, key: str) -> DataFrame:
    """Repeated rows once; texts are dealt out only if there are any."""
    again = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return keyed if again.isEmpty() else keyed.dropDuplicates([key])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    labels = table(spark, sf_dir, "labels")
    lexicon = toxicity.train(docs, labels.where(~queries.held_out(F.col("doc_id"))))
    return toxicity.accepted(docs, lexicon)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, also of repeated rows."""
    keyed, key = _keyed(docs)
    copies = radix_dedup.exact_groups(keyed, id_column=key).where("NOT kept")
    return _without(_once(keyed, key), key, copies).drop(key)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; of repeated rows one."""
    keyed, key = _keyed(docs)
    others = jaccard_join.jaccard_components(keyed, id_column=key).where(F.col(key) != F.col("component_id"))
    return _without(_once(keyed, key), key, others).drop(key)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    keyed, key = _keyed(docs)
    found = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), id_column=key).where("contaminated")
    return _without(keyed, key, found).drop(key)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left."""
    return bpe_automaton.encode_digests(docs, queries.BYTE_BPE)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: The toxicity stage learns its lexicon, which SQL cannot express; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
