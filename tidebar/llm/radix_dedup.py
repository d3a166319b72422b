"""Exact duplicates by most-significant-digit-first radix partitioning.

Texts, white space removed, are split by their leading bytes, the groups by the bytes that follow, and so
on, until a group has one member or its texts have ended. Digits are byte strings that grow from level
to level (64 bytes, then 16 times as many each time), so that a text of a gigabyte ends after seven
levels, and only members of groups of two or more go on to the next. Texts meet by their own bytes alone;
no digest decides.

Only row keys and digits are dealt out; what follows a digit is read again, from the texts of the rows that go
on, whose keys are broadcast while they number BROADCAST_ROWS at most and else joined with the texts once for each level.
A row's key is its id with a hash of its text, so rows with one key are one and the same.

Counting a level's groups combines copies before the shuffle, so a group that holds a third of all rows
is one row from each task. Its members then meet the group's row in a join, which adaptive execution
splits where a group is large; no task holds a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import forget, stored, text_of

FIRST_DIGIT, DIGIT_GROWTH = 64, 16
#: Keys of rows that are broadcast (40 MB).
BROADCAST_ROWS = 1_000_000
#: Fixed value: the characters that do not count.
BLANKS = r"[\x20\x09-\x0D]+"


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id column, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text, then the smallest id, stays.
    A null text counts as empty; empty texts are equal to each other. Repeated rows all count and share
    their id, so a kept id is kept in each of its rows. A null id can only stay if no other row of its
    group has one as long. Other columns are not read. An empty table gives an empty one.
    """
    text = text_of(text_column)
    norm = F.regexp_replace(text, BLANKS, "")
    key = [F.col(id_column).alias("id"), F.xxhash64(text).alias("check")]
    live = docs.select(*key, F.length(text).cast("long").alias("n"), F.lit(0).cast("long").alias("group"), norm.cast("binary").alias("rest"))
    settled, width, level = [], FIRST_DIGIT, 0
    while level == 0 or not live.isEmpty():
        digits = live.select("id", "check", "n", "group", F.substring("rest", 1, width).alias("digit"))
        groups = stored(digits.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("next", F.monotonically_increasing_id()))
        placed = stored(digits.join(groups, ["group", "digit"]).select("id", "check", "n", F.lit(level).alias("level"), "next", (F.length("digit") < width).alias("ended")))
        settled.append(placed.where("ended").drop("ended"))
        on = stored(placed.where("NOT ended").select(F.col("id").alias("on_id"), F.col("check").alias("on_check"), "next").distinct())
        few = F.broadcast(on) if on.count() <= BROADCAST_ROWS else on
        further = stored(
            live.join(few, F.col("id").eqNullSafe(F.col("on_id")) & (F.col("check") == F.col("on_check")))
            .select("id", "check", "n", F.col("next").alias("group"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        )
        forget(groups, on, *([live] if level else []))
        live, width, level = further, width * DIGIT_GROWTH, level + 1
    forget(live)
    rows = reduce(DataFrame.unionAll, settled)
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    groups = rows.groupBy("level", "next").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    keys = rows.select("id", "check", "level", "next").distinct().join(groups, ["level", "next"])
    of = keys.select(F.col("id").alias("of_id"), F.col("check").alias("of_check"), F.col("best.id").alias("keep"), "size")
    out = docs.select(*key, F.sha2(norm, 256).alias("sha")).join(of, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("check") == F.col("of_check")), "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(F.col("id").alias(id_column), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
