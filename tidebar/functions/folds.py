"""Ordered folds on the JVM: a state that each row of a key's series takes on from the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose states are gathered before they are added to those of the series, so that a long series is not copied for each row.
CHUNK = 256


def running(rows: DataFrame, keys: list[str], order: list[str], start: dict[str, object], kind: str, step: Callable[[Column, Column], Column], name: str = "state") -> DataFrame:
    """rows with the column `name`, the state after each row.

    kind is the state's type as DDL, start its fields before the first row, step(state, row) the next state. Rows
    are taken in the order of `order`, then of their other columns. One key's rows are one ordered pass, in one task;
    keys are advanced side by side.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    series = rows.select(*keys, F.struct(*order, *rest).alias("_row")).groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    state, some = f"struct<{kind}>", f"array<struct<{kind}>>"
    zero = F.struct(*[F.lit(v).alias(k) for k, v in start.items()]).cast(state)
    starts = F.sequence(F.lit(1), F.size("_rows"), F.lit(CHUNK))

    def one(states: Column, row: Column) -> Column:
        return F.array_append(states, step(F.element_at(states, -1), row).cast(state))

    def chunk(chunks: Column, at: Column) -> Column:
        last = F.element_at(F.element_at(chunks, -1), -1)
        return F.array_append(chunks, F.aggregate(F.slice("_rows", at, F.lit(CHUNK)), F.array(last).cast(some), one))

    chunks = F.aggregate(starts, F.array(F.array(zero)).cast(f"array<{some}>"), chunk)
    after = F.flatten(F.transform(chunks, lambda c: F.slice(c, F.lit(2), F.lit(CHUNK))))
    each = series.select(*keys, F.explode(F.arrays_zip(F.col("_rows").alias("row"), after.alias("state"))).alias("_z"))
    return each.select(*keys, *[F.col(f"_z.row.{c}").alias(c) for c in [*order, *rest]], F.col("_z.state").alias(name))


def smoothed(before: Column, x: Column, alpha: float) -> Column:
    """The next value of an exponential mean: the first value, then (1 - alpha) before + alpha x; a null adds nothing."""
    return F.coalesce((1 - alpha) * before + alpha * x, before, x)
