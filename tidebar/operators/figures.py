"""Figures that prose states, held against figures computed again from the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Typography that does not change a figure.
SAME = {"\u2212": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ", " %": "%", " / ": "/"}
_NUMBER = r"(?<![\p{Nd}.,])[+-]?\p{Nd}+(?:[ ,]\p{Nd}{3})*(?:\.\p{Nd}+)?(?![\p{Nd}])"


def normalised(text: Column) -> Column:
    """Text in one house style: plain minus signs and spaces, none before a per cent sign or around a slash."""
    for a, b in SAME.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def occurs(text: Column, want: Column) -> Column:
    """Whether the figure stands in the text as itself: no digit touches either end."""
    quoted = F.concat(F.lit("\\Q"), F.replace(normalised(want), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.rlike(normalised(text), F.concat(F.lit("(?<!\\p{Nd})"), quoted, F.lit("(?!\\p{Nd})")))


def signed_percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f%%", x)


def spaced(n: Column) -> Column:
    """A count with a space between thousands."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))


def verified(figures: DataFrame, prose: DataFrame) -> DataFrame:
    """name, expected, file, found: every figure held against every text that should state it. figures: name, expected, file. prose: file, text. A text that is not there states nothing."""
    x = figures.join(prose.select("file", "text"), "file", "left")
    return x.select("name", "expected", "file", F.coalesce(occurs(F.col("text"), F.col("expected")), F.lit(False)).alias("found"))


def stated_numbers(prose: DataFrame) -> DataFrame:
    """file, place, stated, value, step: the numbers of a text in order, with separators, signs and per cent understood, and the step to which each is rounded."""
    found = F.regexp_extract_all(normalised(F.col("text")), F.lit(_NUMBER), F.lit(0))
    x = prose.select("file", F.posexplode(found).alias("place", "stated"))
    plain = F.regexp_replace("stated", "[ ,]", "")
    places = F.length(F.regexp_extract(plain, r"\.(\p{Nd}+)$", 1))
    return x.select("file", "place", "stated", plain.cast("double").alias("value"), F.pow(F.lit(10.0), -places).alias("step"))


def restated(figures: DataFrame, prose: DataFrame) -> DataFrame:
    """name, value, file, stated: the number of a text that gives the figure within half a step of its rounding, the nearest, then the finest, then the first; null if none does. figures: name, value, file."""
    n = stated_numbers(prose)
    x = figures.join(n.withColumnRenamed("value", "said"), "file", "left")
    gap = F.abs(F.col("said") - F.col("value"))
    near = gap <= F.col("step") / 2 + 1e-9
    best = F.min(F.when(near, F.struct(F.round(gap, 9).alias("gap"), "step", "place", "stated")))
    return x.groupBy("name", "value", "file").agg(best.alias("b")).select("name", "value", "file", F.col("b.stated").alias("stated"))


def stated_counts(message: Column, names: list[str]) -> dict[str, Column]:
    """The counts that a message of the form a=1 b=2 states, by name; null where it does not."""
    return {n: F.nullif(F.regexp_extract(message, rf"(?:^|[^a-z_]){n}=(\d+)", 1), F.lit("")).cast("long") for n in names}


def count_problems(stated: DataFrame, actual: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, message, and for each name the actual count, and whether the message agrees in all of them. stated: keys, message. actual: keys, name, n."""
    x = stated.join(actual.where(F.col("name").isin(names)), keys, "left").groupBy(*keys, "message").agg(*[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in names])
    said = stated_counts(F.col("message"), names)
    agrees = F.lit(True)
    for n in names:
        agrees = agrees & said[n].eqNullSafe(F.col(n))
    return x.withColumn("agrees", agrees)
