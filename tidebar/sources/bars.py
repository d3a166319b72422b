"""Bar tables (ticker, idx, ts, open, high, low, close, volume) and the checks they must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR = ["ticker", "ts", "open", "high", "low", "close", "volume"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(bars: DataFrame) -> DataFrame:
    """Adds idx, the bar's place in its ticker's series, from 0."""
    return bars.withColumn("idx", (F.row_number().over(Window.partitionBy("ticker").orderBy("ts")) - 1).cast("int"))


def hourly_from_events(events: DataFrame) -> DataFrame:
    """One series for each event type; positive values only. Two-stage aggregation, no sort of events."""
    ts = F.col("ts").cast("timestamp")
    rows = events.where("value > 0").select(F.col("event_type").alias("ticker"), F.date_trunc("hour", ts).alias("hour"), ts.alias("at"), "value")
    return indexed(
        rows.groupBy("ticker", F.col("hour").alias("ts")).agg(
            F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", "at").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def daily_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One series for each return flag, of unit prices; ties of the order key are broken by line and price."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lineitem.where("l_quantity > 0 AND l_extendedprice > 0").select(F.col("l_returnflag").alias("ticker"), F.to_date("l_shipdate").cast("timestamp").alias("ts"), price.alias("price"), F.struct("l_orderkey", "l_linenumber", price.alias("p")).alias("o"), "l_quantity")
    return indexed(
        rows.groupBy("ticker", "ts").agg(
            F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", "o").alias("close"), F.sum("l_quantity").alias("volume"),
        )
    )


def universe(bars: DataFrame) -> DataFrame:
    return bars.select("ticker").distinct()


def quality(bars: DataFrame) -> DataFrame:
    """Per ticker, the number of rows that break each rule; a good series has zeros only.

    A repeated time counts wherever it stands. Rows come in the order of `position` if there is such a column.
    """
    w = Window.partitionBy("ticker").orderBy(F.col("position") if "position" in bars.columns else F.col("ts"))
    same = Window.partitionBy("ticker", "ts").orderBy(F.lit(0) if "position" not in bars.columns else F.col("position"))
    p = bars.withColumn("before", F.lag("ts").over(w)).withColumn("again", F.row_number().over(same) > 1)
    prices = ["open", "high", "low", "close"]
    odd = [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in prices]
    any_odd = odd[0] | odd[1] | odd[2] | odd[3]
    rules = {
        "null_ts": F.col("ts").isNull(),
        "duplicate_ts": F.col("ts").isNotNull() & F.col("again"),
        "descending_ts": F.col("ts") < F.col("before"),
        "bad_price": any_odd | (F.least(*prices) <= 0),
        "high_below_low": F.col("high") < F.col("low"),
        "high_below_body": F.col("high") < F.greatest("open", "close"),
        "low_above_body": F.col("low") > F.least("open", "close"),
        "bad_volume": F.col("volume").isNull() | F.isnan("volume") | (F.col("volume") < 0) | (F.col("volume") == float("inf")),
    }
    return p.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), *[F.sum(F.coalesce(rule.cast("int"), F.lit(0))).alias(name) for name, rule in rules.items()])


def require_quality(bars: DataFrame) -> DataFrame:
    """bars, or an error that names every broken rule."""
    report = quality(bars)
    bad = report.where(" OR ".join(f"{c} > 0" for c in report.columns if c not in ("ticker", "bars"))).limit(20).collect()
    if bad or bars.isEmpty():
        raise ValueError("; ".join(str(r.asDict()) for r in bad) or "no bars")
    return bars


def daily(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Hourly bars rolled up by session date in the exchange's zone; available once the last bar has closed."""
    local = F.to_date(F.from_utc_timestamp("ts", zone))
    return _rolled(bars.withColumn("session", local), "session")


def _rolled(bars: DataFrame, key: str) -> DataFrame:
    out = bars.groupBy("ticker", key).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.max("ts").alias("close_ts"), F.count(F.lit(1)).alias("parts"),
    )
    return out.withColumn("available_at", F.col("close_ts") + F.expr("INTERVAL 1 HOUR"))


def weekly(daily_bars: DataFrame) -> DataFrame:
    """Daily bars rolled up by ISO year and week, available when the week's last day is."""
    keyed = daily_bars.withColumn("week", F.concat_ws("-", F.expr("extract(YEAROFWEEK FROM session)").cast("string"), F.lpad(F.weekofyear("session").cast("string"), 2, "0")))
    return keyed.groupBy("ticker", "week").agg(
        F.min_by("open", "session").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "session").alias("close"),
        F.sum("volume").alias("volume"), F.max("available_at").alias("available_at"), F.count(F.lit(1)).alias("days"),
    )
