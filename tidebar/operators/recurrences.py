"""Indicators that depend on their own last value: one ordered fold over each ticker's bars, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.folds import running, smoothed
from tidebar.functions.rolling import back

RANGES, STRENGTHS = (5, 14, 20), (2, 14)
FAST, SLOW, SIGNAL = 12, 26, 9
#: Its columns with these lengths.
COLUMNS = [*[f"atr_{n}" for n in RANGES], *[f"rsi_{n}" for n in STRENGTHS], "macd_line", "macd_signal", "macd_hist"]


def true_range() -> Column:
    """The bar's range, widened to the close before; the first bar's own range."""
    high, low = F.col("high"), F.col("low")
    before = F.coalesce(back("close", 1), F.col("close"))
    return F.greatest(high, before) - F.least(low, before)


def strength(up: Column, down: Column) -> Column:
    """Relative strength index of the smoothed rises and falls: 100 without falls, 50 without either."""
    return F.when(down > 0, 100 * up / (up + down)).when(up > 0, 100.0).otherwise(50.0)


def with_recurrences(bars: DataFrame, ranges: tuple[int, ...] = RANGES, strengths: tuple[int, ...] = STRENGTHS) -> DataFrame:
    """bars and COLUMNS, or those of other lengths. A value is null until the bars it is first defined on are there.

    Average ranges start with the mean of their first n true ranges, other means with their first value. A
    null price changes no mean. One ticker's bars, not its raw rows, are one pass.
    """
    change = F.col("close") - back("close", 1)
    x = bars.withColumns({"_range": true_range(), "_up": F.when(change >= 0, change).otherwise(change * 0), "_down": F.when(change < 0, -change).otherwise(change * 0)})
    names = ["sum", *[f"range_{n}" for n in ranges], *[f"{way}_{n}" for n in strengths for way in ("up", "down")], "fast", "slow", "signal"]

    def step(s: Column, b: Column) -> Column:
        seen = b["idx"] + 1
        out = {"sum": s["sum"] + F.coalesce(b["_range"], F.lit(0.0))}
        for n in ranges:
            out[f"range_{n}"] = F.when(seen <= n, (s["sum"] + b["_range"]) / n).otherwise(smoothed(s[f"range_{n}"], b["_range"], 1 / n))
        for n in strengths:
            for way in ("up", "down"):
                out[f"{way}_{n}"] = smoothed(s[f"{way}_{n}"], b[f"_{way}"], 1 / n)
        out["fast"], out["slow"] = (smoothed(s[k], b["close"], 2 / (n + 1)) for k, n in (("fast", FAST), ("slow", SLOW)))
        out["signal"] = F.when(seen >= SLOW, smoothed(s["signal"], out["fast"] - out["slow"], 2 / (SIGNAL + 1)))
        return F.struct(*[out[k].alias(k) for k in names])

    y = running(x, ["ticker"], ["idx"], {k: 0.0 if k == "sum" else None for k in names}, ", ".join(f"`{k}`: double" for k in names), step)
    seen = F.col("idx") + 1
    line = F.col("state.fast") - F.col("state.slow")
    out = {f"atr_{n}": F.when(seen >= n, F.col(f"state.range_{n}")) for n in ranges}
    out |= {f"rsi_{n}": F.when(seen > n, strength(F.col(f"state.up_{n}"), F.col(f"state.down_{n}"))) for n in strengths}
    ready = seen >= SLOW + SIGNAL - 1
    out |= {"macd_line": F.when(seen >= SLOW, line), "macd_signal": F.when(ready, F.col("state.signal")), "macd_hist": F.when(ready, line - F.col("state.signal"))}
    return y.select(*bars.columns, *[v.alias(k) for k, v in out.items()])
