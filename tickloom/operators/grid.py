"""Time bins: resampling, regular grids, and windows with coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.analytic import fill_both


def floor_time(ts: Column, every: str) -> Column:
    """Start of the epoch-aligned bin of a timestamp."""
    return F.window(ts, every)["start"]


def floor_to(ts: str, seconds: int) -> Column:
    """As ``floor_time``, by arithmetic: several sizes may stand in one select, where Spark allows one window."""
    over = F.pmod(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts)), F.lit(seconds * 1_000_000))
    return F.col(ts) - F.make_dt_interval(secs=(over / 1_000_000).cast("decimal(18,6)"))


def resample(bars: DataFrame, every: str, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """OHLCV of left-closed epoch-aligned bins; first and last skip NULLs, empty bins do not appear."""
    at = F.col(ts)
    given = lambda c: F.when(F.col(c).isNotNull(), at)
    binned = bars.withColumn("__bin", floor_time(at, every))
    return binned.groupBy(*keys, F.col("__bin").alias("bin")).agg(
        F.min_by("open", given("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", given("close")).alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bin", ts)


def on_grid(bars: DataFrame, every: str, keys: Sequence[str] = ("symbol",), ts: str = "ts", start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Bars on a gapless grid from each key's first to last time (or the given ends); what is new is NULL."""
    first, last = F.min(ts) if start is None else F.first(start), F.max(ts) if end is None else F.first(end)
    bounds = bars.groupBy(*keys).agg(first.alias("__a"), last.alias("__b"))
    grid = bounds.select(*keys, F.explode(F.sequence("__a", "__b", F.expr(f"INTERVAL {every}"))).alias(ts))
    return grid.join(bars, [*keys, ts], "left")


def fill_bars(grid: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Prices carried forward, then backward; no bar has no volume."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return grid.withColumns({c: fill_both(F.col(c), w) for c in ("open", "high", "low", "close") if c in grid.columns} | {"volume": F.coalesce("volume", F.lit(0.0))})


def windowed(bars: DataFrame, size: str, bars_each: int, keys: Sequence[str] = ("symbol",), ts: str = "ts", coverage: float = 0.8) -> DataFrame:
    """Bars with the start of their disjoint window, of windows that hold enough bars."""
    rows = bars.withColumn("window_start", floor_time(F.col(ts), size))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "window_start"))
    return rows.withColumn("window_bars", n).where(F.col("window_bars") >= max(1, int(bars_each * coverage)))


def bars_coverage(bars: DataFrame, every: str, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """(symbol, before, after, missing_share): distinct bars in (start, end] and bins that the grid has there."""
    inside = bars.where((F.col(ts) > start) & (F.col(ts) <= end)).groupBy("symbol").agg(F.count_distinct(ts).alias("before"))
    bins = F.size(F.sequence(start, end, F.expr(f"INTERVAL {every}"))) - 1
    return inside.withColumn("after", bins.cast("bigint")).withColumn("missing_share", 1 - F.try_divide(F.col("before"), F.col("after")))
