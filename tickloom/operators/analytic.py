"""Window functions: ranks, standardisation, streaks, peaks, future extremes, folds' inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key, optionally with their rank."""
    out = df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= n)
    return out.withColumnRenamed("__k", rank) if rank else out.drop("__k")


def rank_pct(x: Column, keys: Sequence[str]) -> Column:
    """Average rank over non-NULL values as a share of their number."""
    ranked = Window.partitionBy(*keys, x.isNull()).orderBy(x)
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (F.rank().over(ranked) + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*keys)))


def zscore(x: Column, keys: Sequence[str], inside: Column | None = None, clip: float = 3.0) -> Column:
    """(x - mean) / (sample deviation + 1e-12) within keys, the statistics over rows ``inside``, clipped."""
    w = Window.partitionBy(*keys)
    y = x if inside is None else F.when(inside, x)
    z = (x - F.avg(y).over(w)) / (F.stddev_samp(y).over(w) + 1e-12)
    return F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)))


def rolling(fn, x: Column, w: WindowSpec, rows: int, least: int) -> Column:
    """``fn`` over the last ``rows`` rows, NULL with fewer than ``least`` values."""
    frame = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(frame) >= least, fn(x).over(frame))


def future_max(x: Column, w: WindowSpec, horizon: int) -> Column:
    """Largest value of the next ``horizon`` rows; a shorter rest counts, the last row has none."""
    return F.max(x).over(w.rowsBetween(1, horizon))


def fill_forward(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def fill_both(x: Column, w: WindowSpec) -> Column:
    """Forward; what comes before the first value takes that one. (A frame that ends at the partition's end
    and starts at each row would be computed anew for every row.)"""
    return F.coalesce(fill_forward(x, w), F.first(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def longest_streak(df: DataFrame, keys: Sequence[str], order: str, holds: Column, name: str) -> DataFrame:
    """Most consecutive rows of each key for which ``holds``; NULL breaks a streak, 0 if there is none."""
    yes = F.coalesce(holds, F.lit(False))
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__y", yes).withColumn("__g", F.sum(F.when(F.col("__y"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, "__g").agg(F.sum(F.col("__y").cast("long")).alias("__n"))
    return runs.groupBy(*keys).agg(F.max("__n").alias(name))


def peaks(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows at strict local maxima; a plateau counts once, at the floor of its middle; ends do not count."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__new", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1))
    runs = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shape = runs.groupBy(*keys, "__run").agg(F.first(value).alias("__v"), F.min("__i").alias("__a"), F.max("__i").alias("__b"))
    r = Window.partitionBy(*keys).orderBy("__run")
    tops = shape.withColumn("__p", F.lag("__v").over(r)).withColumn("__q", F.lead("__v").over(r)).where("__v > __p AND __v > __q")
    tops = tops.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.floor((F.col("__a") + F.col("__b")) / 2).alias("__at"))
    same = F.col("__i") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__k{i}"))
    return rows.join(tops, same).select(*df.columns)
