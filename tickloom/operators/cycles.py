"""Cycles between peaks, and brackets of extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.analytic import peaks
from tickloom.operators.joins import interval_overlaps, interval_sums


def peak_cycles(rows: DataFrame, keys: Sequence[str], ts: str, value: str, reference: str | None = None, least_pct: float | None = None) -> DataFrame:
    """(keys, start_time, end_time, amplitude_pct, duration_min) between consecutive peaks of ``value``.

    The amplitude is the change of ``reference`` (or of ``value``, against its absolute start) in percent;
    cycles from 0 have none and go, as do those under ``least_pct``."""
    w = Window.partitionBy(*keys).orderBy(ts)
    ref = reference or value
    tops = peaks(rows, keys, ts, value).select(*keys, F.col(ts).alias("start_time"), F.lead(ts).over(w).alias("end_time"), F.col(ref).alias("__a"), F.lead(ref).over(w).alias("__b"))
    base = F.col("__a") if reference else F.abs("__a")
    out = tops.where("end_time IS NOT NULL").withColumn("amplitude_pct", F.try_divide(F.col("__b") - F.col("__a"), base) * 100).where("amplitude_pct IS NOT NULL")
    if least_pct is not None:
        out = out.where(F.col("amplitude_pct") >= least_pct)
    minutes = (F.unix_seconds(F.col("end_time").cast("timestamp")) - F.unix_seconds(F.col("start_time").cast("timestamp"))) / 60
    return out.select(*keys, "start_time", "end_time", "amplitude_pct", minutes.alias("duration_min"))


def fuse_cycles(price: DataFrame, volume: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts", full_overlap: bool = False) -> DataFrame:
    """Price cycles with ``total_volume``: bar volume summed over every overlapping volume cycle of non-zero
    amplitude, each in full. Price cycles without any go."""
    v = volume.where("amplitude_pct <> 0").select(*keys, F.col("start_time").alias("vs"), F.col("end_time").alias("ve"))
    pairs = interval_overlaps(price, v, keys, ("start_time", "end_time"), ("vs", "ve"), full_overlap=full_overlap)
    summed = interval_sums(pairs, bars, keys, ("vs", "ve"), ts, "volume", "__v")
    return summed.groupBy(*price.columns).agg(F.sum("__v").alias("total_volume"))


def cycle_depth(peak: Column, trough: Column) -> Column:
    """Distance in percent of the absolute middle; 0 around a middle of 0."""
    middle = (peak + trough) / 2
    return F.when(middle == 0, 0.0).otherwise(F.abs(peak - trough) / F.abs(F.when(middle != 0, middle)) * 100)


def extrema_brackets(rows: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """(keys, a, b, c, depth_pct): alternating triples of extremes, the depth the deeper of its two halves.

    Extremes are sought in the median of three neighbours (0 beyond the ends), depths in ``value``."""
    w = Window.partitionBy(*keys).orderBy(ts)
    x, p, q = F.col(value), F.coalesce(F.lag(value).over(w), F.lit(0.0)), F.coalesce(F.lead(value).over(w), F.lit(0.0))
    smooth = rows.withColumn("__m", F.array_sort(F.array(p, x, q))[1]).withColumn("__n", -F.col("__m"))
    both = peaks(smooth, keys, ts, "__m").withColumn("__k", F.lit("p")).unionByName(peaks(smooth, keys, ts, "__n").withColumn("__k", F.lit("t")))
    e = both.select(*keys, F.col(ts).alias("a"), F.lead(ts, 1).over(w).alias("b"), F.lead(ts, 2).over(w).alias("c"), F.col("__k").alias("k0"), F.lead("__k", 1).over(w).alias("k1"), F.lead("__k", 2).over(w).alias("k2"), F.col(value).alias("v0"), F.lead(value, 1).over(w).alias("v1"), F.lead(value, 2).over(w).alias("v2"))
    depth = F.greatest(cycle_depth(F.col("v0"), F.col("v1")), cycle_depth(F.col("v1"), F.col("v2")))
    return e.where("k0 <> k1 AND k1 <> k2 AND k2 IS NOT NULL").select(*keys, "a", "b", "c", depth.alias("depth_pct"))


def circular_variance(angle: Column) -> Column:
    return 1 - F.hypot(F.avg(F.cos(angle)), F.avg(F.sin(angle)))
