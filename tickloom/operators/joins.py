"""Joins by time: as-of, nearest, overlapping intervals, and sums over intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def _bin(ts: Column, seconds: int) -> Column:
    return F.floor(_seconds(ts) / seconds).cast("bigint")


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str) -> DataFrame:
    """Both sides as one stream of (keys, __ts, __side, __left, __right); the right side comes first at equal times."""
    l = left.select(*keys, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))  # noqa: E741
    r = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(*[c for c in right.columns if c not in keys]).alias("__right"))
    return l.unionByName(r, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, match: str = "match", bucket: int | None = None) -> DataFrame:
    """``left`` with the struct of the latest ``right`` row at or before its time, NULL if there is none.

    One shuffle and no pairs: both sides are merged and the last right row is carried along. The whole
    struct is carried, so NULLs in it survive. With ``bucket`` seconds, keys are cut into time buckets
    that are carried over separately, so that a hot key, or no key, does not end up in one task."""
    rows = _merged(left, right, keys, left_ts, right_ts)
    by = list(keys)
    if bucket:
        rows = rows.withColumn("__b", _bin(F.col("__ts"), bucket))
        by.append("__b")
    inside = F.last("__right", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn(match, inside)
    if bucket:
        ends = rows.groupBy(*by).agg(F.max_by("__right", F.when(F.col("__right").isNotNull(), F.col("__ts"))).alias("__end"))
        # one row for each bucket
        over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        carried = ends.withColumn("__from", F.last("__end", ignorenulls=True).over(over.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__end")
        out = out.where("__side = 1").join(carried, by, "left").withColumn(match, F.coalesce(match, "__from"))
    return out.where("__side = 1").select("__left.*", match)


def asof_with_gap(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, max_gap: int, mode: str = "ffill", match: str = "match") -> DataFrame:
    """Unkeyed as-of backward join with a limit on the gap in seconds.

    ``ffill`` leaves ``match`` NULL beyond the gap; ``drop`` ignores the gap and leaves out rows without a
    match; ``error`` raises if any row has none."""
    joined = asof_backward(left, right, [], left_ts, right_ts, match, bucket=max(3600, max_gap))
    near = _seconds(F.col(left_ts)) - _seconds(F.col(f"{match}.{right_ts}")) <= max_gap
    if mode == "ffill":
        return joined.withColumn(match, F.when(near, F.col(match)))
    if mode == "drop":
        return joined.where(F.col(match).isNotNull())
    if mode == "error":
        return joined.withColumn(match, F.when(F.col(match).isNull(), F.raise_error(F.lit("no base row for some timestamps")).cast(joined.schema[match].dataType)).otherwise(F.col(match)))
    raise ValueError(f"mode {mode!r} is none of ffill, drop, error")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, tolerance: int, match: str = "match", fallback: bool = True) -> DataFrame:
    """``left`` with the right row of the smallest time distance on either side, the earlier of two.

    Beyond ``tolerance`` seconds it is the key's latest row, or NULL without ``fallback``. The candidates
    on both sides and the latest come from one shuffle of the merged sides."""
    rows = _merged(left, right, keys, left_ts, right_ts)
    w = Window.partitionBy(*keys).orderBy("__ts", "__side")
    back = Window.partitionBy(*keys).orderBy(F.desc("__ts"), "__side")  # the same frame backwards: linear, as one towards the end is not
    found = rows.select(
        "__side", "__left", "__ts",
        F.last("__right", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__b"),
        F.last("__right", True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("__f"),
        F.last("__right", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__l"),
    ).where("__side = 1")
    away = lambda side: F.abs(_seconds(F.col("__ts")) - _seconds(F.col(f"{side}.{right_ts}")))
    best = F.when(F.col("__b").isNull() | (away("__f") < away("__b")), F.col("__f")).otherwise(F.col("__b"))
    close = F.least(away("__b"), away("__f")) <= tolerance
    return found.select("__left.*", F.when(close, best).otherwise(F.col("__l") if fallback else F.lit(None)).alias(match))


def interval_overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], bin_seconds: int = 86_400, full_overlap: bool = False) -> DataFrame:
    """Pairs of intervals of which ``b`` starts or ends inside ``a`` (ends included).

    With ``full_overlap`` also those that contain ``a``. Intervals meet in time bins, an equality join that
    spreads a hot key over its bins; each pair is kept in the bin of its first common point only."""
    bins = lambda lo, hi: F.explode(F.sequence(_bin(F.col(lo), bin_seconds), _bin(F.col(hi), bin_seconds)))
    left = a.withColumn("__bin", bins(*a_span))
    right = b.withColumn("__bin", bins(*b_span)).withColumnsRenamed({k: f"__{k}" for k in keys})
    on = left["__bin"] == right["__bin"]
    for k in keys:
        on = on & (left[k] == right[f"__{k}"])
    starts, ends = (F.col(c).between(F.col(a_span[0]), F.col(a_span[1])) for c in b_span)
    holds = starts | ends
    if full_overlap:
        holds = holds | ((F.col(b_span[0]) <= F.col(a_span[0])) & (F.col(b_span[1]) >= F.col(a_span[1])))
    once = left["__bin"] == _bin(F.greatest(F.col(a_span[0]), F.col(b_span[0])), bin_seconds)
    return left.join(right, on & holds & once).drop("__bin", *[f"__{k}" for k in keys])


def interval_sums(intervals: DataFrame, bars: DataFrame, keys: Sequence[str], span: tuple[str, str], ts: str, value: str, name: str) -> DataFrame:
    """The sum of ``value`` over the bars in each closed interval whose ends are bar times.

    The difference of running sums at both ends: two equality joins, whatever the intervals' lengths."""
    run = F.sum(value).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0))
    sums = bars.select(*keys, F.col(ts).alias("__ts"), run.alias("__sum"), (run - F.col(value)).alias("__before"))
    first = sums.select(*keys, F.col("__ts").alias(span[0]), "__before")
    last = sums.select(*keys, F.col("__ts").alias(span[1]), "__sum")
    return intervals.join(first, [*keys, span[0]], "left").join(last, [*keys, span[1]], "left").withColumn(name, F.col("__sum") - F.col("__before")).drop("__sum", "__before")
