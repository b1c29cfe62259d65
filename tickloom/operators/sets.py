"""Set operations that keep an order or a particular row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.store import settle


def union_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a frame lacks are NULL in its rows."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``__part``: parts of successive ranges of an order, the first one lowest, written so that they hold.

    What runs along the whole order then runs along each part, from where the totals of the parts before it end."""
    return settle(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")


def before_parts(parted: DataFrame, **sums: Column) -> DataFrame:
    """One row for each part: each named sum over all parts before it."""
    totals = parted.groupBy("__part").agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


def distinct_in_order(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The distinct keys with their first ``place`` in the given order, counted from 0."""
    first = in_ranges(df.groupBy(*keys).agg(F.min(order).alias("__o")), "__o", *keys)
    # one row for each part
    placed = first.join(F.broadcast(before_parts(first, __n=F.count(F.lit(1)))), "__part")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__o", *keys))
    return placed.withColumn("place", F.col("__n") + inside - 1).drop("__o", "__n", "__part")


def keep_last(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Of each key the last row by ``order``; one aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*df.columns)
