"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) of long nodes -> (node, root): each node of a link with the smallest node it reaches.

    Every round points all neighbours at the smallest one, first from the larger side of each link, then
    from the smaller side, until nothing changes; the number of rounds grows with the logarithm of the
    longest path. Rounds aggregate and join on nodes only, so a hub is split like any skewed key."""
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m"))
        large = now.join(least, now["b"] == least["u"]).select("a", F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.withColumnRenamed("a", "u"), large["a"] == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = settle(down.select("a", F.col("m").alias("b")).unionByName(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
