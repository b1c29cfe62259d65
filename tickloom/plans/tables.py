"""Input tables and the bars that queries make of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.bars import bars_from_ticks


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars_h(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of event values by event type; the volume is the number of events."""
    e = table(spark, folder, "events")
    return bars_from_ticks(e, F.col("event_type"), F.col("ts"), F.col("value"), F.struct("ts", "event_id"), F.lit(1.0), "1 hour")


def bars_d(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of unit prices by return flag and status; the volume is the quantity."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return bars_from_ticks(l, F.concat("l_returnflag", "l_linestatus"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), order, F.col("l_quantity"), "1 day")


BARS_H = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min_by(value, {'ts': ts, 'id': event_id}) AS open, max(value) AS high, min(value) AS low,
        max_by(value, {'ts': ts, 'id': event_id}) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
BARS_D = """ticks AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, l_extendedprice / l_quantity AS p, l_quantity AS q,
        {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice, 'd': l_quantity} AS o FROM lineitem),
    bars AS (SELECT symbol, ts, min_by(p, o) AS open, max(p) AS high, min(p) AS low, max_by(p, o) AS close, sum(q) AS volume FROM ticks GROUP BY 1, 2)"""
