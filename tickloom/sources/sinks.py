"""Where results go."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.registry import describe_column


def write_csv(df: DataFrame, path: str, skip_empty: bool = False) -> bool:
    """CSV with a header; with ``skip_empty`` nothing is written for no rows. Whether it was written."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).csv(path)
    return True


def write_snapshot(df: DataFrame, path: str, asof: str = "timestamp_asof_utc", compression: str = "snappy") -> None:
    """Parquet in one folder per day of ``asof``; days already there and not in ``df`` stay."""
    days = df.withColumn("dt", F.date_format(asof, "yyyy-MM-dd"))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("dt").parquet(path)


def schema_sidecar(df: DataFrame) -> str:
    """JSON of every column's type and, from its name, metric family, window and tag."""
    return json.dumps({f.name: {"dtype": f.dataType.simpleString(), **describe_column(f.name)} for f in df.schema}, sort_keys=True)


def write_text_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def play_cards(signals: DataFrame, per_symbol: int = 6) -> DataFrame:
    """Up to ``per_symbol`` lines of text for each symbol, triggers first, then by timeframe and type."""
    from tickloom.operators.analytic import first_rows

    top = first_rows(signals, ["symbol"], [F.when(F.col("status") == "trigger", 0).otherwise(1), "timeframe", "signal_type"], per_symbol)
    line = F.format_string("%s %s %s %s entry=%s stop=%s t1=%s", "symbol", "timeframe", "signal_type", "status", F.col("entry").cast("string"), F.col("stop").cast("string"), F.col("target1").cast("string"))
    return top.select("symbol", line.alias("line"))


def cards_json(df: DataFrame, key: str) -> DataFrame:
    """One JSON document per key with its rows in order of all columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("json"))
