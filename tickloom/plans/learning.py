"""Queries that fit models and run streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.ml import dataset as ds
from tickloom.ml import models
from tickloom.plans.tables import bars_h
from tickloom.store import shared_dir
from tickloom.streaming.windows import stream_ewm, stream_latest, stream_sliding, stream_windows

FEATURES = ("close_lag1", "close_lag2", "volume_lag1", "ret_1m_lag1", "hour_of_day")


def _table(spark, d, task="direction", classes=2) -> DataFrame:
    bars = ds.with_calendar(ds.with_lags(ds.with_returns(bars_h(spark, d)), ["close", "volume", "ret_1m"], 2))
    labelled = bars.withColumn("label", ds.labels(task, 4, 500, classes).cast("double")).dropna(subset=["label", *FEATURES])
    return ds.split_time(labelled, embargo="6 hours").where("split IS NOT NULL")


def _fit(spark, d, name, task: models.Task, kind: str, **sizes) -> DataFrame:
    t = _table(spark, d, kind, task.classes)
    train = t.where("split = 'train'")
    if task.weight:
        train = models.with_class_weight(train, "label", task.weight)
    model = models.build(name, task, "light", **sizes).fit(train)
    return models.predict(model, t.where("split <> 'train'"), task, ["symbol", "ts", "split", "label"])


def q_model_forest(spark, d):
    return _fit(spark, d, "rf", models.Task("multiclass", FEATURES, classes=3, weight="weight"), "direction", trees=20, depth=4)


def q_model_boosted(spark, d):
    return _fit(spark, d, "hgbt", models.Task("binary", FEATURES), "direction", rounds=8, depth=3)


def q_model_logistic(spark, d):
    return _fit(spark, d, "logreg", models.Task("binary", FEATURES, weight="weight"), "direction", rounds=25)


def q_model_elastic(spark, d):
    return _fit(spark, d, "enet", models.Task("regression", FEATURES), "return", rounds=25)


def run_stream(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming frame over what its source holds now; its output as a table written to the shared folder."""
    path = f"{shared_dir(spark)}/tickloom-streams/{uuid.uuid4().hex}"
    query = out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _stream(spark, d) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"), F.lit(1.0).alias("volume"))


def q_stream_windows(spark, d):
    return run_stream(spark, stream_windows(_stream(spark, d))).withColumn("close", F.round("close", 6))


def q_stream_sliding(spark, d):
    out = run_stream(spark, stream_sliding(_stream(spark, d), "12 hours", "6 hours"))
    return out.select("symbol", "window_end", F.round("close_mean", 9).alias("close_mean"), "close_min", "close_max", "bars")


def q_stream_ewm(spark, d):
    return run_stream(spark, stream_ewm(_stream(spark, d), 12)).withColumn("ema", F.round("ema", 5))


def q_stream_latest(spark, d):
    hours = _stream(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    return run_stream(spark, stream_latest(hours, ["symbol"])).select("symbol", "ts")


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

SQL = {
    "stream_windows": """WITH w AS (SELECT event_type AS symbol, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, round(max_by(value, ts), 6) AS close, CAST(count(*) AS DOUBLE) AS total_volume FROM events GROUP BY 1, 2)
        SELECT * FROM w WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_sliding": """WITH s AS (SELECT event_type AS symbol, ts, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + to_hours(6 * k) AS window_end FROM events, (VALUES (1), (2)) t(k)),
        w AS (SELECT symbol, window_end, round(avg(value), 9) AS close_mean, min(value) AS close_min, max(value) AS close_max, count(*) AS bars FROM s GROUP BY 1, 2)
        SELECT * FROM w WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "stream_latest": "SELECT DISTINCT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts FROM events",
    "stream_ewm": """WITH RECURSIVE g AS (SELECT event_type AS symbol, ts, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
        e AS (SELECT symbol, ts, i, x AS ema FROM g WHERE i = 1
            UNION ALL
            SELECT g.symbol, g.ts, g.i, 11.0::DOUBLE / 13 * e.ema + 2.0::DOUBLE / 13 * g.x FROM e JOIN g ON g.symbol = e.symbol AND g.i = e.i + 1)
        SELECT symbol, ts, round(ema, 5) AS ema FROM e""",
}
