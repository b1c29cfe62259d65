"""Session factory, and what lets Python workers import this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    builder = builder.master(master) if master else builder
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def expose_package(spark: SparkSession) -> None:
    """Put the folder that holds this package on the workers' path, for sessions started without ``--py-files``."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
