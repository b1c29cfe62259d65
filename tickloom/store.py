"""Tables that cut lineage, kept in the folder the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a DataFrame that reads it.

    Later stages then restart from the table, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tickloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables written so far. Call it only when no DataFrame made from them is needed."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)
        except Exception:  # the session has ended; nothing can be deleted through it
            continue


atexit.register(release)
