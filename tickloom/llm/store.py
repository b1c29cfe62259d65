"""Tables that cut lineage, as the rest of the library keeps them."""

from pyspark.sql import DataFrame

from tickloom.store import release, settle, shared_dir

__all__ = ["release", "settle", "settle_small", "shared_dir"]

#: Bytes of an Arrow batch of texts; the JVM and the worker each hold a few of them for every task.
BATCH_BYTES = 8 << 20


def settle_small(df: DataFrame, name: str) -> DataFrame:
    """``settle`` with Arrow batches of at most about ``BATCH_BYTES``; the session's own setting comes back afterwards."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, str(BATCH_BYTES))
    try:
        return settle(df, name)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)
