"""Harmonic packing of documents into fixed-length sequences.

A piece of length r belongs to class k = capacity // r, and k pieces of a class always fit in one
sequence. Documents are cut so that pieces lie at the top of their class: full sequences first, then, as
long as k pieces of the rest would leave more than ``waste`` of a sequence empty, a piece of
capacity // (k + 1). Every class is filled on its own, k pieces to a sequence, from counts alone; no
worker needs to see another's pieces. What is left of the classes in the end is under one sequence each
and is packed by first-fit decreasing in one small group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.store import settle_small
from tickloom.llm.tokens import MOST, slices, word_encoder


def cut_lengths(n: int, capacity: int = 2048, waste: float = 0.02) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    pieces = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k * rest >= (1 - waste) * capacity or k >= 32:
            pieces.append(rest)
            break
        pieces.append(capacity // (k + 1))
        rest -= pieces[-1]
    return pieces


PIECES = "id bigint, start bigint, length int, doc_tokens bigint, ids_le binary"


def _tokenise(path: str, end_id: int, capacity: int, waste: float, most: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path, most)
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, texts in slices(b.column(1)):
                rows: list[tuple] = []
                for id_, tokens in zip(ids[at:], encoder.encode(texts)):
                    tokens += end
                    n, start = len(tokens) // 4, 0
                    for length in cut_lengths(n, capacity, waste):
                        rows.append((id_, start, length, n, tokens[4 * start : 4 * (start + length)]))
                        start += length
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "start", "length", "doc_tokens", "ids_le"])

    return run


def cut_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048, waste: float = 0.02, most: int = MOST) -> DataFrame:
    """Tokenise every whole text, append ``end_id`` and cut: (id, start, length, doc_tokens, ids_le).

    Workers remember about ``most`` chunks of text in each of two generations."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col)).mapInArrow(_tokenise(vocabulary, end_id, capacity, waste, most), PIECES)


def _first_fit(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "start", "row"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        free, fill, bins = [], [], []
        for n in pdf["length"]:
            at = next((i for i, room in enumerate(free) if room >= n), len(free))
            if at == len(free):
                free.append(capacity)
            bins.append(at)
            fill.append(capacity - free[at])
            free[at] -= n
        return pdf.assign(sequence_id=np.asarray(bins, "int64"), offset=np.asarray(fill, "int64"))

    return run


def harmonic_packing(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (id, start, length <= capacity, and more columns) with ``sequence_id`` and ``offset``.

    ``pieces`` is written once, as its numbering reads it more than once. Full sequences of class k are
    numbered from the counts of pieces in each (class, bucket of the id's hash); so sequence ids are
    unique but have gaps between classes, while offsets within a sequence have none. Null ids and
    repeated rows are pieces like any other; an empty table gives an empty result."""
    spark = pieces.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = pieces.drop("sequence_id", "offset", "class", "bucket", "row", "rank")
    held = held.withColumn("class", F.floor(F.lit(capacity) / F.col("length")).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)).cast("int"))
    held = settle_small(held.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = held.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("class")
    upto = by_class.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each class (at most 31 + 64) and bucket, joined where the ranks' rows already are
    before = counts.select("class", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(by_class).alias("total"))
    rank = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("id", "start", "row")) - 1
    ranked = held.withColumn("rank", rank).join(before, ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    whole = F.col("rank") < F.col("total") - F.col("total") % F.col("class")
    inside = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.where(whole).withColumn("sequence_id", (F.floor(F.col("rank") / F.col("class")) + 1) * 4096 + F.col("class"))
    full = full.withColumn("offset", F.when(F.col("class") == 1, F.lit(0)).otherwise(F.coalesce(F.sum("length").over(inside), F.lit(0))).cast("bigint")).drop("class", "bucket", "row", "rank", "before", "total")
    # under one sequence of tokens of each class, so one group holds them
    rest = ranked.where(~whole).drop("class", "bucket", "rank", "before", "total")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id bigint, offset bigint"
    rest = rest.groupBy(F.lit("rest").alias("__all")).applyInPandas(_first_fit(capacity), schema).drop("row")
    # class 1 leaves nothing over, so ids of the form 4096 * m are free for what is left
    return full.unionByName(rest.withColumn("sequence_id", F.col("sequence_id") * 4096))
