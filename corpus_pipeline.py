"""Corpus cleaning in five stages: quality rules, quality classifier, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. The classifier learns from the labelled rows of the source table,
so that what the rules rejected still teaches it. No stage is given in SQL as a whole: the rules' and
classifier's models are fitted iteratively, so tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import compression_classifier
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.harmonic_packing import cut_documents, harmonic_packing
from tickloom.llm.near_dedup import keep_first
from tickloom.llm.quality_rules import quality_rules
from tickloom.llm.queries import vocabulary
from tickloom.llm.store import settle


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, with the columns of ``docs``.

    Null and empty texts fail the base check and go. Rows that repeat are judged alike, null ids like others; an empty
    table gives no rows; extra columns come along, unless named like the rules' own."""
    return quality_rules(docs).where("kept").select(docs.columns)


def reject_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier takes for good, with the columns of ``docs``.

    It learns from the labelled rows of the source table but those held out; with too few labels of a class every
    row has the labels' share as its score, and an empty table of labels keeps all. Null is the empty text. Rows that
    repeat are judged alike; an empty table gives no rows; extra columns come along, unless named like the
    classifier's own."""
    source, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    model, prior = compression_classifier.fit(source, labels)
    return compression_classifier.classify(docs, model, prior).where("predicted = 1").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest id, with the columns of ``docs``.

    Null counts as the empty text; a null id stays only where no other id has the text; of rows that repeat an id and
    its text one stays. An empty table gives no rows; extra columns come along, unless named like the operator's own."""
    return exact_dedup(docs, keep="largest").where("kept").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more the row with the smallest id, with all columns of ``docs``.

    Null and empty texts link with nothing and stay. Rows that repeat an id and its text stay together, which the stage
    before rules out; an empty table gives no rows."""
    return keep_first(docs, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows' token ids and their places in sequences of 2048.

    A null or empty text is the end id alone. Null ids and rows that repeat are packed like others; an empty table gives
    no rows; other columns of ``docs`` are not read."""
    pieces = cut_documents(docs, vocabulary("word_bpe_49k.json"), most=REMEMBERED).withColumn("ids_crc32", F.crc32("ids_le")).drop("ids_le")
    return harmonic_packing(pieces).select(F.col("id").alias("doc_id"), "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Chunks that a tokenising worker remembers: workers serve all stages, so what one of them keeps lies beside the others' work.
REMEMBERED = 100_000

STAGES = [
    ("quality rules", reject_by_rules),
    ("quality classifier", reject_by_classifier),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
