"""The queries of this subpackage: name -> function of (spark, sf_dir), and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import compression_classifier, oracle
from tickloom.llm.bfd_packing import bfd_packing
from tickloom.llm.byte_bpe import encode
from tickloom.llm.edit_counts import recount
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.harmonic_packing import cut_documents, harmonic_packing
from tickloom.llm.lm_scoring import lm_scores
from tickloom.llm.near_dedup import near_dedup
from tickloom.llm.quality_rules import BASE, quality_rules
from tickloom.llm.url_filters import filter_captures, url_host


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), decode=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _day(offset) -> F.Column:
    return F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)) + F.make_dt_interval(offset)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` carries neither fetch times nor a list, so both follow from its rows by fixed rules: a page is
    fetched on day 37 * page_id mod 366 of 2024; of the hosts seen, some are listed, removed and listed
    again on days that a hash of the host gives, and so is example.org as a whole."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day((F.col("page_id") * 37 % 366).cast("int")))
    hosts = captures.select(url_host(F.col("url")).alias("pattern")).where("pattern IS NOT NULL").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int"))
    chosen = hosts.where("h % 3 = 0 OR pattern LIKE 'spam%'")
    entry = lambda rows, name, action, day: rows.select(F.lit(name).alias("list"), "pattern", F.lit(action).alias("action"), _day(day).alias("at"))
    first = (F.col("h") % 180).cast("int")
    whole = spark.range(1).select(F.lit("example.org").alias("pattern"))
    entries = [
        entry(chosen, "hosts", "add", first),
        entry(chosen.where("h % 2 = 0"), "hosts", "remove", first + 60),
        entry(chosen.where("h % 4 = 0"), "hosts", "add", first + 120),
        entry(whole, "domains", "add", F.lit(200)),
        entry(whole, "domains", "remove", F.lit(230)),
    ]
    union = entries[0]
    for more in entries[1:]:
        union = union.unionByName(more)
    return filter_captures(captures, union).select("page_id", "host", "fetched_at", "listed", "list", "pattern", "valid_from")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", *BASE, "base_failed", "kept", "pattern", F.round("p_good", 6).alias("p_good"))


def op4_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bfd_packing(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", F.crc32("ids_le").alias("ids_crc32"), F.crc32("positions_le").alias("positions_crc32"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recount(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), texts_out=False)


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    packed = harmonic_packing(pieces.withColumn("ids_crc32", F.crc32("ids_le")).drop("ids_le"))
    return packed.select(F.col("id").alias("doc_id"), "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, prior = compression_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return compression_classifier.classify(docs, model, prior, carry=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_url_filters": op2_url_filters,
    "op3_quality_rules": op3_quality_rules,
    "op4_bfd_packing": op4_bfd_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_edit_counts": op6_edit_counts,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_compression_classifier": op8_compression_classifier,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL = {
    "op2_url_filters": """
        WITH captures AS (
            SELECT page_id, TIMESTAMP '2024-01-01' + to_days(CAST(page_id * 37 % 366 AS INTEGER)) AS fetched_at,
                   nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:@\\[]+)', 1)), '\\.$', ''), '') AS host
            FROM pages),
        hosts AS (SELECT DISTINCT host AS pattern, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS h FROM captures WHERE host IS NOT NULL),
        chosen AS (SELECT pattern, h, h % 180 AS d FROM hosts WHERE h % 3 = 0 OR pattern LIKE 'spam%'),
        intervals AS (
            SELECT 'hosts' AS list, pattern, d AS d0, CASE WHEN h % 2 = 0 THEN d + 60 END AS d1 FROM chosen
            UNION ALL SELECT 'hosts', pattern, d + 120, NULL FROM chosen WHERE h % 4 = 0
            UNION ALL SELECT 'domains', 'example.org', 200, 230),
        valid AS (SELECT list, pattern, TIMESTAMP '2024-01-01' + to_days(d0) AS valid_from, TIMESTAMP '2024-01-01' + to_days(d1) AS valid_to FROM intervals),
        hits AS (
            SELECT c.page_id, v.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.pattern) DESC, v.valid_from DESC, v.list) AS k
            FROM captures c JOIN valid v ON (c.host = v.pattern OR c.host LIKE '%.' || v.pattern AND NOT regexp_matches(c.host, '^\\[|^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$'))
                AND v.valid_from <= c.fetched_at AND (v.valid_to IS NULL OR c.fetched_at < v.valid_to))
        SELECT c.page_id, c.host, c.fetched_at, h.pattern IS NOT NULL AS listed, h.list, h.pattern, h.valid_from
        FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.k = 1
    """,
    "op3_quality_rules": oracle.quality_rules(),
    "op5_near_dedup": oracle.NEAR_DEDUP,
    "op10_exact_dedup": oracle.EXACT_DEDUP,
}
