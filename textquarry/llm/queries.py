"""One query an operator: the operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread
from . import sql
from .decontamination import benchmark_matches
from .embedding_dup import embedding_duplicates
from .language import identify_languages
from .line_dedup import drop_boilerplate
from .near_dup import near_duplicates
from .packing import pack_documents
from .quality import score_quality
from .secrets import BASE, scan_secrets, spans_text
from .sharding import proportional_shards
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select(*columns))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_languages(_documents(spark, sf_dir, "doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir, "doc_id", "text"), tokenizer_path(), with_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "source")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir, "doc_id", "text"), k=4)


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_documents(spark, sf_dir, "doc_id", "text"))
    kinds = [x[0] for x in BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *[_of_kind(k).alias(f"n_{k}") for k in kinds], F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return benchmark_matches(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(_table(spark, sf_dir, "pages"))).drop("url")


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = proportional_shards(_documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(_documents(spark, sf_dir, "doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_best_fit_packing,
        op3_line_dedup,
        op4_near_duplicates,
        op5_secret_scan,
        op6_decontamination,
        op7_warc_archives,
        op8_stratified_shards,
        op9_quality_classifier,
        op10_embedding_duplicates,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": sql.line_dedup_sql(),
    "op5_secret_scan": sql.secrets_sql(),
    "op7_warc_archives": sql.warc_sql(),
    "op8_stratified_shards": sql.sharding_sql(),
    "op10_embedding_duplicates": sql.embedding_sql(),
}
