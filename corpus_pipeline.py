"""A training corpus from ``documents``: each stage takes what the one before has kept.

A stage takes rows of any number, none included, with nulls in any column and texts of any length, and further columns of any
name; all stages but the last return the columns that they were given. Rows that repeat one doc_id are one document to the
stages that drop documents: they stay or go together if their texts are equal, and are packed as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.decontamination import without_contaminated
from textquarry.llm.line_dedup import drop_boilerplate
from textquarry.llm.near_dup import near_duplicates
from textquarry.llm.packing import pack_documents
from textquarry.llm.quality import score_quality
from textquarry.llm.queries import tokenizer_path
from textquarry.llm.scratch import drop_path, new_path, stored, temporary_tables, unused_name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and blank texts are scored like any other."""
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; documents stay."""
    out = drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the least id stays. Documents without words stay, and so do rows without id.

    Shingles are of five words, as for all stages that leave their length open; the query op4 has four by its contract.
    """
    groups = near_duplicates(docs, k=5, percent=80)
    gone = stored(groups.where("not kept").select(F.col("doc_id").alias(unused_name(docs, "gone"))).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of the benchmark go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Classifier, near-duplicates and edit matching are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again. What a stage has written beside its
    result goes when the result is there, and a result when the next one is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            drop_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
