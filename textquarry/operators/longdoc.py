"""Long documents: chunks are rows; what is found in them is put back in place and merged by document.

No relation or record is formed across chunks. Merging is the only shuffle, of compact result rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OverlapPolicy
from .spans import resolve_overlaps


def clipped(found: DataFrame, length: str) -> DataFrame:
    """Spans cut to their chunk's length; empty ones go (a final mark that was added isn't part of the text)."""
    return found.withColumn("end", F.least("end", F.col(length))).where("end > start")


def remapped(found: DataFrame, offset: str = "chunk_start") -> DataFrame:
    """Offsets in the chunk to offsets in the document."""
    return found.withColumn("start", (F.col("start") + F.col(offset)).cast("int")).withColumn("end", (F.col("end") + F.col(offset)).cast("int"))


def merge_spans(found: DataFrame, keys: list[str], policy: OverlapPolicy | str = OverlapPolicy.FLAT, single: list[str] | None = None) -> DataFrame:
    """Repeated spans keep their best copy, then the policy; of ``single`` labels the earliest one stays."""
    kept = resolve_overlaps(found, keys, policy)
    if not single:
        return kept
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "text"))
    return kept.withColumn("_r", rank).where(~F.col("label").isin(single) | (F.col("_r") == 1)).drop("_r")


def merge_single_label(rows: DataFrame) -> DataFrame:
    """(doc_id, task, label, score): of the chunks' decisions the most confident, the last one of equals."""
    best = rows.groupBy("doc_id", "task").agg(F.max_by(F.struct("label", "score"), F.struct("score", "chunk_ix")).alias("x"))
    return best.select("doc_id", "task", "x.label", "x.score")


def merge_multi_label(rows: DataFrame) -> DataFrame:
    """The labels that any chunk has decided for, each with its highest confidence."""
    return rows.groupBy("doc_id", "task", "label").agg(F.max("score").alias("score"))


def merge_by_vote(rows: DataFrame, keys: list[str], value: str = "label") -> DataFrame:
    """Values without confidences: the most frequent one, the earliest of equals."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min("chunk_ix").alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("votes", -F.col("first"))).alias(value))


def merge_relations(edges: DataFrame) -> DataFrame:
    """Edges with equal spans at both ends keep their best copy, the earliest of equals."""
    key = ["doc_id", "relation", "h_start", "h_end", "t_start", "t_end"]
    best = edges.groupBy(*key).agg(F.max_by(F.struct("h_text", "t_text", "score"), F.struct("score", -F.col("chunk_ix"))).alias("x"))
    return best.select(*key, "x.*")


def merge_attributes(rows: DataFrame) -> DataFrame:
    """Attributes of equal spans keep those of the earliest chunk."""
    key = ["doc_id", "label", "start", "end", "attribute_group"]
    first = F.min("chunk_ix").over(Window.partitionBy(*key))
    return rows.withColumn("_f", first).where(F.col("chunk_ix") == F.col("_f")).select(*key, "attribute", "score")


def merge_records(records: DataFrame) -> DataFrame:
    """(doc_id, structure, record, score, first): of records that are equal but for confidences the copy of the highest score, the
    earliest of equals; ``first`` is the (chunk, place) where one first stood. ``records``: (doc_id, chunk_ix, structure, record, score, place)."""
    bare = F.regexp_replace(F.to_json("record"), r'"confidence":[-+.0-9eE]+,?', "")
    at = F.struct("chunk_ix", "place")
    keyed = records.withColumn("_key", bare).withColumn("_at", at)
    best = F.max_by("record", F.struct("score", -F.col("chunk_ix"), -F.col("place")))
    return keyed.groupBy("doc_id", "structure", "_key").agg(best.alias("record"), F.max("score").alias("score"), F.min("_at").alias("first")).drop("_key")


def as_list(value):
    """A single value as an array of one, a null as an empty array: what merging needs where one chunk gives a list and another a value."""
    return F.when(value.isNull(), F.array()).otherwise(F.array(value))
