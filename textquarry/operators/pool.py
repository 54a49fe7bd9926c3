"""Candidate pools: spans formed from scored boundaries, and cut to the best few before anything is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_max(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, score): of each boundary the best score over all queries."""
    return rows.groupBy(*keys, "position").agg(F.max("score").alias("score"))


def best_boundaries(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "position"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def boundary_pairs(starts: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of the best starts and ends with end > start; score is the sum of both."""
    a = starts.select(*keys, F.col("position").alias("start"), F.col("score").alias("_s"))
    b = ends.select(*keys, F.col("position").alias("end"), F.col("score").alias("_e"))
    return a.join(b, keys).where("end > start").select(*keys, "start", "end", (F.col("_s") + F.col("_e")).alias("score"))


def query_quota(rows: DataFrame, keys: list[str], query: str, quota: int) -> DataFrame:
    """The best spans of each query, with scores above all others: 5000 + quota - rank (from 0)."""
    rank = F.row_number().over(Window.partitionBy(*keys, query).orderBy(F.desc("score"), "start", "end")) - 1
    return rows.withColumn("_r", rank).where(F.col("_r") < quota).withColumn("score", (5000 + quota - F.col("_r")).cast("double")).drop("_r")


def pooled(rows: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """Distinct spans with their best score, the best ``capacity`` of them; of equal ones the first span."""
    best = rows.groupBy(*keys, "start", "end").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "start", "end"))
    return best.withColumn("slot", rank - 1).where(F.col("slot") < capacity)


def candidate_pool(starts: DataFrame, ends: DataFrame, by_query: DataFrame, keys: list[str], query: str, k: int, quota: int, capacity: int) -> DataFrame:
    """Pairs of the best boundaries, united with each query's own best spans, cut to the capacity."""
    general = boundary_pairs(best_boundaries(starts, keys, k), best_boundaries(ends, keys, k), keys)
    own = query_quota(by_query, keys, query, quota).select(*keys, "start", "end", "score")
    return pooled(general.unionByName(own), keys, capacity)


def all_spans(lengths: DataFrame, keys: list[str], length: str, max_width: int) -> DataFrame:
    """Every (start, end) of up to ``max_width`` words in texts of ``length`` words; ends exclusive."""
    starts = lengths.where(F.col(length) > 0).select(*keys, length, F.explode(F.sequence(F.lit(0), F.col(length) - 1)).alias("start"))
    width = F.explode(F.sequence(F.lit(1), F.least(F.lit(max_width), F.col(length) - F.col("start"))))
    return starts.select(*keys, "start", width.alias("_w")).select(*keys, "start", (F.col("start") + F.col("_w")).cast("int").alias("end"))
