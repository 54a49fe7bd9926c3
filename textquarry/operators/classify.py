"""Classification: label scores to decisions, and rankings of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import at_least, sigmoid, softmax_over
from ..schema import ClassificationSpec

TASK = ["doc_id", "task"]


def probabilities(rows: DataFrame, spec: ClassificationSpec, temperature: float = 1.0) -> DataFrame:
    """(doc_id, task, label, ix, logit) -> probability: sigmoid for multi-label tasks, else softmax over the task's labels."""
    logit = F.col("logit") / float(temperature)
    p = sigmoid(logit) if spec.uses_sigmoid else softmax_over(logit, *TASK)
    return rows.withColumn("score", p).drop("logit")


def decide(rows: DataFrame, multi_label: bool, threshold: float = 0.5) -> DataFrame:
    """The predicted labels: the first of the highest; multi-label: all that reach the threshold, or that one if none does."""
    first = F.row_number().over(Window.partitionBy(*TASK).orderBy(F.desc("score"), "ix"))
    ranked = rows.withColumn("_r", first)
    keep = (F.col("_r") == 1) if not multi_label else (F.col("_r") == 1) | at_least(F.col("score"), threshold)
    if multi_label:
        # the first of the ranking reaches the threshold if any does, so it is in either case
        return ranked.where(keep).drop("_r")
    return ranked.where(keep).drop("_r")


def top_labels(rows: DataFrame, k: int) -> DataFrame:
    """The k best labels of each task, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(*TASK).orderBy(F.desc("score"), "ix"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def sharded(labels: list[str], size: int = 400) -> list[list[str]]:
    """A long list of labels in shards that are scored one by one; their rows are united."""
    return [labels[i : i + size] for i in range(0, len(labels), size)]


def rank_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, task, label, rank, labels): where a known label stands among all, by score, then label; ``wanted``: (doc_id, label).

    Counts the labels ahead of it instead of ranking all.
    """
    own = rows.join(wanted.select("doc_id", "label"), ["doc_id", "label"]).select("doc_id", "task", F.col("label").alias("_l"), F.col("score").alias("_s"))
    ahead = (F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("label") < F.col("_l")))
    return rows.join(own, ["doc_id", "task"]).groupBy("doc_id", "task", F.col("_l").alias("label")).agg((1 + F.count_if(ahead)).alias("rank"), F.count(F.lit(1)).alias("labels"))


def as_result(rows: DataFrame, multi_label: bool) -> DataFrame:
    """One row a (doc_id, task): label and confidence, or arrays of both in descending order."""
    item = F.struct((-F.col("score")).alias("n"), "ix", "label", "score")
    groups = rows.groupBy(*TASK).agg(F.sort_array(F.collect_list(item)).alias("x"))
    if multi_label:
        return groups.select(*TASK, F.col("x.label").alias("labels"), F.col("x.score").alias("confidences"))
    return groups.select(*TASK, F.get(F.col("x.label"), F.lit(0)).alias("label"), F.get(F.col("x.score"), F.lit(0)).alias("confidence"))
