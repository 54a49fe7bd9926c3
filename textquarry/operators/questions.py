"""Typed questions: answers from probabilities of labels, and the state they are asked about as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import YES


def answers(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, task, label, ix, score) to one answer a (doc_id, task): ``score``: expected level and largest share;
    ``choice``: the most likely label; ``noul``: the probability of yes."""
    groups = rows.groupBy("doc_id", "task")
    if kind == "score":
        return groups.agg(F.sum(F.col("ix") * F.col("score")).alias("level"), F.max("score").alias("confidence"))
    if kind == "choice":
        return groups.agg(F.max_by("label", F.struct("score", -F.col("ix"))).alias("answer"), F.max("score").alias("confidence"))
    return groups.agg(F.max(F.when(F.col("label") == YES, F.col("score"))).alias("probability"))


def rendered_state(state: dict[str, Column]) -> Column:
    """One entry: its text alone; several: ``key: value`` lines, nested values as JSON."""
    if len(state) == 1:
        return next(iter(state.values())).cast("string")
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in state.items()])


def situation(speed: Column, distance: Column, height: Column, airborne: Column) -> Column:
    """A sentence about a runner and the obstacle ahead."""
    where = F.when(airborne, F.lit("in the air")).otherwise(F.lit("on the ground"))
    ahead = F.when(distance.isNull(), F.lit("The track ahead is clear.")).otherwise(F.format_string("An obstacle %.0f high is %.0f ahead.", height.cast("double"), distance.cast("double")))
    return F.concat(F.lit("The runner is "), where, F.format_string(" at speed %.1f. ", speed.cast("double")), ahead)
