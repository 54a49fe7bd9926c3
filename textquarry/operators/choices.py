"""Fields with a fixed list of values: literal mentions, bound to records by their anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import at_least
from ..functions.text import literal_mentions


def choice_mentions(docs: DataFrame, choices: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, choice, ix, start, end) of every literal mention of a choice, in any case, not within a longer word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [F.transform(literal_mentions(text, c), _with(c, i)) for i, c in enumerate(dict.fromkeys(choices))]
    return docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(F.concat(*found)).alias("x")).where("x is not null").select("doc_id", "x.choice", "x.ix", "x.start", "x.end")


def _with(choice: str, ix: int):
    return lambda s: F.struct(F.lit(choice).alias("choice"), F.lit(ix).alias("ix"), s["start"].alias("start"), s["end"].alias("end"))


def bind_to_anchors(mentions: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, owner, choice, ix, start, end): each mention with the last anchor that starts at or before it, or else the first
    anchor; of an owner's mentions of one choice, the first.

    ``anchors``: (doc_id, owner, a_start, a_end). An as-of join without a join of pairs: mentions and anchors are
    sorted together, and the last anchor seen is carried along.
    """
    events = mentions.select("doc_id", "choice", "ix", "start", "end", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("owner")).unionByName(
        anchors.select("doc_id", F.lit(None).cast("string").alias("choice"), F.lit(None).cast("int").alias("ix"), F.col("a_start").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(0).alias("kind"), F.col("owner").cast("int"))
    )
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("start", "kind", F.coalesce("owner", "ix"))
    before = F.last("owner", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.min(F.when(F.col("kind") == 0, F.struct("start", "owner"))).over(doc)["owner"]
    bound = events.withColumn("owner", F.coalesce(before, first)).where("kind = 1 and owner is not null")
    rank = F.row_number().over(Window.partitionBy("doc_id", "owner", "choice").orderBy("start", "ix"))
    return bound.withColumn("_r", rank).where("_r = 1").select("doc_id", "owner", "choice", "ix", "start", "end")


def nearest_to_anchor(bound: DataFrame, anchors: DataFrame) -> DataFrame:
    """Of each owner's mentions the one nearest to its anchor; of equally near ones the first."""
    both = bound.join(anchors.select("doc_id", "owner", "a_start", "a_end"), ["doc_id", "owner"])
    distance = F.greatest(F.col("a_start") - F.col("end"), F.col("start") - F.col("a_end"), F.lit(0))
    best = both.groupBy("doc_id", "owner").agg(F.min_by(F.struct("choice", "ix", "start", "end"), F.struct(distance.alias("d"), "start", "ix")).alias("x"))
    return best.select("doc_id", "owner", "x.*")


def choice_position(prefix: list[str], choice: str) -> int | None:
    """The first word of the prompt that is the choice, in any case."""
    return next((i for i, w in enumerate(prefix) if w.lower() == choice.lower()), None)


def matched_choice(surface: Column, choices: list[str]) -> Column:
    """The first choice equal to a surface in small letters, or null."""
    return F.coalesce(*[F.when(F.lower(surface) == c.lower(), F.lit(c)) for c in choices])


def decide_choice(scored: DataFrame, keys: list[str], scalar: bool, threshold: float) -> DataFrame:
    """From scores of the choices themselves (keys, choice, ix, score): the first best one if it reaches the threshold, or all that do."""
    kept = scored.where(at_least(F.col("score"), threshold))
    if not scalar:
        return kept
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ix"))
    return kept.withColumn("_r", rank).where("_r = 1").drop("_r")


def choice_values(literal: DataFrame, matched: DataFrame, scored: DataFrame, mentioned: DataFrame) -> DataFrame:
    """The first source that has a value for a record: literal mentions bound to it; nothing, if its document has literal mentions
    of any choice elsewhere; surfaces equal to a choice; scores of the choices. All: (doc_id, owner, choice, ...); ``mentioned``: (doc_id)."""
    cols = ["doc_id", "owner", "choice"]
    own = literal.select(*cols)
    elsewhere = own.select("doc_id").union(mentioned.select("doc_id")).distinct()
    second = matched.select(*cols).join(elsewhere, "doc_id", "left_anti")
    third = scored.select(*cols).join(elsewhere, "doc_id", "left_anti").join(second.select("doc_id", "owner").distinct(), ["doc_id", "owner"], "left_anti")
    return own.unionByName(second).unionByName(third)
