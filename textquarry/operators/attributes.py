"""Attributes of entities: every label of a group is scored against every entity's span it applies to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import at_least, sigmoid, softmax_over
from ..schema import AttributeGroup

SPAN = ["doc_id", "label", "start", "end"]


def attribute_pairs(entities: DataFrame, name: str, group: AttributeGroup) -> DataFrame:
    """(doc_id, label, start, end, text, attribute, ix) of each entity the group applies to with each of its labels; a group's labels are a short literal array, so nothing is joined."""
    owners = entities if group.applies_to is None else entities.where(F.col("label").isin(list(group.applies_to)))
    labels = F.array(*[F.struct(F.lit(x).alias("attribute"), F.lit(i).alias("ix")) for i, x in enumerate(group.labels)])
    return owners.select(*SPAN, "text", F.explode(labels).alias("x")).select(*SPAN, "text", F.lit(name).alias("attribute_group"), "x.attribute", "x.ix")


def decide_attributes(scored: DataFrame, group: AttributeGroup) -> DataFrame:
    """``scored`` has a ``logit`` a pair. Multi-label: all labels whose sigmoid reaches the threshold. Else the first of the most
    likely, with its softmax share, whatever that is. Results belong to (label, span)."""
    if group.multi_label:
        out = scored.withColumn("score", sigmoid(F.col("logit")))
        return out.where(at_least(F.col("score"), group.threshold)).drop("logit", "ix")
    shared = scored.withColumn("score", softmax_over(F.col("logit"), *SPAN))
    rank = F.row_number().over(Window.partitionBy(*SPAN).orderBy(F.desc("logit"), "ix"))
    return shared.withColumn("_r", rank).where("_r = 1").drop("_r", "logit", "ix")


def scored_attributes(docs: DataFrame, entities: DataFrame, groups: dict[str, AttributeGroup], scorer) -> DataFrame | None:
    """Rows (doc_id, label, start, end, attribute_group, attribute, score) of all groups; ``scorer`` scores the pairs of spans and labels."""
    out = None
    for name, group in groups.items():
        pairs = attribute_pairs(entities, name, group)
        query = F.concat(F.lit(f"{name}: "), F.col("attribute")) if group.qualify_labels else F.col("attribute")
        decided = decide_attributes(scorer.explicit(docs, pairs.withColumn("query", query)), group)
        rows = decided.select(*SPAN, "attribute_group", "attribute", F.col("score").cast("float").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def attached(entities: DataFrame, found: DataFrame, groups: dict[str, AttributeGroup]) -> DataFrame:
    """``entities`` with a column ``attributes``: a struct with, for each group, (label, confidence), or an array of these for a multi-label group."""
    item = F.struct((-F.col("score")).alias("n"), F.col("attribute").alias("label"), F.col("score").alias("confidence"))
    lists = found.groupBy(*SPAN).agg(*[F.sort_array(F.collect_list(F.when(F.col("attribute_group") == g, item))).alias(f"_{i}") for i, g in enumerate(groups)])
    out = entities.join(lists, SPAN, "left")
    values = []
    for i, (name, group) in enumerate(groups.items()):
        items = F.transform(F.coalesce(F.col(f"_{i}"), F.array()), lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence")))
        values.append((items if group.multi_label else F.get(items, F.lit(0))).alias(name))
    return out.select(*entities.columns, F.struct(*values).alias("attributes"))
