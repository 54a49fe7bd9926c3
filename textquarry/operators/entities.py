"""Entities: threshold, abstention, overlaps, validators, then lists or single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import at_least, sigmoid
from ..functions.text import matches
from ..schema import STR, EntitySpec, ExtractOptions
from .spans import resolve_overlaps

KEYS = ["doc_id", "label"]


def scores_of_logits(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    return rows.withColumn("score", sigmoid(F.col("logit") / temperature).cast("float")).drop("logit")


def above_threshold(spans: DataFrame, specs: list[EntitySpec], options: ExtractOptions) -> DataFrame:
    """Of each label, the spans that reach its own threshold, or else the request's."""
    limit = F.lit(float(options.threshold))
    for s in specs:
        if s.threshold is not None:
            limit = F.when(F.col("label") == s.name, F.lit(float(s.threshold))).otherwise(limit)
    return spans.where(at_least(F.col("score"), limit))


def without_abstained(spans: DataFrame, nulls: DataFrame, threshold: float) -> DataFrame:
    """Without the (doc_id, label) whose null logit says that there is nothing: sigmoid above the threshold."""
    quiet = nulls.where(sigmoid(F.col("null_logit")) > threshold).select(*KEYS)
    return spans.join(quiet, KEYS, "left_anti")


def where_counted(spans: DataFrame, counts: DataFrame) -> DataFrame:
    """Only documents whose most likely number of instances isn't 0; ``counts``: (doc_id, count_class)."""
    return spans.join(counts.where("count_class > 0").select("doc_id"), "doc_id", "left_semi")


def in_text(spans: DataFrame, first_word: int) -> DataFrame:
    """Without spans over the prompt's words, and without blank surfaces."""
    return spans.where((F.col("start") >= first_word) & (F.trim("text") != ""))


def validated(spans: DataFrame, specs: list[EntitySpec]) -> DataFrame:
    keep = F.lit(True)
    for s in specs:
        for v in s.validators:
            keep = F.when(F.col("label") == s.name, matches(F.col("text"), v) & keep).otherwise(keep)
    return spans.where(keep)


def distinct_values(spans: DataFrame, with_offsets: bool, order: list | None = None) -> DataFrame:
    """Of values equal in small letters (and offsets, if these are shown), the first by rank."""
    same = [*KEYS, F.lower("text")] + ([F.col("start"), F.col("end")] if with_offsets else [])
    rank = F.row_number().over(Window.partitionBy(*same).orderBy(*(order or [F.desc("score"), "start", "end"])))
    return spans.where(F.col("text") != "").withColumn("_r", rank).where("_r = 1").drop("_r")


def extract_entities(spans: DataFrame, specs: list[EntitySpec], options: ExtractOptions | None = None, greedy: bool = False) -> DataFrame:
    """Rows (doc_id, label, start, end, score, text): what is found, resolved within each label; of ``str`` labels the best one."""
    o = options or ExtractOptions()
    shown = [s for s in specs if not s.is_attribute]
    kept = resolve_overlaps(above_threshold(spans.where(F.col("label").isin([s.name for s in shown])), shown, o), KEYS, o.policy, greedy)
    kept = distinct_values(validated(kept, shown), o.include_spans)
    single = [s.name for s in shown if s.dtype == STR]
    if not single:
        return kept
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("score"), "start", "end"))
    return kept.withColumn("_r", rank).where(~F.col("label").isin(single) | (F.col("_r") == 1)).drop("_r")


def as_columns(docs: DataFrame, found: DataFrame, specs: list[EntitySpec], id_col: str = "doc_id") -> DataFrame:
    """One row a document: a column ``entities``, a struct with an array (or, for ``str``, a struct or null) for each label."""
    extra = ["attributes"] if "attributes" in found.columns else []
    mention = F.struct((-F.col("score")).alias("n"), "start", "end", "text", "score", *extra)
    groups = found.groupBy("doc_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("label") == s.name, mention))).alias(f"_{i}") for i, s in enumerate(specs)])
    out = docs.join(groups.withColumnRenamed("doc_id", id_col), id_col, "left")
    shape = lambda x: F.struct(x["text"].alias("text"), x["score"].alias("confidence"), x["start"].alias("start"), x["end"].alias("end"), *[x[c].alias(c) for c in extra])
    values = []
    for i, s in enumerate(specs):
        items = F.transform(F.coalesce(F.col(f"_{i}"), F.array()), shape)
        values.append((F.get(items, F.lit(0)) if s.dtype == STR else items).alias(s.name))
    return out.select(*docs.columns, F.struct(*values).alias("entities"))
