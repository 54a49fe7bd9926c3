"""Outputs: JSON, JSON lines and arrays, tab-separated values, text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.scores import at_least


def pretty_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def json_array(rows: DataFrame, order: str) -> DataFrame:
    """One row with all rows in one array: for results that are meant to be read as a whole."""
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rows.columns).alias("x")))), lambda r: r["x"])).alias("value"))


def _clean(text: Column) -> Column:
    return F.translate(text, "\t\r\n", "   ")


def tsv_rows(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """(doc_id, line): text, task, label and probability to four decimals, tab-separated."""
    both = docs.join(scored, "doc_id")
    return both.select("doc_id", F.concat_ws("\t", _clean(F.col("text")), _clean(F.col("task")), _clean(F.col("label")), F.format_string("%.4f", F.col("score").cast("double"))).alias("line"))


def _decided(multi_label: bool, threshold: float) -> Column:
    best = F.get(F.filter(F.col("x"), lambda a: a["score"] == F.array_max(F.transform("x", lambda b: b["score"]))), F.lit(0))
    if not multi_label:
        return F.transform("x", lambda a: a["ix"] == best["ix"])
    none = ~F.exists("x", lambda a: at_least(a["score"], threshold))
    return F.transform("x", lambda a: at_least(a["score"], threshold) | (none & (a["ix"] == best["ix"])))


def classification_lines(docs: DataFrame, scored: DataFrame, multi_label: bool, threshold: float, show_all: bool = True, tasks: list[str] | None = None) -> DataFrame:
    """(doc_id, line): ``text<TAB>task: label (0.123), ...`` by label order; ``*`` marks what is predicted when all labels are shown.

    Several tasks stand in the order of ``tasks``, the session's; those it doesn't name, by name after them.
    """
    groups = scored.groupBy("doc_id", "task").agg(F.sort_array(F.collect_list(F.struct("ix", "label", "score"))).alias("x"))
    groups = groups.withColumn("y", F.zip_with("x", _decided(multi_label, threshold), lambda a, d: F.struct(a["label"].alias("label"), a["score"].alias("score"), d.alias("on"))))
    items = F.col("y") if show_all else F.filter("y", lambda a: a["on"])
    mark = lambda a: F.when(a["on"], F.lit("*")).otherwise(F.lit("")) if show_all else F.lit("")
    words = F.transform(items, lambda a: F.concat(mark(a), a["label"], F.format_string(" (%.3f)", a["score"].cast("double"))))
    place = F.array_position(F.array(*[F.lit(t) for t in tasks or [""]]), F.col("task"))
    each = groups.select("doc_id", F.when(place == 0, len(tasks or [""]) + 1).otherwise(place).alias("o"), F.concat(F.col("task"), F.lit(": "), F.array_join(words, ", ")).alias("part"))
    lines = each.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("o", "part")))["part"], " | ").alias("part"))
    return docs.join(lines, "doc_id").select("doc_id", F.concat_ws("\t", _clean(F.col("text")), F.col("part")).alias("line"))


def classification_json(decided: DataFrame, multi_label: bool, probabilities: str | None = None) -> Column:
    """{label, confidence} or {labels, confidences} of the columns of ``classify.as_result``; with a column of ranked probabilities
    (``ranked_probabilities``), these too, as {label: probability} in their order."""
    fields = ["labels", "confidences"] if multi_label else ["label", "confidence"]
    return F.to_json(F.struct(*fields, *([F.map_from_entries(probabilities).alias("probabilities")] if probabilities else [])))


def ranked_probabilities(scored: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, task, probabilities): array<struct<label,score>> of all labels, or the best ``most``, by score descending, then label order."""
    item = F.struct((-F.col("score")).alias("n"), "ix", "label", "score")
    groups = scored.groupBy("doc_id", "task").agg(F.sort_array(F.collect_list(item)).alias("x"))
    best = F.col("x") if most is None else F.slice("x", 1, most)
    return groups.select("doc_id", "task", F.transform(best, lambda a: F.struct(a["label"].alias("label"), a["score"].alias("score"))).alias("probabilities"))


def without_metadata(value: Column, kind: DataType, confidence: bool, offsets: bool) -> Column:
    """A result without the confidences and offsets that weren't asked for, at any depth; ``kind`` is its type.

    A mention (text, with offsets or a confidence) becomes its text alone, unless something of it is left, such as attributes. A
    decision (label, confidence) becomes its label.
    """
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: without_metadata(x, kind.elementType, confidence, offsets))
    if not isinstance(kind, StructType):
        return value
    names, kept = kind.fieldNames(), []
    decision = set(names) == {"label", "confidence"}
    mention = "text" in names and ("start" in names or "confidence" in names)
    if decision or mention:
        main = "label" if decision else "text"
        dropped = ["confidence"] * (not confidence) + ["start", "end"] * (not offsets)
        names = [n for n in names if n not in dropped]
        if names == [main]:
            return value[main]
    for n in names:
        kept.append(without_metadata(value[n], kind[n].dataType, confidence, offsets).alias(n))
    return F.when(value.isNotNull(), F.struct(*kept))


def shown(results: DataFrame, confidence: bool, offsets: bool) -> DataFrame:
    """Rows of ``extract`` with every column cut by :func:`without_metadata`."""
    return results.select(*[without_metadata(F.col(f.name), f.dataType, confidence, offsets).alias(f.name) for f in results.schema])


def mention_shape(confidence: bool, offsets: bool):
    """How a mention (text, confidence, start, end) is shown: text alone, or with confidence, offsets or both."""

    def shape(m: Column) -> Column:
        if not (confidence or offsets):
            return m["text"]
        fields = ["text"] + ["confidence"] * confidence + ["start", "end"] * offsets
        return F.struct(*[m[f].alias(f) for f in fields])

    return shape
