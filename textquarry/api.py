"""The usual calls: extract from a DataFrame, and a table function for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .plans.extraction import ExtractionPlan, LongResult, extract, extract_long, extract_long_result
from .schema import EntitySpec, ExtractOptions, Schema, Session, schema_from_flags
from .scorers import lexical, rule, vector  # noqa: F401  registers the scorers
from .scorers.base import scorer
from .scorers.rule import PATTERNS, RuleScorer

__all__ = ["ExtractionPlan", "LongResult", "Schema", "Session", "extract", "extract_entities", "extract_long", "extract_long_result", "register_sql", "schema_from_flags", "scorer"]


def extract_entities(docs: DataFrame, labels: list[str], options: ExtractOptions | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``entities``, by the rule scorer."""
    from .operators import entities

    specs = [EntitySpec(x) for x in labels]
    spans = RuleScorer(id_col=id_col, text_col=text_col).spans(docs, labels)
    return entities.as_columns(docs, entities.extract_entities(spans, specs, options), specs, id_col)


@udtf(returnType="label string, start int, end int, score float, text string")
class ExtractSpans:
    """``extract_spans(text, labels)``: labels comma-separated; spans of the rule patterns. For ad-hoc SQL; DataFrames stay native."""

    def eval(self, text: str, labels: str):
        import re

        for label in (labels or "").split(","):
            for pattern in PATTERNS.get(label.strip(), []):
                for m in re.finditer(pattern, text or "", re.ASCII):
                    yield label.strip(), m.start(), m.end(), (24 + len(m.group()) * 7 % 40) / 64, m.group()


def register_sql(spark: SparkSession) -> None:
    """Makes ``SELECT ... FROM docs, LATERAL extract_spans(text, 'email')`` work."""
    spark.udtf.register("extract_spans", ExtractSpans)
