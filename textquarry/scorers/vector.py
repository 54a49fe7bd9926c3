"""Scores from dot products of a row's vector with a vector for each label."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import dot
from ..schema import Schema, SchemaError
from .base import register


@register("vector")
@dataclass
class VectorScorer:
    vectors: dict[str, list[float]] = field(default_factory=dict)
    id_col: str = "vec_id"
    vector_col: str = "embedding"

    def validate(self, schema: Schema) -> None:
        missing = [x for c in schema.classifications for x in c.labels if x not in self.vectors]
        if missing:
            raise SchemaError(f"no vector for {', '.join(missing)}")

    def spans(self, docs: DataFrame, labels: list[str]) -> DataFrame:
        raise SchemaError("the vector scorer scores labels, not spans")

    def labels(self, docs: DataFrame, task: str, labels: list[str]) -> DataFrame:
        """Here ``score`` is a logit."""
        each = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(i).alias("ix"), dot(F.col(self.vector_col), F.array(*[F.lit(float(v)) for v in self.vectors[x]])).alias("score")) for i, x in enumerate(labels)])
        rows = docs.select(F.col(self.id_col).alias("doc_id"), F.lit(task).alias("task"), F.explode(each).alias("x"))
        return rows.select("doc_id", "task", "x.label", "x.ix", "x.score")
