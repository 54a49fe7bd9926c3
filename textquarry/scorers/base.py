"""The boundary between scoring and decoding: a scorer turns documents into rows of scores.

Rows are (doc_id, task, kind, start, end, start2, end2, score, text, text2); ``kind`` is one of span, pair, label,
null, count. Decoders read them by kind and never call a scorer, so one pass serves all tasks of a schema. A
scorer that runs Python and whose rows several decoders read should be stored or persisted once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from ..schema import Schema, SchemaError, StructureSpec

SPAN, PAIR, LABEL, NULL, COUNT = "span", "pair", "label", "null", "count"
SCORE_ROWS = "doc_id long, task string, kind string, start int, end int, start2 int, end2 int, score float, text string, text2 string"


@dataclass(frozen=True)
class RecordScores:
    """What a scorer says about one structure: candidates of its fields, and how likely each belongs to which instance."""

    #: (doc_id, cand, start, end, text); cand is numbered from 0 in each document
    candidates: DataFrame
    #: (doc_id, field, cand, score): how likely a candidate is a value of the field, in any record
    fields: DataFrame
    #: (doc_id, structure, inst, logit); an instance is a candidate, unless the structure is anchorless
    objects: DataFrame
    #: (doc_id, structure, inst, field, cand, logit), with cand -1 for "absent"
    assign: DataFrame
    #: (doc_id, field, choice, ix, score) of every choice of the fields that have choices, or None
    choices: DataFrame | None = None
    temperature: float = 1.0


class Scorer(Protocol):
    def validate(self, schema: Schema) -> None:
        """Raises SchemaError for what this scorer can't score."""

    def spans(self, docs: DataFrame, labels: list[str]) -> DataFrame:
        """(doc_id, label, start, end, score, text) of candidate spans."""

    def labels(self, docs: DataFrame, task: str, labels: list[str]) -> DataFrame:
        """(doc_id, task, label, ix, score) of every label of a task."""

    def explicit(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """``pairs`` (doc_id, start, end, text, query, ix, ...) with a ``logit`` added: given spans against given labels."""

    def records(self, docs: DataFrame, spec: StructureSpec) -> RecordScores:
        """Scores of a structure's records."""


def written_once(rows: DataFrame) -> DataFrame:
    """``rows``, so that several readers don't compute them again: written to the shared folder that ``spark.checkpoint.dir`` names (a
    job of its own; nothing is lost with an executor), or kept by Spark where none is set."""
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return rows.persist()
    path = f"{folder.rstrip('/')}/textquarry-rows/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


REGISTRY: dict[str, type] = {}


def register(name: str):
    """Names a scorer, so that a request can ask for it."""

    def keep(kind: type) -> type:
        REGISTRY[name] = kind
        return kind

    return keep


def scorer(name: str, **options) -> Scorer:
    if name not in REGISTRY:
        raise SchemaError(f"unknown scorer {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)
