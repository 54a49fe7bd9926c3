"""Scores from a checkpoint's network, an Arrow batch at a time; the model is opened once a worker process.

No checkpoint comes with this package; tests run it on small random weights, which shows that shapes, masks
and batches are right, and nothing about accuracy.
"""

from __future__ import annotations

import json
import pathlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.choices import choice_position
from ..schema import ClassificationSpec, Schema, SchemaError, StructureMode, StructureSpec, choice_prefix, prompt_groups
from . import network as N
from .base import RecordScores, register, written_once
from .weights import FILES, Checkpoint, open_checkpoint

# Separators of the input layout; words as in ``functions.text``, for Python.
SEP_GROUP, SEP_TEXT = "[SEP_STRUCT]", "[SEP_TEXT]"
WORD = r"(?i)(?:https?://[^\s]+|www\.[^\s]+)|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|@[a-z0-9_]+|[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*+|\S"
CHARACTER = r"[A-Za-z0-9@._\-+]+|\S"


@dataclass
class Prepared:
    """A text as input: ids, the place of each word's first id, of each group's prompt and of its fields' markers; word offsets."""

    ids: list[int]
    words: list[tuple[int, int]]
    word_at: list[int]
    prompt_at: list[int]
    fields_at: list[list[int]]
    prefix: int
    text: str


class Model:
    def __init__(self, checkpoint: Checkpoint, splitter: str = "whitespace") -> None:
        import regex
        from tokenizers import Tokenizer

        self.c, self.p = checkpoint, N.Parameters(checkpoint.tensors)
        self.tokenizer = Tokenizer.from_str(checkpoint.tokenizer) if checkpoint.tokenizer.lstrip().startswith("{") else Tokenizer.from_file(checkpoint.tokenizer)
        self.words = regex.compile(CHARACTER if splitter == "char" else WORD)

    def prepare(self, text: str, schema: Schema, max_words: int | None = None) -> Prepared:
        text = text or "."
        text = text if re.search(r"[.!?]\Z", text) else text + "."
        found = [(m.start(), m.end()) for m in self.words.finditer(text)][:max_words]
        groups, prefix = prompt_groups(schema), list(choice_prefix(schema))
        before: list[str] = []
        prompts, markers = [], []
        for i, g in enumerate(groups):
            before += [SEP_GROUP] if i else []
            prompts.append(len(before) + 1)
            markers.append([len(before) + 4 + 2 * k for k in range(len(g.fields))])
            before += g.tokens
        before.append(SEP_TEXT)
        pieces = self.tokenizer.encode_batch([*before, *prefix, *(text[a:b].lower() for a, b in found)], add_special_tokens=False)
        at = np.concatenate([[0], np.cumsum([len(x.ids) for x in pieces])]).astype(int)
        start = len(before)
        return Prepared([i for x in pieces for i in x.ids], found, at[start : len(pieces)].tolist(), [int(at[k]) for k in prompts], [[int(at[k]) for k in m] for m in markers], len(prefix), text)

    def _span(self, given: Prepared, span: tuple[int, int], length: int) -> tuple[int, int, str] | None:
        """Offsets and surface of a span of words, clipped to the text without its added mark; None for the prompt's words and blank ones."""
        a, b = span[0] - given.prefix, span[1] - given.prefix
        if a < 0 or b > len(given.words) or b <= a:
            return None
        start, end = given.words[a][0], min(given.words[b - 1][1], length)
        surface = given.text[start:end].strip()
        return (start, end, surface) if surface else None

    def span_scores(self, text: str, labels: list[str]) -> list[tuple[str, int, int, float, str]]:
        """Candidates of entity labels, with abstention applied."""
        schema = Schema().with_entities(*labels)
        given = self.prepare(text, schema)
        states = N.encode(self.c, given.ids)
        words, queries = states[given.word_at], states[given.fields_at[0]]
        if self.c.architecture == "boundary":
            cfg = self.c.config["boundary_head"]
            found = N.score_candidates(self.p.at("boundary_head"), cfg, words, queries)
            scores = N.sigmoid(found.logits / cfg["pair_temperature"])
            quiet = N.sigmoid(found.nulls) > cfg["abstention_threshold"] if found.nulls is not None else np.zeros(len(labels), dtype=bool)
            spans = found.spans
        else:
            if not N.count_class(self.p.at("count_pred"), states[given.prompt_at[0]]):
                return []
            spans, shown = N.span_states(self.p.at("span_rep"), words, self.c.config["max_width"])
            scores = N.sigmoid(N.counted_fields(self.p.at("count_embed"), queries) @ shown.T)
            quiet = np.zeros(len(labels), dtype=bool)
        out = []
        for q, label in enumerate(labels):
            for k, (a, b) in enumerate(spans.tolist()):
                place = None if quiet[q] else self._span(given, (a, b), len(text))
                if place:
                    out.append((label, place[0], place[1], float(scores[q, k]), place[2]))
        return out

    def _forward(self, text: str, schema: Schema) -> tuple[Prepared, np.ndarray, np.ndarray, N.Candidates, dict]:
        """(input, states of words, states of the first group's or the relations' fields, candidates, settings) under a boundary head."""
        if self.c.architecture != "boundary":
            raise SchemaError("attributes, relations and records need a boundary head")
        given = self.prepare(text, schema)
        states, cfg = N.encode(self.c, given.ids), self.c.config["boundary_head"]
        words, queries = states[given.word_at], states[[i for m in given.fields_at for i in m]]
        return given, words, queries, N.score_candidates(self.p.at("boundary_head"), cfg, words, queries), cfg

    def explicit_logits(self, text: str, pairs: list[tuple[int, int, str]]) -> list[float | None]:
        """Logits of (start, end, query) whatever the candidates are; None for offsets that hold no word."""
        labels = list(dict.fromkeys(q for _, _, q in pairs))
        given, words, queries, found, cfg = self._forward(text, Schema().with_entities(*labels))
        out: list[float | None] = []
        for start, end, query in pairs:
            inside = [i for i, (a, b) in enumerate(given.words) if a < end and b > start and a < len(text)]
            if not inside:
                out.append(None)
                continue
            span = np.array([[inside[0] + given.prefix, inside[-1] + 1 + given.prefix]])
            logit = N.score_spans(self.p.at("boundary_head"), cfg, found, words, queries, labels.index(query), span)[0]
            out.append(float(logit / cfg["pair_temperature"]))
        return out

    def relation_pairs(self, text: str, relations: list[str]) -> list[tuple]:
        """(relation, head start, end, text, tail start, end, text, score, place) of the proposed pairs, by place."""
        given, words, queries, found, cfg = self._forward(text, Schema().with_relations(*relations))
        if not len(found.spans):
            return []
        likely = N.sigmoid(found.logits)
        pairs = []
        for r in range(len(relations)):
            sides = []
            for q, most in ((2 * r, cfg["relation_heads_per_type"]), (2 * r + 1, cfg["relation_tails_per_type"])):
                order = np.argsort(-likely[q], kind="stable")[:most]
                sides.append([k for k in order.tolist() if likely[q][k] >= cfg["relation_argument_proposal_threshold"]])
            both = [(-likely[2 * r][h] * likely[2 * r + 1][t], i, j, h, t) for i, h in enumerate(sides[0]) for j, t in enumerate(sides[1]) if h != t]
            pairs += [(r, *found.spans[h], *found.spans[t]) for *_, h, t in sorted(both)[: cfg["relation_pair_cap"]]]
        if not pairs:
            return []
        states = np.stack([N.relation_states(queries[2 * r], queries[2 * r + 1], cfg["directional_relation_states"]) for r in range(len(relations))])
        logits = N.relation_logits(self.p.at("relation_scorer"), cfg, words, states, np.array(pairs))
        out = []
        for place, (pair, logit) in enumerate(zip(pairs, logits, strict=True), 1):
            head, tail = self._span(given, pair[1:3], len(text)), self._span(given, pair[3:5], len(text))
            if head and tail:
                out.append((relations[pair[0]], *head, *tail, float(N.sigmoid(logit / cfg["relation_temperature"])), place))
        return out

    def record_rows(self, text: str, spec: StructureSpec) -> list[tuple]:
        """(kind, inst, field, cand, start, end, text, value) of one structure: candidates, fields, objects, assign and choices."""
        given, words, queries, found, cfg = self._forward(text, Schema().with_structure(spec))
        names, rows = [f.name for f in spec.fields], []
        places = [self._span(given, x, len(text)) for x in found.spans.tolist()]
        for f, field in enumerate(spec.fields):
            for i, choice in enumerate(dict.fromkeys(field.choices or ())):
                at = choice_position(list(choice_prefix(Schema().with_structure(spec))), choice)
                if at is not None:
                    logit = N.score_spans(self.p.at("boundary_head"), cfg, found, words, queries, f, np.array([[at, at + 1]]))[0]
                    rows.append(("choice", i, field.name, -1, None, None, choice, float(N.sigmoid(logit / cfg["pair_temperature"]))))
        kept = [k for k, p in enumerate(places) if p]
        if not len(found.spans):
            return rows
        for k in kept:
            rows.append(("candidate", -1, "", k, *places[k], 0.0))
            rows += [("field", -1, n, k, None, None, None, float(N.sigmoid(found.logits[f, k] / cfg["pair_temperature"]))) for f, n in enumerate(names)]
        states = N.candidate_states(self.p.at("boundary_head"), found)
        head = N.RecordHead(self.p.at("record_decoder"), cfg["record_dim"])
        if spec.mode is StructureMode.ANCHORLESS:
            instances, objects = head.anchorless(states)
            numbers = range(len(instances))
        else:
            instances, numbers = states, kept
            objects = head.latent_seeds(states) if spec.mode is StructureMode.LATENT else found.logits[names.index(spec.anchor_field)]
        assign = head.assign(instances, states, queries)
        for i in numbers:
            rows.append(("object", i, "", -1, None, None, None, float(objects[i])))
            for f, n in enumerate(names):
                rows += [("assign", i, n, k, None, None, None, float(assign[f, i, k + 1])) for k in (-1, *kept)]
        return rows

    def label_logits(self, text: str, spec: ClassificationSpec) -> np.ndarray:
        given = self.prepare(text, Schema().with_classification(spec))
        states = N.encode(self.c, given.ids)[given.fields_at[0]]
        logits = N.class_logits(self.p.at("classifier"), states)
        return logits / self.c.config["boundary_head"]["classification_temperature"] if self.c.architecture == "boundary" else logits


_models: dict[tuple[str, str], Model] = {}


def model_of(path: str, splitter: str) -> Model:
    if (path, splitter) not in _models:
        _models[path, splitter] = Model(open_checkpoint(path), splitter)
    return _models[path, splitter]


@register("checkpoint")
@dataclass
class CheckpointScorer:
    """``path`` is a folder that every executor can read. Texts of a batch go through the network one by one, without padding."""

    path: str
    splitter: str = "whitespace"
    id_col: str = "doc_id"
    text_col: str = "text"
    specs: dict[str, ClassificationSpec] | None = None

    def validate(self, schema: Schema) -> None:
        schema.validate()
        if schema.attributes or schema.relations or schema.structures:
            config = json.loads((pathlib.Path(self.path) / FILES[0]).read_text(encoding="utf-8"))
            if "boundary_head" not in config:
                raise SchemaError("this model only supports entities and tasks")

    def _mapped(self, docs: DataFrame, rows, schema: str) -> DataFrame:
        path, splitter = self.path, self.splitter

        kind = docs.schema[self.id_col].dataType  # a document's id, or a chunk's (a struct, which goes through as JSON)

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = model_of(path, splitter)
            names = [c.split()[0] for c in schema.split(", ")]
            for part in parts:
                yield pd.DataFrame([(key, *x) for key, text in zip(part["doc_id"], part["text"], strict=True) for x in rows(model, text or "")], columns=names)

        key = F.to_json(self.id_col) if isinstance(kind, StructType) else F.col(self.id_col).cast("string")
        found = docs.select(key.alias("doc_id"), F.col(self.text_col).alias("text")).mapInPandas(score, schema.replace("doc_id long", "doc_id string"))
        return found.withColumn("doc_id", F.from_json("doc_id", kind) if isinstance(kind, StructType) else F.col("doc_id").cast(kind))

    def spans(self, docs: DataFrame, labels: list[str]) -> DataFrame:
        return self._mapped(docs, lambda model, text: model.span_scores(text, labels), "doc_id long, label string, start int, end int, score float, text string")

    def labels(self, docs: DataFrame, task: str, labels: list[str]) -> DataFrame:
        spec = (self.specs or {}).get(task) or ClassificationSpec(task, tuple(labels))

        def rows(model: Model, text: str) -> list[tuple]:
            logits = model.label_logits(text, spec)
            shown = N.sigmoid(logits) if spec.uses_sigmoid else N.softmax(logits)
            return [(task, x, i, float(p)) for i, (x, p) in enumerate(zip(labels, shown, strict=True))]

        return self._mapped(docs, rows, "doc_id long, task string, label string, ix int, score float")

    def explicit(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """``pairs`` with a logit; a text's pairs go through the network once."""
        path, splitter = self.path, self.splitter
        asked = F.collect_list(F.struct("start", "end", "query", "_n"))
        numbered = pairs.withColumn("_n", F.xxhash64("label", "start", "end", "attribute_group", "ix"))
        grouped = numbered.groupBy("doc_id").agg(asked.alias("asked")).join(docs.select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).alias("text")), "doc_id")
        kind = docs.schema[self.id_col].dataType

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = model_of(path, splitter)
            for part in parts:
                rows = []
                for key, text, asked in zip(part["key"], part["text"], part["asked"], strict=True):
                    found = model.explicit_logits(text or "", [(a["start"], a["end"], a["query"]) for a in asked])
                    rows += [(key, a["_n"], x) for a, x in zip(asked, found, strict=True) if x is not None]
                yield pd.DataFrame(rows, columns=["key", "_n", "logit"])

        as_json = isinstance(kind, StructType)
        key = F.to_json("doc_id") if as_json else F.col("doc_id")
        back = F.from_json("key", kind) if as_json else F.col("key").cast(kind)
        found = grouped.select(key.cast("string").alias("key"), "text", "asked").mapInPandas(score, "key string, _n long, logit double")
        return numbered.join(found.select(back.alias("doc_id"), "_n", "logit"), ["doc_id", "_n"]).drop("_n")

    def pairs(self, docs: DataFrame, relations: list[str]) -> DataFrame:
        """Scored pairs of relations, as ``operators.relations.propose_pairs`` gives them."""
        schema = "doc_id long, relation string, h_start int, h_end int, h_text string, t_start int, t_end int, t_text string, score float, place int"
        return self._mapped(docs, lambda model, text: model.relation_pairs(text, relations), schema)

    def records(self, docs: DataFrame, spec: StructureSpec) -> RecordScores:
        schema = "doc_id long, kind string, inst int, field string, cand int, start int, end int, text string, value double"
        rows = written_once(self._mapped(docs, lambda model, text: model.record_rows(text, spec), schema))
        of = lambda kind, *columns: rows.where(F.col("kind") == kind).select("doc_id", *columns)
        structure, logit = F.lit(spec.name).alias("structure"), F.col("value").alias("logit")
        choices = of("choice", "field", F.col("text").alias("choice"), F.col("inst").alias("ix"), F.col("value").cast("float").alias("score"))
        temperature = json.loads((pathlib.Path(self.path) / FILES[0]).read_text(encoding="utf-8"))["boundary_head"]["record_temperature"]
        return RecordScores(
            of("candidate", "cand", "start", "end", "text"), of("field", "field", "cand", F.col("value").cast("float").alias("score")),
            of("object", structure, "inst", logit), of("assign", structure, "inst", "field", "cand", logit), choices, temperature,
        )
