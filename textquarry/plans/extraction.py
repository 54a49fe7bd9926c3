"""Plan-time preparation of a request, and the extraction it stands for."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attributes, classify, entities, longdoc, records, relations
from ..schema import STR, ChunkOptions, EntitySpec, ExtractOptions, Schema, SchemaError, StructureMode, choice_prefix, prompt_groups
from ..scorers.base import Scorer, written_once


@dataclass(frozen=True)
class ExtractionPlan:
    """What is derived from a schema once, on the driver: prompts, queries, and the labels each scorer pass must cover."""

    schema: Schema
    options: ExtractOptions = field(default_factory=ExtractOptions)

    def __post_init__(self) -> None:
        self.schema.validate()

    @property
    def prompt_words(self) -> tuple[str, ...]:
        """All words before the text: the groups' tokens, then the choices of fields."""
        return tuple(w for g in prompt_groups(self.schema) for w in g.tokens) + choice_prefix(self.schema)

    @property
    def queries(self) -> list[tuple[str, str, str]]:
        """(kind, group, field) of every query slot, numbered by position."""
        return [(g.kind, g.name, f) for g in prompt_groups(self.schema) for f in g.fields]

    @property
    def span_labels(self) -> list[str]:
        """Labels whose spans are needed: entities, roles of relations, and fields of structures; one pass scores them all."""
        out = [e.name for e in self.schema.entities] + [f.name for s in self.schema.structures for f in s.fields]
        return list(dict.fromkeys(out))

    def describe(self) -> str:
        return json.dumps(asdict(self.schema), default=str, sort_keys=True)


def _check(schema: Schema, *scorers) -> None:
    schema.validate()
    for s in scorers:
        if s is not None and hasattr(s, "validate"):
            s.validate(schema)


def _relation_threshold(schema: Schema, o: ExtractOptions) -> Column:
    limit = F.lit(float(o.threshold))
    for r in schema.relations:
        if r.threshold is not None:
            limit = F.when(F.col("relation") == r.name, F.lit(float(r.threshold))).otherwise(limit)
    return limit


def _roles_table(docs: DataFrame, schema: Schema, roles: dict[str, tuple[str, str]] | None) -> DataFrame:
    missing = [r.name for r in schema.relations if r.name not in (roles or {})]
    if missing:
        raise SchemaError(f"no roles for {', '.join(missing)}")
    rows = [(r.name, role, label) for r in schema.relations for role, label in zip(("head", "tail"), roles[r.name], strict=True)]
    return docs.sparkSession.createDataFrame(rows, "relation string, role string, label string")


def extract(docs: DataFrame, schema: Schema, span_scorer: Scorer, label_scorer: Scorer | None = None, options: ExtractOptions | None = None, roles: dict[str, tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: a column for each structure, ``entities``, a column for each task, ``relation_extraction``.

    ``roles`` names, for each relation, the labels that its head and tail are taken from; a scorer that scores pairs itself needs
    none. A structure is an array of records, or one
    aggregate record in the legacy mode. Where several decoders read spans, the scorer runs once: its rows are written before they
    are decoded (see ``written_once``). Both scorers' ``validate`` is asked before any job starts.
    """
    plan = ExtractionPlan(schema, options or ExtractOptions())
    o = plan.options
    if schema.classifications and label_scorer is None:
        raise SchemaError("tasks need a scorer of labels")
    _check(schema, span_scorer if schema.entities or schema.structures or schema.relations else None)
    own_pairs = bool(schema.relations) and roles is None and hasattr(span_scorer, "pairs")
    table = _roles_table(docs, schema, roles) if schema.relations and not own_pairs else None
    source = docs if o.max_words is None else docs.withColumn(text_col, T.first_words(F.col(text_col), o.max_words))
    keyed = source.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.select(id_col)
    shown, legacy = list(schema.visible_entities), [s for s in schema.structures if s.mode is StructureMode.LEGACY]
    labels = [e.name for e in shown] + [f.name for s in legacy for f in s.fields] + [x for r in schema.relations if table is not None for x in roles[r.name]]
    spans = span_scorer.spans(keyed, list(dict.fromkeys(labels))) if labels else None
    if spans is not None and len(legacy) + bool(shown) + 2 * (table is not None) > 1:
        spans = written_once(spans)
    for s in schema.structures:
        if s.mode is StructureMode.LEGACY:
            specs = [EntitySpec(f.name, f.description, f.threshold, f.dtype, f.validators) for f in s.fields]
            value = records.legacy_structure(entities.extract_entities(spans, specs, o), [(f.name, f.dtype == STR) for f in s.fields])
            value = value.select("doc_id", F.struct(*[f.name for f in s.fields]).alias(s.name))
        else:
            values = records.record_values(keyed, span_scorer.records(keyed, s), s, o)
            value = records.record_list(values, s.mode is not StructureMode.ANCHORLESS and s.anchor_field is not None).withColumnRenamed("records", s.name)
        out = _attached(out, value.withColumnRenamed("doc_id", id_col), id_col)
        if s.mode is not StructureMode.LEGACY:
            out = out.withColumn(s.name, F.coalesce(F.col(s.name), F.array()))
    if shown:
        found, groups = entities.extract_entities(spans, shown, o), dict(schema.attributes)
        if groups:
            found = attributes.attached(found, attributes.scored_attributes(keyed, found, groups, span_scorer), groups)
        out = entities.as_columns(out, found, shown, id_col)
    for task in schema.classifications:
        rows = classify.decide(label_scorer.labels(keyed, task.task, list(task.labels)), task.multi_label, task.threshold)
        value = classify.as_result(rows, task.multi_label)
        fields = ["labels", "confidences"] if task.multi_label else ["label", "confidence"]
        out = _attached(out, value.select(F.col("doc_id").alias(id_col), F.struct(*fields).alias(task.task)), id_col)
    if schema.relations:
        pairs = span_scorer.pairs(keyed, [r.name for r in schema.relations]) if own_pairs else relations.propose_pairs(spans, table, threshold=o.threshold)
        edges = relations.relation_edges(pairs, _relation_threshold(schema, o))
        lists = relations.edge_list(edges).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("relation", "edges"))).alias("relation_extraction"))
        out = _attached(out, lists.withColumnRenamed("doc_id", id_col), id_col)
    return out


def _attached(out: DataFrame, value: DataFrame, id_col: str) -> DataFrame:
    return out.join(value, id_col, "left")


@dataclass(frozen=True)
class LongResult:
    """What is found in long documents; None for kinds that weren't asked for."""

    #: (doc_id, label, start, end, score, text)
    entities: DataFrame | None = None
    #: (doc_id, task, label, score)
    decisions: DataFrame | None = None
    #: (doc_id, label, start, end, attribute_group, attribute, score) of the entities
    attributes: DataFrame | None = None
    #: (doc_id, relation, h_start, h_end, t_start, t_end, h_text, t_text, score)
    relations: DataFrame | None = None
    #: of each structure (doc_id, structure, record, score, first): its records, in the order of ``first``, their first chunk and place
    structures: dict[str, DataFrame] = field(default_factory=dict)


def extract_long_result(docs: DataFrame, schema: Schema, span_scorer: Scorer, label_scorer: Scorer | None = None, options: ExtractOptions | None = None, chunk: ChunkOptions | None = None, roles: dict[str, tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> LongResult:
    """All kinds of results of long documents: chunks are rows and are scored independently, no relation or record is formed across
    them, and what they yield is put back in place and merged by document. The merge is the only shuffle of results."""
    _check(schema, span_scorer if schema.entities or schema.structures or schema.relations else None)
    o = options or ExtractOptions()
    within = ExtractOptions(o.threshold, True, True, o.overlap)
    table = _roles_table(docs, schema, roles) if schema.relations else None
    parts = T.chunks(docs, chunk, id_col, text_col).withColumn("key", F.struct(F.col("id").alias("doc_id"), "chunk_ix", F.col("start").alias("chunk_start"))).select(F.col("key").alias("doc_id"), "text")
    found = decisions = marked = edges = None
    shown, legacy = list(schema.visible_entities), [s for s in schema.structures if s.mode is StructureMode.LEGACY]
    labels = [e.name for e in shown] + [f.name for s in legacy for f in s.fields] + [x for r in schema.relations for x in roles[r.name]]
    spans = span_scorer.spans(parts, list(dict.fromkeys(labels))) if labels else None
    if spans is not None and len(legacy) + bool(shown) + 2 * bool(schema.relations) > 1:
        spans = written_once(spans)
    if shown:
        kept = entities.extract_entities(spans, shown, within)
        placed = longdoc.remapped(kept.select("doc_id.*", "label", "start", "end", "score", "text"))
        found = longdoc.merge_spans(placed, entities.KEYS, o.policy, [e.name for e in shown if e.dtype == STR])
        groups = dict(schema.attributes)
        if groups:
            rows = attributes.scored_attributes(parts, kept, groups, span_scorer)
            rows = longdoc.remapped(rows.select("doc_id.*", *[c for c in rows.columns if c != "doc_id"]))
            marked = longdoc.merge_attributes(rows).join(found.select("doc_id", "label", "start", "end"), ["doc_id", "label", "start", "end"], "left_semi")
    for task in schema.classifications:
        rows = classify.decide(label_scorer.labels(parts, task.task, list(task.labels)), task.multi_label, task.threshold).select("doc_id.*", "task", "label", "score")
        merged = longdoc.merge_multi_label(rows) if task.multi_label else longdoc.merge_single_label(rows)
        decisions = merged if decisions is None else decisions.unionByName(merged)
    if table is not None:
        pairs = relations.relation_edges(relations.propose_pairs(spans, table, threshold=o.threshold), _relation_threshold(schema, o))
        moved = pairs.select("doc_id.*", "relation", *[(F.col(c) + F.col("doc_id.chunk_start")).cast("int").alias(c) for c in ("h_start", "h_end", "t_start", "t_end")], "h_text", "t_text", "score")
        edges = longdoc.merge_relations(moved)
    structures = {}
    for s in schema.structures:
        if s.mode is StructureMode.LEGACY:
            specs = [EntitySpec(f.name, f.description, f.threshold, f.dtype, f.validators) for f in s.fields]
            rows = records.legacy_structure(entities.extract_entities(spans, specs, within), [(f.name, f.dtype == STR) for f in s.fields])
            rows = rows.select("doc_id", F.lit(s.name).alias("structure"), F.struct(*[f.name for f in s.fields]).alias("record"), F.lit(0.0).alias("score"), F.lit(0).alias("place"))
        else:
            order = Window.partitionBy("doc_id").orderBy(*(["first", "last", "inst"] if s.mode is not StructureMode.ANCHORLESS and s.anchor_field else [F.desc("score"), "inst"]))
            rows = records.record_values(parts, span_scorer.records(parts, s), s, within).withColumn("place", F.row_number().over(order))
            rows = rows.withColumn("record", records.moved_record(F.col("record"), s, F.col("doc_id.chunk_start")))
        structures[s.name] = longdoc.merge_records(rows.select("doc_id.*", "structure", "record", "score", "place"))
    return LongResult(found, decisions, marked, edges, structures)


def extract_long(docs: DataFrame, schema: Schema, span_scorer: Scorer, label_scorer: Scorer | None = None, options: ExtractOptions | None = None, chunk: ChunkOptions | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(entities, decisions) of :func:`extract_long_result`."""
    out = extract_long_result(docs, schema, span_scorer, label_scorer, options, chunk, None, id_col, text_col)
    return out.entities, out.decisions
