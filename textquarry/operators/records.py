"""Structured records: instances seeded by anchor candidates, and fields assigned to them.

Rows are (doc_id, structure, inst, field, cand, logit), with cand -1 for "absent". Everything but the joint
assignment of exclusive single values is relational; that one is solved a (document, structure, field) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import at_least, sigmoid, softmax_over
from ..functions.text import matches
from ..schema import STR, Cardinality, ExtractOptions, FieldSpec, StructureMode, StructureSpec
from .choices import bind_to_anchors, choice_mentions, decide_choice, matched_choice, nearest_to_anchor
from .spans import resolve_overlaps

REC = ["doc_id", "structure"]
ABSENT = -1


@dataclass(frozen=True)
class RecordField:
    name: str
    cardinality: Cardinality = Cardinality.OPTIONAL_ONE
    exclusive: bool = False
    is_anchor: bool = False


def linear_sum_assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest assignment (rows <= columns), by shortest augmenting paths.

    Ties are broken by an offset of an ulp a cell, in reading order.
    """
    cost = np.asarray(cost, dtype=np.float64)
    rows, columns = cost.shape if cost.size else (len(cost), 0)
    if not rows:
        return np.zeros(0, dtype=np.int64)
    if rows > columns:
        raise ValueError("an assignment needs as many columns as rows")
    nudge = np.finfo(np.float64).eps * max(1.0, float(np.abs(cost).max()))
    cost = cost + nudge * np.arange(rows * columns).reshape(rows, columns)
    row_price, column_price = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for row in range(rows):
        reach, via, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, dtype=bool)
        at, free, dist = row, -1, 0.0
        last = -1
        while free < 0:
            step = dist + cost[at] - row_price[at] - column_price
            better = ~done & (step < reach)
            reach[better], via[better] = step[better], last
            open_ = np.where(done, np.inf, reach)
            last = int(open_.argmin())
            dist = float(open_[last])
            done[last] = True
            if owner[last] < 0:
                free = last
            else:
                at = int(owner[last])
        closed = done & (np.arange(columns) != free)
        for j in np.flatnonzero(closed):
            row_price[owner[j]] += dist - reach[j]
            column_price[j] -= dist - reach[j]
        row_price[row] += dist
        while free >= 0:
            before = int(via[free])
            owner[free] = owner[before] if before >= 0 else row
            free = before
    out = np.zeros(rows, dtype=np.int64)
    for j in np.flatnonzero(owner >= 0):
        out[owner[j]] = j
    return out


def assignment_costs(logits: np.ndarray, allows_absent: bool) -> np.ndarray:
    """Costs of one field's single values, in single precision as scores are: -ln of softmax shares, and a column of its own for each
    row's "absent". Another row's column is forbidden: it costs more than all rows together can. So does "absent" itself where a
    value is required, so that rows go without only if there are fewer candidates than rows."""
    logits = logits.astype(np.float32)
    shares = np.exp(logits - logits.max(axis=1, keepdims=True))
    shares /= shares.sum(axis=1, keepdims=True)
    cost = -np.log(np.maximum(shares, np.finfo(np.float32).eps)).astype(np.float64)
    rows = len(cost)
    dear = 1.0 + cost.max(axis=1).sum()
    absent = np.where(np.eye(rows, dtype=bool), cost[:, :1] if allows_absent else dear, dear * (rows + 1))
    return np.hstack([cost[:, 1:], absent])


def seeds(objects: DataFrame, threshold: float, temperature: float = 1.0) -> DataFrame:
    """(doc_id, structure, inst, score, place) of the candidates that become instances; ``objects`` has a ``logit`` for each."""
    scored = objects.withColumn("score", sigmoid(F.col("logit") / temperature)).where(at_least(F.col("score"), threshold))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*REC).orderBy(F.desc("score"), "inst"))).drop("logit")


def joint_scalars(assign: DataFrame, name: str, threshold: float, allows_absent: bool) -> DataFrame:
    """Exclusive single values: no candidate goes to two instances. A group is one document's field, bounded by its candidates."""

    columns = ["doc_id", "structure", "inst", "field", "cand", "score"]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for doc, structure, place, inst, cand, logit in part.itertuples(index=False):
                order, row = np.unique(np.asarray(place), return_inverse=True)
                cands, column = np.unique(np.append(ABSENT, cand), return_inverse=True)  # "absent" is the least number, so the first column
                if len(cands) < 2:
                    continue
                logits = np.full((len(order), len(cands)), -1e9)
                logits[row, column[1:]] = logit
                owner = np.zeros(len(order), dtype=np.int64)
                owner[row] = inst
                chosen = linear_sum_assignment(assignment_costs(logits, allows_absent))
                shares = np.exp(logits - logits.max(axis=1, keepdims=True))
                shares /= shares.sum(axis=1, keepdims=True)
                for r, c in enumerate(chosen.tolist()):
                    if c < len(cands) - 1 and not (allows_absent and shares[r, c + 1] < threshold):
                        rows.append((doc, structure, int(owner[r]), name, int(cands[c + 1]), float(shares[r, c + 1])))
            yield pd.DataFrame(rows, columns=columns)

    lists = [F.collect_list(c).alias(c) for c in ("place", "inst", "cand", "logit")]
    return assign.groupBy(*REC).agg(*lists).mapInPandas(solve, "doc_id long, structure string, inst int, field string, cand int, score double")


def owned_lists(assign: DataFrame, threshold: float) -> DataFrame:
    """Exclusive lists: each candidate goes to the instance with the highest sigmoid, the first of equals, if it reaches the threshold."""
    scored = assign.where(F.col("cand") != ABSENT).withColumn("score", sigmoid(F.col("logit")))
    best = scored.groupBy(*REC, "field", "cand").agg(F.min_by(F.struct("inst", "score"), F.struct(-F.col("logit"), F.col("place"))).alias("x"))
    return best.where(at_least(F.col("x.score"), threshold)).select(*REC, "x.inst", "field", "cand", "x.score")


def shared_lists(assign: DataFrame, threshold: float) -> DataFrame:
    """Lists: every candidate whose sigmoid reaches the threshold."""
    scored = assign.where(F.col("cand") != ABSENT).withColumn("score", sigmoid(F.col("logit")))
    return scored.where(at_least(F.col("score"), threshold)).select(*REC, "inst", "field", "cand", "score")


def own_scalars(assign: DataFrame, threshold: float, allows_absent: bool) -> DataFrame:
    """Single values: the largest softmax share; "absent" can win, and a share below the threshold is none, only if it is allowed."""
    scored = assign.withColumn("score", softmax_over(F.col("logit"), *REC, "inst", "field"))
    pool = scored if allows_absent else scored.where(F.col("cand") != ABSENT)
    rank = F.row_number().over(Window.partitionBy(*REC, "inst", "field").orderBy(F.desc("logit"), "cand"))
    best = pool.withColumn("_r", rank).where((F.col("_r") == 1) & (F.col("cand") != ABSENT))
    return (best.where(at_least(F.col("score"), threshold)) if allows_absent else best).select(*REC, "inst", "field", "cand", "score")


def decode_records(objects: DataFrame, assign: DataFrame, fields: list[RecordField], threshold: float = 0.5, temperature: float = 1.0) -> DataFrame:
    """Rows (doc_id, structure, inst, record_score, field, cand, score): the fields of each instance that has one.

    ``objects``: (doc_id, structure, inst, logit); ``assign``: (doc_id, structure, inst, field, cand, logit). With an anchor field
    (natural records) an instance is itself that field's candidate.
    """
    chosen = seeds(objects, threshold, temperature)
    cells = assign.withColumn("logit", F.col("logit") / temperature).join(chosen.select(*REC, "inst", "place"), [*REC, "inst"])
    parts = []
    for f in fields:
        own = cells.where(F.col("field") == f.name)
        if f.is_anchor:
            parts.append(chosen.select(*REC, "inst", F.lit(f.name).alias("field"), F.col("inst").alias("cand"), F.col("score").cast("double")))
        elif f.cardinality.is_scalar and f.exclusive:
            parts.append(joint_scalars(own, f.name, threshold, f.cardinality.allows_absent))
        elif f.cardinality.is_scalar:
            parts.append(own_scalars(own, threshold, f.cardinality.allows_absent))
        else:
            parts.append((owned_lists if f.exclusive else shared_lists)(own, threshold))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(chosen.select(*REC, "inst", F.col("score").alias("record_score")), [*REC, "inst"])


def without_repeated(records: DataFrame) -> DataFrame:
    """Latent and anchorless records: instances with the same candidates in every field are one, with the highest score, then the least number."""
    keyed = records.groupBy(*REC, "inst", "record_score").agg(F.sort_array(F.collect_list(F.struct("field", "cand"))).alias("key"))
    best = keyed.groupBy(*REC, "key").agg(F.min_by("inst", F.struct(-F.col("record_score"), F.col("inst"))).alias("inst"))
    return records.join(best.select(*REC, "inst"), [*REC, "inst"], "left_semi")


def in_anchor_order(records: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``record_ix``: instances by their anchor's span; ``spans``: (doc_id, cand, start, end)."""
    order = records.select(*REC, "inst").distinct().join(spans.select("doc_id", F.col("cand").alias("inst"), "start", "end"), ["doc_id", "inst"])
    numbered = order.withColumn("record_ix", F.row_number().over(Window.partitionBy(*REC).orderBy("start", "end", "inst")) - 1)
    return records.join(numbered.select(*REC, "inst", "record_ix"), [*REC, "inst"])


def record_fields(spec: StructureSpec) -> list[RecordField]:
    out = []
    for f in spec.fields:
        anchor = f.name == spec.anchor_field
        out.append(RecordField(f.name, f.cardinality_as(anchor), bool(f.exclusive), anchor))
    return out


def is_single(field: FieldSpec, anchor: bool) -> bool:
    return field.cardinality_as(anchor).is_scalar or field.dtype == STR


def field_mentions(decoded: DataFrame, candidates: DataFrame, fields: DataFrame, spec: StructureSpec, options: ExtractOptions) -> DataFrame:
    """Rows (doc_id, structure, inst, field, start, end, score, text): the candidates assigned to a record's fields that hold up as values.

    A value's score is the lesser of its probability as the field's candidate and of its assignment. An optional field drops what
    is no likely candidate; a field's own threshold is one on that score; then validators and overlaps within a record's field.
    """
    rows = decoded.join(candidates, ["doc_id", "cand"]).join(fields.withColumnRenamed("score", "_own"), ["doc_id", "field", "cand"], "left")
    own = F.coalesce(F.col("_own"), F.lit(0.0)).cast("float")
    rows = rows.withColumn("_own", own).withColumn("score", F.least(own, F.col("score").cast("float")))
    keep = F.lit(False)
    for f in spec.fields:
        ok = at_least(F.col("_own"), options.threshold) if f.cardinality_as(f.name == spec.anchor_field).allows_absent else F.lit(True)
        if f.threshold is not None:
            ok = ok & at_least(F.col("score"), f.threshold)
        for v in f.validators:
            ok = ok & matches(F.col("text"), v)
        keep = F.when(F.col("field") == f.name, ok).otherwise(keep)
    return resolve_overlaps(rows.where(keep), [*REC, "inst", "field"], options.policy)


def chosen_values(found: DataFrame, records: DataFrame, anchors: DataFrame | None, docs: DataFrame, scored: DataFrame, field: FieldSpec, anchor: bool, threshold: float) -> DataFrame:
    """Rows (doc_id, structure, inst, field, o, start, end, score, text) of a field with choices; ``o`` is the order of its values.

    A record with an anchor takes the literal mentions bound to it (a single value: the one nearest to the anchor), and nothing
    if its document mentions choices elsewhere alone. Without any literal mention, and without anchors, surfaces that equal a
    choice are taken; where there is none, the choices' own scores decide.

    ``found``: field_mentions; ``records``: (doc_id, structure, inst); ``anchors``: (doc_id, owner, a_start, a_end); ``scored``:
    (doc_id, choice, ix, score).
    """
    single, limit = is_single(field, anchor), threshold if field.threshold is None else field.threshold
    name, choices = F.lit(field.name).alias("field"), list(dict.fromkeys(field.choices or ()))
    nowhere = F.lit(None).cast("int")
    equal = found.where(F.col("field") == field.name).withColumn("text", matched_choice(F.col("text"), choices)).where("text is not null")
    if single:
        equal = equal.withColumn("_r", F.row_number().over(Window.partitionBy(*REC, "inst").orderBy(F.desc("score"), "start", "end"))).where("_r = 1")
    equal = equal.select(*REC, "inst", name, (-F.col("score")).cast("double").alias("o"), "start", "end", "score", "text")
    free = records
    literal = None
    if anchors is not None:
        mentions = choice_mentions(docs, choices)
        bound = bind_to_anchors(mentions, anchors)
        own = nearest_to_anchor(bound, anchors) if single else bound
        own = own.join(scored.select("doc_id", "choice", "score"), ["doc_id", "choice"])
        literal = own.join(records.withColumnRenamed("inst", "owner"), ["doc_id", "owner"]).select(*REC, F.col("owner").alias("inst"), name, F.col("start").cast("double").alias("o"), "start", "end", "score", F.col("choice").alias("text"))
        quiet = mentions.select("doc_id").distinct()
        free = records.join(quiet, "doc_id", "left_anti")
        equal = equal.join(quiet, "doc_id", "left_anti")
    unequal = free.join(equal.select(*REC, "inst").distinct(), [*REC, "inst"], "left_anti")
    guessed = decide_choice(unequal.join(scored, "doc_id"), [*REC, "inst"], single, limit)
    guessed = guessed.select(*REC, "inst", name, F.col("ix").cast("double").alias("o"), nowhere.alias("start"), nowhere.alias("end"), "score", F.col("choice").alias("text"))
    out = equal.unionByName(guessed)
    return out if literal is None else out.unionByName(literal)


def record_values(docs: DataFrame, scores, spec: StructureSpec, options: ExtractOptions) -> DataFrame:
    """(doc_id, structure, inst, record, score, first, last): a structure's records with at least one value; ``record`` is a struct of its
    fields, each a mention (text, confidence, start, end) or an array of them. Records with anchors stand in the order of (first, last),
    the anchor's span; the others by score, descending, then inst.

    ``docs``: (doc_id, text); ``scores``: a scorer's RecordScores of the structure.
    """
    decoded = decode_records(scores.objects, scores.assign, record_fields(spec), options.threshold, scores.temperature)
    if spec.anchor_field is None:
        decoded = without_repeated(decoded)
    known = decoded.groupBy(*REC, "inst").agg(F.max("record_score").alias("record_score"))
    anchored = spec.mode is not StructureMode.ANCHORLESS
    spans = scores.candidates.select("doc_id", F.col("cand").alias("inst"), F.col("start").alias("first"), F.col("end").alias("last"))
    known = known.join(spans, ["doc_id", "inst"], "left") if anchored else known.withColumn("first", F.lit(None).cast("int")).withColumn("last", F.lit(None).cast("int"))
    found = field_mentions(decoded, scores.candidates, scores.fields, spec, options)
    anchors = known.select("doc_id", F.col("inst").alias("owner"), F.col("first").alias("a_start"), F.col("last").alias("a_end")) if anchored else None
    plain = [f.name for f in spec.fields if f.choices is None]
    rows = found.where(F.col("field").isin(plain)).select(*REC, "inst", "field", (-F.col("score")).cast("double").alias("o"), "start", "end", "score", "text")
    if not options.include_spans:
        again = Window.partitionBy(*REC, "inst", "field", F.lower("text")).orderBy("o", "start", "end")
        rows = rows.withColumn("_r", F.row_number().over(again)).where("_r = 1").drop("_r")
    for f in spec.fields:
        if f.choices is not None:
            scored = scores.choices.where(F.col("field") == f.name).select("doc_id", "choice", "ix", "score")
            rows = rows.unionByName(chosen_values(found, known.select(*REC, "inst"), anchors, docs, scored, f, f.name == spec.anchor_field, options.threshold))
    item = F.struct("o", "start", "end", "text", F.col("score").cast("float").alias("score"))
    lists = rows.where("text != ''").groupBy(*REC, "inst").agg(*[F.sort_array(F.collect_list(F.when(F.col("field") == f.name, item))).alias(f"_{i}") for i, f in enumerate(spec.fields)])
    shape = lambda x: F.struct(x["text"].alias("text"), x["score"].alias("confidence"), x["start"].alias("start"), x["end"].alias("end"))
    values = [F.transform(f"_{i}", shape) for i in range(len(spec.fields))]
    record = F.struct(*[(F.get(v, F.lit(0)) if is_single(f, f.name == spec.anchor_field) else v).alias(f.name) for f, v in zip(spec.fields, values, strict=True)])
    return lists.select(*REC, "inst", record.alias("record")).join(known, [*REC, "inst"]).select(*REC, "inst", "record", F.col("record_score").alias("score"), "first", "last")


def record_list(values: DataFrame, anchored: bool) -> DataFrame:
    """(doc_id, records): a document's records in order."""
    order = ["first", "last", "inst"] if anchored else [(-F.col("score")).alias("n"), "inst"]
    lists = values.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), "record")), _by_order).alias("x"))
    return lists.select("doc_id", F.transform("x", lambda r: r["record"]).alias("records"))


def moved_record(record, spec: StructureSpec, by):
    """A record with its offsets moved, as from a chunk to its document."""
    shift = lambda m: F.when(m.isNotNull(), F.struct(m["text"].alias("text"), m["confidence"].alias("confidence"), (m["start"] + by).cast("int").alias("start"), (m["end"] + by).cast("int").alias("end")))
    single = {f.name: is_single(f, f.name == spec.anchor_field) for f in spec.fields}
    return F.struct(*[(shift(record[n]) if one else F.transform(record[n], shift)).alias(n) for n, one in single.items()])


def _by_order(a, b):
    return F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)


def legacy_structure(found: DataFrame, fields: list[tuple[str, bool]]) -> DataFrame:
    """One aggregate record a document, from entity rows (doc_id, label, start, end, score, text): for each (field, single) the best
    text or the texts by rank; documents without any value have none."""
    item = F.struct((-F.col("score")).alias("n"), "start", "end", "text")
    groups = found.where(F.col("label").isin([n for n, _ in fields])).groupBy("doc_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("label") == n, item)))["text"].alias(n) for n, _ in fields])
    return groups.select("doc_id", *[(F.get(F.col(n), F.lit(0)) if single else F.array_distinct(F.col(n))).alias(n) for n, single in fields])
