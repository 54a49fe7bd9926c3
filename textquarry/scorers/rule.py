"""Scores from patterns: native expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_spans
from ..schema import Schema, SchemaError, StructureMode, StructureSpec
from .base import RecordScores, register

# What each label looks like; written so that common regex dialects agree on them.
PATTERNS: dict[str, list[str]] = {
    "email": [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"],
    "ip_address": [r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"],
    "phone_number": [r"\+?[0-9][0-9() -]{6,}[0-9]"],
    "api_key": [r"AKIA[A-Z0-9]{16,}"],
    "password": [r"(?:password|secret|token)[=:][A-Za-z0-9+/_.=-]{6,}"],
    "name": [r"[A-Z][a-z]+", r"[A-Z][a-z]+ [a-z]+", r"[A-Z][a-z]+ [a-z]+ [a-z]+", r"[a-z]+[.] [A-Z][a-z]+"],
    "amount": [r"[0-9]+(?:[.,][0-9]+)?"],
    "url": [r"https?://[A-Za-z0-9./?=&#_-]+"],
}


#: Candidates of a structure in a document (a chunk of a long one), at most; and instances without anchors.
POOL, SLOTS = 64, 8


def rule_score(text):
    """A score in 64ths that depends on the surface's length alone: exact in any engine, with ties."""
    return ((F.lit(24) + F.pmod(F.length(text) * 7, F.lit(40))) / 64).cast("float")


@register("rule")
@dataclass
class RuleScorer:
    patterns: dict[str, list[str]] = field(default_factory=lambda: PATTERNS)
    id_col: str = "doc_id"
    text_col: str = "text"

    def validate(self, schema: Schema) -> None:
        wanted = [e.name for e in schema.visible_entities] + [f.name for s in schema.structures for f in s.fields if f.choices is None]
        missing = [x for x in dict.fromkeys(wanted) if x not in self.patterns]
        if missing:
            raise SchemaError(f"no pattern for {', '.join(missing)}")

    def spans(self, docs: DataFrame, labels: list[str]) -> DataFrame:
        """One pass over the texts for all labels; a text without any match gives no row."""
        text = F.coalesce(F.col(self.text_col), F.lit(""))
        found = [F.transform(match_spans(text, p), _labelled(label)) for label in labels for p in self.patterns[label]]
        # the outer form isn't given a filter on what it explodes, which would search every text twice
        rows = docs.select(F.col(self.id_col).alias("doc_id"), F.explode_outer(F.concat(*found)).alias("x")).where("x is not null")
        return rows.select("doc_id", "x.label", "x.start", "x.end", rule_score(F.col("x.text")).alias("score"), "x.text")

    def labels(self, docs: DataFrame, task: str, labels: list[str]) -> DataFrame:
        """The number of matches of each label's patterns, as a share: n / (n + 4)."""
        text = F.coalesce(F.col(self.text_col), F.lit(""))
        counts = [F.lit(0) + sum((F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) for p in self.patterns[label]), F.lit(0)) for label in labels]
        each = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(i).alias("ix"), c.alias("n")) for i, (label, c) in enumerate(zip(labels, counts, strict=True))])
        rows = docs.select(F.col(self.id_col).alias("doc_id"), F.lit(task).alias("task"), F.explode(each).alias("x"))
        return rows.select("doc_id", "task", "x.label", "x.ix", (F.col("x.n") / (F.col("x.n") + 4)).cast("float").alias("score"))


    def explicit(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """A logit in quarters, from the surface's length and the label's place in its group."""
        return pairs.withColumn("logit", ((F.length("text") * (F.col("ix") + 3)) % 17 - 8) / 4)

    def records(self, docs: DataFrame, spec: StructureSpec) -> RecordScores:
        """Candidates are what the fields' patterns match, at most ``POOL`` a document. One belongs to a record the more the nearer
        it stands to the record's own candidate; logits are whole eighths. No shuffle: all is made of a document's own array."""
        text = F.coalesce(F.col(self.text_col), F.lit(""))
        found = [F.transform(match_spans(text, p), _labelled(f.name)) for f in spec.fields for p in self.patterns.get(f.name, [])]
        none = F.array().cast("array<struct<label:string,start:int,end:int,text:string>>")
        rows = docs.select(F.col(self.id_col).alias("doc_id"), F.coalesce(F.concat(*found) if found else none, none).alias("found"), text.alias("_text"))
        place = F.transform("found", lambda x: F.struct((-rule_score(x["text"])).alias("n"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
        best = F.slice(F.array_sort(F.array_distinct(place)), 1, POOL)
        rows = rows.withColumn("pool", F.array_sort(F.transform(best, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))))
        each = rows.select("doc_id", "found", "pool", F.posexplode("pool").alias("cand", "c"))
        candidates = each.select("doc_id", "cand", "c.start", "c.end", "c.text")
        named = lambda f: F.exists("found", lambda x: (x["label"] == f) & (x["start"] == F.col("c.start")) & (x["end"] == F.col("c.end")))
        names = [f.name for f in spec.fields]
        fields = each.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(named(f), rule_score(F.col("c.text"))).otherwise(F.lit(0.0).cast("float")).alias("score")) for f in names])).alias("x"), "cand").select("doc_id", "x.field", "cand", "x.score")
        seed = (F.length("c.text") % 8 - 2) / 8
        anchor = spec.anchor_field
        objects = each.select("doc_id", F.lit(spec.name).alias("structure"), F.col("cand").alias("inst"), (F.when(named(anchor), seed).otherwise(-6.0) if anchor else seed).alias("logit"))
        if spec.mode is StructureMode.ANCHORLESS:
            objects = objects.where(F.col("inst") < SLOTS)
        gap = F.greatest(F.col("o.start") - F.col("c.end"), F.col("c.start") - F.col("o.end"), F.lit(0))
        cells = each.select("doc_id", "found", "cand", "c", F.posexplode("pool").alias("inst", "o"))
        own = F.array(*[F.struct(F.lit(f).alias("field"), F.when(named(f), (F.lit(16) - F.least(F.floor(gap / 8), F.lit(40))) / 8).otherwise(-6.0).cast("double").alias("logit")) for f in names])
        assign = cells.select("doc_id", "inst", F.explode(own).alias("x"), "cand").select("doc_id", F.lit(spec.name).alias("structure"), "inst", "x.field", "cand", "x.logit")
        absent = each.select("doc_id", F.lit(spec.name).alias("structure"), F.col("cand").alias("inst"), F.explode(F.array(*[F.lit(f) for f in names])).alias("field"), F.lit(-1).alias("cand"), F.lit(0.0).alias("logit"))
        asked = [(f.name, c, i) for f in spec.fields if f.choices for i, c in enumerate(dict.fromkeys(f.choices))]
        scored = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("choice"), F.lit(i).alias("ix"), rule_score(F.lit(c)).alias("score")) for f, c, i in asked])
        choices = docs.select(F.col(self.id_col).alias("doc_id"), F.explode(scored).alias("x")).select("doc_id", "x.*") if asked else None
        return RecordScores(candidates, fields, objects, assign.unionByName(absent), choices)


def _labelled(label: str):
    return lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))
