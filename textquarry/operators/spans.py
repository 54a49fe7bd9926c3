"""Resolving overlaps among scored spans: rows (keys..., start, end, score, text).

Overlap policies only look at spans that overlap, directly or through others, so a key's spans are
first cut into such components by one window over (start, end); each component is then resolved by one
higher-order expression. A document with very many spans thus costs no more than its densest component.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..schema import OverlapPolicy


def best_of_exact(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each (keys, start, end): that of the highest score, then of the least text."""
    return spans.groupBy(*keys, "start", "end").agg(F.max("score").alias("score"), F.min_by("text", F.struct(-F.col("score"), F.col("text"))).alias("text"))


def with_component(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``component``: a running number of groups of spans that overlap one another, directly or not."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    marked = spans.withColumn("_new", new)
    return marked.withColumn("component", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def _ranked(items: Column) -> Column:
    """By score descending, start, end."""
    return F.array_sort(F.transform(items, lambda x: F.struct((-x["score"]).alias("n"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), x["text"].alias("text"))))


def _greedy(items: Column, clashes) -> Column:
    ranked = _ranked(items)
    return F.aggregate(ranked, F.filter(ranked, lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, lambda y: clashes(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def _overlap(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def _contains(x: Column, y: Column) -> Column:
    return (x["start"] <= y["start"]) & (x["end"] >= y["end"])


def disjoint_greedy(items: Column) -> Column:
    """By rank, each span that overlaps none kept before."""
    return _greedy(items, _overlap)


def nested(items: Column) -> Column:
    """By rank, each span that crosses none kept before; one inside another is no crossing."""
    return _greedy(items, lambda x, y: _overlap(x, y) & ~_contains(x, y) & ~_contains(y, x))


def heaviest_disjoint(items: Column) -> Column:
    """The disjoint subset with the highest total score, then the most spans, then the least sorted rank keys.

    Best subsets of the first k spans by end, for each k: the k-th span is added to the best subset of
    those that end before it, or left out; totals and counts are kept negative, so the least of both is the better.
    """
    by_end = F.array_sort(F.transform(items, lambda x: F.struct(x["end"].alias("end"), x["start"].alias("start"), x["score"].cast("double").alias("score"))))
    key = "array<struct<n:double,start:int,end:int>>"
    empty = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("count"), F.array().cast(key).alias("keys"))

    def step(best: Column, x: Column) -> Column:
        before = F.get(best, F.size(F.filter(F.slice(by_end, 1, F.size(best) - 1), lambda y: y["end"] <= x["start"])))
        own = F.array(F.struct((-x["score"]).alias("n"), x["start"].alias("start"), x["end"].alias("end"))).cast(key)
        taken = F.struct((before["total"] - x["score"]).alias("total"), (before["count"] - 1).alias("count"), F.array_sort(F.concat(before["keys"], own)).alias("keys"))
        return F.concat(best, F.array(F.least(taken, F.get(best, F.size(best) - 1))))

    chosen = F.aggregate(by_end, F.array(empty), step, lambda best: F.element_at(best, -1)["keys"])
    return F.filter(_ranked(items), lambda x: F.exists(chosen, lambda k: (k["start"] == x["start"]) & (k["end"] == x["end"])))


#: Components of more spans are resolved by ``_heaviest_batches``: the expression's work grows with the cube of their number.
FEW = 2


def heaviest_choice(starts: list[int], ends: list[int], scores: list[float]) -> list[int]:
    """Which of some distinct spans ``heaviest_disjoint`` keeps."""
    order = sorted(range(len(starts)), key=lambda i: (ends[i], starts[i]))
    by_end = [ends[i] for i in order]
    total, count, last = [0.0], [0], [-1]  # of the first k spans: the best subset's total and count, kept negative, and its last span

    def chosen(k: int) -> list[int]:
        out = []
        while k:
            if last[k] == k - 1:
                out.append(order[k - 1])
                k = before[k - 1]
            else:
                k -= 1
        return out

    def keys(picked: list[int]) -> list[tuple]:
        return sorted((-scores[i], starts[i], ends[i]) for i in picked)

    before: list[int] = []
    for k, i in enumerate(order):
        p = bisect_right(by_end, starts[i], 0, k)
        before.append(p)
        taken, left = (total[p] - scores[i], count[p] - 1), (total[k], count[k])
        take = taken < left or (taken == left and keys([*chosen(p), i]) < keys(chosen(k)))
        total.append(taken[0] if take else left[0])
        count.append(taken[1] if take else left[1])
        last.append(k if take else -1)
    return chosen(len(order))


def _heaviest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``kept``, the places in ``items`` that stay. The work is n log n in a component, but for ties."""
    for batch in batches:
        items = batch.column(batch.schema.get_field_index("items"))
        flat, kept = items.flatten(), []
        starts, ends, scores = (flat.field(i).to_pylist() for i in range(3))
        at = 0
        for n in (items.value_lengths()).to_pylist():
            kept.append(sorted(heaviest_choice(starts[at : at + n], ends[at : at + n], scores[at : at + n])))
            at += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.list_(pa.int32()))], [*batch.schema.names, "kept"])


_RESOLVERS = {OverlapPolicy.NESTED: nested, OverlapPolicy.FLAT: heaviest_disjoint}


def resolve_overlaps(spans: DataFrame, keys: list[str], policy: OverlapPolicy | str = OverlapPolicy.FLAT, greedy: bool = False) -> DataFrame:
    """The spans that a policy keeps: rows (keys..., start, end, score, text). ``greedy`` is disjoint suppression by score."""
    policy = OverlapPolicy.parse(policy) if not isinstance(policy, OverlapPolicy) else policy
    distinct = best_of_exact(spans, keys)
    if policy is OverlapPolicy.ALLOW and not greedy:
        return distinct
    if policy is OverlapPolicy.LONGEST and not greedy:
        return longest(distinct, keys)
    items = with_component(distinct, keys).groupBy(*keys, "component").agg(F.collect_list(F.struct("start", "end", "score", "text")).alias("items"))
    resolver = disjoint_greedy if greedy else _RESOLVERS[policy]
    small = items
    if resolver is heaviest_disjoint:
        small = items.where(F.size("items") <= FEW)
        large = items.where(F.size("items") > FEW)
        large = large.mapInArrow(_heaviest_batches, items.schema.add("kept", ArrayType(IntegerType())))
        large = large.select(*keys, F.explode(F.transform("kept", lambda i: F.get("items", i))).alias("x"))
    kept = small.select(*keys, F.explode(F.when(F.size("items") == 1, _ranked(F.col("items"))).otherwise(resolver(F.col("items")))).alias("x"))
    out = kept.select(*keys, "x.start", "x.end", "x.score", "x.text")
    return out.unionByName(large.select(*keys, "x.start", "x.end", "x.score", "x.text")) if small is not items else out


def longest(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """All distinct spans but those that lie within a longer one: by start, the longest first, a span lies within one before it if
    that reaches as far."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return distinct.withColumn("_reach", reach).where("_reach is null or _reach < end").drop("_reach")


def longest_by_join(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``longest`` as an anti-join on containment, within the keys and a component of overlaps, which bounds the pairs compared."""
    distinct = with_component(best_of_exact(spans, keys), keys)
    on = [*keys, "component"]
    wide = distinct.select(*[F.col(k).alias(f"_{k}") for k in on], F.col("start").alias("_start"), F.col("end").alias("_end"))
    condition = (F.col("_start") <= F.col("start")) & (F.col("_end") >= F.col("end")) & (F.col("_end") - F.col("_start") > F.col("end") - F.col("start"))
    for k in on:
        condition = F.col(k).eqNullSafe(F.col(f"_{k}")) & condition
    return distinct.join(wide, condition, "left_anti").drop("component")


def ranked(spans: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """Adds the rank by score descending, start, end, text; from 1."""
    return spans.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "start", "end", "text")))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (array<struct<start,end,label>>) as ``[LABEL]``; by start, then in the array's order, those that overlap one before or lie outside are left."""
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["label"].alias("label"))))

    def add(state: Column, s: Column) -> Column:
        fits = (s["start"] >= state["at"]) & (s["end"] <= F.length(text)) & (s["start"] < s["end"])
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["label"]), F.lit("]"))
        return F.struct(F.when(fits, s["end"]).otherwise(state["at"]).cast("int").alias("at"), F.when(fits, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(ordered, start, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))


def highlight_segments(text: Column, spans: Column) -> Column:
    """array<struct<text,label>> of plain (label null) and marked pieces, by the rules of ``redacted``."""
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["label"].alias("label"))))
    kind = "array<struct<text:string,label:string>>"

    def piece(t: Column, label: Column) -> Column:
        return F.filter(F.array(F.struct(t.alias("text"), label.cast("string").alias("label"))).cast(kind), lambda x: x["text"] != "")

    def add(state: Column, s: Column) -> Column:
        fits = (s["start"] >= state["at"]) & (s["end"] <= F.length(text)) & (s["start"] < s["end"])
        more = F.concat(state["out"], piece(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(None)), piece(F.substring(text, s["start"] + 1, s["end"] - s["start"]), s["label"]))
        return F.struct(F.when(fits, s["end"]).otherwise(state["at"]).cast("int").alias("at"), F.when(fits, more).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(ordered, start, add, lambda s: F.concat(s["out"], piece(F.substring(text, s["at"] + 1, F.length(text)), F.lit(None))))
