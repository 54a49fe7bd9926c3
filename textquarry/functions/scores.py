"""Scores: activations, rankings, sums over arrays and intervals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """array<double> -> array<double>, shifted by the largest."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def softmax_over(logit: Column, *keys: str) -> Column:
    """A row's share among the rows with its keys."""
    w = Window.partitionBy(*keys)
    raised = F.exp(logit - F.max(logit).over(w))
    return raised / F.sum(raised).over(w)


def tempered(logit: Column, temperature: float) -> Column:
    return logit / F.lit(float(temperature))


def activated(logits: Column, use_sigmoid: bool, temperature: float = 1.0) -> Column:
    scaled = F.transform(logits, lambda x: tempered(x, temperature))
    return F.transform(scaled, sigmoid) if use_sigmoid else softmax(scaled)


def at_least(score: Column, threshold: Column | float) -> Column:
    """An inclusive threshold in single precision, as scores are."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return score.cast("float") >= t.cast("float")


def first_argmax(values: Column) -> Column:
    """The index, from 0, of the first of the largest values."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def descending_order(values: Column) -> Column:
    """Indices from 0 by value, descending; of equal ones the first comes first."""
    keyed = F.array_sort(F.transform(values, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(keyed, lambda x: x["i"])


def top_k(items: Column, k: int) -> Column:
    """The first k of an array of structs by their fields."""
    return F.slice(F.array_sort(items), 1, k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def interval_mean(rows: DataFrame, keys: list[str], order: str, value: str, intervals: DataFrame) -> DataFrame:
    """Means of ``value`` over intervals [start, end) of positions: two look-ups in running sums each.

    ``order`` is a position from 0 without gaps within the keys; ``intervals`` has the keys, start and end.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(*keys, (F.col(order) + 1).alias("_at"), F.sum(value).over(upto).alias("_sum"))
    high = intervals.join(sums.withColumnsRenamed({"_at": "end", "_sum": "_high"}), [*keys, "end"])
    low = high.join(sums.withColumnsRenamed({"_at": "start", "_sum": "_low"}), [*keys, "start"], "left")
    return low.select(*keys, "start", "end", ((F.col("_high") - F.coalesce("_low", F.lit(0.0))) / (F.col("end") - F.col("start"))).alias("mean"))


def length_features(n: Column, total: Column) -> Column:
    return F.struct(F.log1p(n).alias("log_length"), (n / total).alias("share"), (1 / F.sqrt(n)).alias("inverse_root"))


def log_bucket(distance: Column, buckets: int, most: int) -> Column:
    """Signed distances, exact up to half the buckets and logarithmic beyond, up to ``most``."""
    middle = buckets // 2
    size = F.abs(distance)
    far = F.ceil(F.log(size / middle) / F.log(F.lit((most - 1) / middle)) * (middle - 1)) + middle
    return F.when(size <= middle, distance).otherwise(F.signum(distance) * far).cast("int")


def expected_level(probabilities: Column) -> Column:
    """Sum of k * p_k, k from 0."""
    return F.aggregate(F.transform(probabilities, lambda p, k: p * k), F.lit(0.0), lambda a, x: a + x)


def smoothed(values: Column, keep: float = 0.8) -> Column:
    """The last value of an exponential average; the first value starts it."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)).cast("double"), lambda a, x: a * keep + x * (1 - keep))
