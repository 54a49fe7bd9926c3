"""Exact ranks of all rows without one task ever holding a whole group.

Rows of a group are cut into ``buckets`` by a number in [0, buckets) that rises with
the sort key; bucket sizes are summed up first, then each bucket is ranked on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_offsets(rows: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """(group, bucket, before, total): how many rows of the group stand in lower buckets, and its size.

    The window sees one row a bucket, so its largest partition has as many rows as there are buckets.
    """
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    upto = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*group, bucket, (F.sum("_n").over(upto) - F.col("_n")).alias("before"), F.sum("_n").over(whole).alias("total"))


def ranked(rows: DataFrame, group: list[str], bucket: str, order: list[Column | str], rank: str, total: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 0 within the group, by bucket, then ``order``) and, if named, the group's size as ``total``.

    ``rows`` is read twice: pass a stored table. Group and bucket columns must not be null.
    """
    offsets = bucket_offsets(rows, group, bucket)
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    out = rows.join(offsets, [*group, bucket]).withColumn(rank, F.col("before") + F.row_number().over(within) - 1)
    return (out.withColumnRenamed("total", total) if total else out.drop("total")).drop("before")
