"""Connected components of a stored edge table, by alternating star contraction.

Large-star: each vertex's larger neighbours are linked to the least vertex around it.
Small-star: each vertex and its smaller neighbours are linked to the least of them. Both
keep the components; after a few rounds every vertex is linked to its component's least
vertex alone. A round aggregates minima (with partial sums before the shuffle) and joins
them back by plain equi-joins, which Spark splits where a vertex has very many edges.
Each round is a written table; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_path, new_path, release


def _state(edges: DataFrame) -> tuple:
    sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(sums)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, component) for every vertex with an edge to another one; component is the least id reachable.

    Loops and repeated edges are allowed; ids are of any ordered type, not null.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    now, path = written(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u != v").distinct())
    state = _state(now)
    while state[0]:
        last = path
        now, path = written(_small_star(_large_star(now)))
        before, state = state, _state(now)
        drop_path(spark, last)  # nothing reads it any more
        if state == before:
            break
    release(spark)
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
