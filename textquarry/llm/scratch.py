"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage (a lost executor loses none of it) and tells the
planner its true size, so that Spark itself decides whether a join may broadcast it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FOLDER = f"textquarry-{uuid.uuid4().hex[:12]}"
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where it is unset and all executors are threads of the driver, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='textquarry-')}"
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{_FOLDER}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df``, written once to the shared folder and read from there; a folder for each value of ``by``, its last column, if named."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes one folder, if it exists."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, what this thread has written by :func:`stored` inside the block."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            drop_path(spark, path)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what jobs that are over have left: plans, broadcasts and shuffle files are held until a collection of the
    driver's heap finds that nothing refers to them, and many small jobs would fill the heap before."""
    spark._jvm.System.gc()


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what :func:`stored` has written in this process; results read from it must be consumed before."""
    drop_path(spark, shared_dir(spark))
