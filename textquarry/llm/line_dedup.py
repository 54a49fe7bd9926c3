"""Line dedup by site-relative frequency.

A line is boilerplate of a host if it stands on more than ``max_ratio`` of the host's
pages, and on ``min_pages`` of them at least; on a host with fewer than twice as many pages
half of them are enough, but never a single one. Lines are compared without surrounding white
space; blank lines never count and always stay.

Two passes over the pages: (1) distinct line hashes of each page are counted per host, with
partial sums before the shuffle, so neither a host with most of the pages nor a line on all
of them meets in one task; texts aren't shuffled; (2) each host's list of boilerplate hashes
is joined to its pages. A host has fewer than ``lines of a page / max_ratio`` such
lines on average; the lists are a stored table, so Spark broadcasts them only if their
size is below its threshold, and else splits the pages of a hot host between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored, unused_name

MAX_RATIO = 0.05
MIN_PAGES = 5
FEW_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    """128 bits, so that equal hashes mean equal lines at any size of corpus; null for blank lines."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def boilerplate_lines(docs: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, pages, host_pages) of every boilerplate line; ``host`` is a non-null column of ``docs``."""
    pages = docs.select(host.alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    hashes = F.filter(F.array_distinct(F.transform(_lines(F.coalesce("text", F.lit(""))), _hash)), lambda h: h.isNotNull())
    counts = pages.select("host", F.explode(hashes).alias("line_hash")).groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("pages"))
    # what few pages hold goes before the join; a host's total is one row
    few = min(FEW_PAGES, min_pages)
    least = F.greatest(F.lit(few), F.least(F.lit(min_pages), F.ceil(F.col("host_pages") / 2)))
    return counts.where(F.col("pages") >= few).join(totals, "host").where((F.col("pages") >= least) & (F.col("pages") > F.col("host_pages") * F.lit(float(max_ratio))))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and ``n_lines``, ``n_dropped`` (long) added.

    * Every occurrence of a boilerplate line goes; the other lines keep their order. A text whose lines
      all go becomes empty. Rows are never dropped.
    * A null text stays null, with 0 lines; an empty text has one (blank) line.
    * A null host is a host of its own. Repeated rows count as pages of their own.
    * Texts of any length are taken whole. Other columns stay, whatever their names; n_lines and n_dropped are replaced.
    """
    host = F.when(docs[host_col].isNull(), "n").otherwise(F.concat(F.lit("h"), docs[host_col].cast("string")))
    of, drop, left = (unused_name(docs, x) for x in ("host", "drop", "left"))
    lists = boilerplate_lines(docs, host, text_col, max_ratio, min_pages).groupBy("host").agg(F.collect_list("line_hash").alias(drop))
    lists = stored(lists.withColumnRenamed("host", of), "boilerplate")
    tagged = docs.drop("n_lines", "n_dropped").withColumn(of, host).join(lists, of, "left")
    lines = _lines(F.col(text_col))
    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(drop), _hash(x)), F.lit(False))))
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    tagged = tagged.withColumn(left, kept).withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(n))
    n_left = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(left)).cast("long")
    out = tagged.withColumn("n_dropped", F.col("n_lines") - n_left).withColumn(text_col, F.array_join(left, "\n"))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
