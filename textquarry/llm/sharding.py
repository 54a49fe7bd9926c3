"""Proportional stratified interleaving: every shard gets the corpus's mixture of sources.

Rows of each source are put in a seeded random order; a row's fractional rank is
``(rank + 1/2) / rows of its source``. All rows, sorted by fractional rank, are cut into
runs of equal length, so each run holds every source in its overall proportion, give or
take one row a source.

Only (id, source, size, checksum, random number) are moved, never texts. Neither a source
nor the global order meets in one task: both are ranked by buckets (see ``ranking``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .scratch import stored

#: Buckets of random numbers in a source, and of fractional ranks over all rows.
BITS = 12


def proportional_shards(docs: DataFrame, shards: int = 16, seed: str = "mixture-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    * ``size``: UTF-8 bytes of the text plus 1 (1 for a null or empty text).
    * ``shard`` (int, from 0): counts of shards differ by one at most; ``slot`` (long) is gapless from 0 in each.
    * A null source is a stratum of its own; an empty source is another.
    * A null id is allowed; rows with one id and source (repeated rows) tie in random number and are
      ordered by size, then checksum; rows that are equal in these too may change places.
    * Texts of any length are read whole, and never moved. An empty table gives an empty result. Further columns of ``docs``, whatever their names, are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text, source, key = docs[text_col], docs[source_col], docs[id_col]
    random = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")
    rows = docs.select(
        key.alias("id"),
        F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string"))).alias("stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        random.alias("random"),
    ).withColumn("bucket", F.shiftright("random", 60 - BITS).cast("int"))
    rows = stored(rows, "shard-rows")
    tie = [F.col("id").asc_nulls_first(), "size", "text_crc32"]
    in_source = ranked(rows, ["stratum"], "bucket", ["random", *tie], "rank", "of")
    fraction = (2 * F.col("rank") + 1).cast("double") / (2 * F.col("of")).cast("double")
    placed = in_source.select("id", "stratum", "size", "text_crc32", "random", fraction.alias("fraction"))
    placed = stored(placed.withColumn("part", F.least(F.floor(F.col("fraction") * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("int")), "shard-fractions")
    out = ranked(placed, [], "part", ["fraction", "random", *tie, "stratum"], "position", "rows")
    # shard s holds the positions p with p * shards div rows = s; it begins at ceil(s * rows / shards)
    out = out.withColumn("shard", F.expr(f"position * {shards} div rows"))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.expr(f"position - (shard * rows + {shards - 1}) div {shards}").alias("slot"))
