"""Near-duplicate texts by banded SetSketch registers, confirmed on full shingle sets.

1. One pass over the texts: size, 128-bit digest and registers of each shingle set.
   Texts with one set (exact copies among them) form a class; its least id stands for it,
   so copies are never compared with one another.
2. Bands of registers put representatives into buckets. Each one is compared with the
   least id of the buckets it is in (of those, the one it shares the most bands with):
   a pair a document. Connected components of the confirmed links follow.
   Such a pair is tested in order of cost: by sizes (exact), by the joint likelihood estimate
   from registers (``SLACK`` below the threshold, over five standard errors), on full sets.
3. No candidate pair is left out: it is in one component already, or it is tested now. In a
   bucket of at most ``FEW`` texts that still holds several components, its pairs are listed and
   tested one by one. In a larger one common shingles of all its texts are counted at once on
   full sets: it is cut into chunks, and each pair of chunks is a unit of work of bounded size. A
   unit returns links that join components, at most one less than it has components, and
   never its pairs: a group of k texts costs k rows, not k^2.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^40 = 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .components import connected_components
from .kernels import U, shingle_set, splitmix, texts_of
from .scratch import drop_path, new_path, release, stored

#: How far below the threshold an estimate may lie; the standard error at 0.8 is 0.03.
SLACK = 0.17

#: Texts of a bucket whose pairs are listed: at most (FEW - 1) / 2 a text.
FEW = 8
#: A unit holds two chunks of about this many texts and bytes of sets each, at most.
CHUNK_ROWS, CHUNK_BYTES = 1024, 8 << 20
#: Shingles in at least so many texts of a unit are counted by products of matrices, the others by their pairs.
FREQUENT = 12

#: Bits of a filter of ids: so many an id, but no more than ``MOST_BITS`` in all.
ID_BITS, MOST_BITS = 16, 1 << 27

_SKETCH = "id long, n long, d1 long, d2 long, registers binary"


def _sketches(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, digests, registers = batch.column(0), [], [], []
            for text in texts_of(batch.column(1)):
                found = shingle_set(text, k)
                with np.errstate(over="ignore"):
                    digests.append((splitmix(found ^ U(0x5851F42D4C957F2D)).sum(dtype=U), splitmix(found + U(0x14057B7EF767814F)).sum(dtype=U)))
                n.append(len(found))
                registers.append(setsketch.registers(found))
            d = np.array(digests, dtype=U).reshape(-1, 2).view(np.int64)
            columns = [ids, pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([r.tobytes() for r in registers], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "registers"])

    return sketch


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the bands; they differ from band to band too."""
    for batch in batches:
        sets = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16)
        bands = pa.ListArray.from_arrays(np.arange(0, len(batch) * setsketch.BANDS + 1, setsketch.BANDS, dtype=np.int32), setsketch.band_hashes(sets).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands], ["id", "n", "bands"])


class _Marked:
    """A filter of a stored table's ids: it keeps every row of theirs and few others, so nothing is moved to find them."""

    def __init__(self, ids: DataFrame) -> None:
        self.bits = 1 << 16
        while self.bits < min(MOST_BITS, ID_BITS * ids.count()):
            self.bits *= 2
        place = ids.select(self.place().alias("x"))
        found = place.groupBy(F.shiftright("x", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(x % 64))")).alias("word")).toArrow()
        words = np.zeros(self.bits // 64, dtype=np.int64)
        words[found.column("at").to_numpy()] = found.column("word").to_numpy()
        self.shared = ids.sparkSession.sparkContext.broadcast(words.view(U))

    def place(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.bits))

    def kept(self, rows: DataFrame, value: str, kind: str, change=lambda column: column) -> DataFrame:
        """(id, value) of the rows kept; ``change`` makes what is returned of an Arrow column of values."""
        shared = self.shared

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = shared.value
            for batch in batches:
                x = batch.column(2).to_numpy().astype(U)
                some = batch.filter(pa.array((words[x >> U(6)] >> (x & U(63)) & U(1)).astype(bool)))
                yield pa.RecordBatch.from_arrays([some.column(0), change(some.column(1))], ["id", kind.split(" ")[0]])

        return rows.where("id is not null").select("id", value, self.place().alias("x")).mapInArrow(keep, f"id long, {kind}")


def _estimated(least: float):
    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, setsketch.REGISTERS) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy().astype(np.float64) for i in (4, 5))
            keep = setsketch.similarity(a, b, n_a, n_b) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return estimated


def _confirmed(percent: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirmed


def _tested(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links."""
    side = lambda t, key, value: t.select(F.col("id").alias(key), F.col(value).alias(f"{value}_{key}"))
    with_registers = pairs.join(side(sketches, "a", "registers"), "a").join(side(sketches, "b", "registers"), "b").select("a", "b", "registers_a", "registers_b", "n_a", "n_b")
    likely = stored(with_registers.mapInArrow(_estimated(percent / 100 - SLACK), "a long, b long"), "likely")
    with_sets = likely.join(side(sets, "a", "set"), "a").join(side(sets, "b", "set"), "b").select("a", "b", "set_a", "set_b")
    return stored(with_sets.mapInArrow(_confirmed(percent), "a long, b long"), "links")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common (upper triangle and diagonal may be left 0 or not: use i < j only)."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(np.concatenate(sets) if m else np.zeros(0, dtype=U), kind="stable")
    flat, owner = np.concatenate(sets)[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(flat)))
    cells = []
    for size in range(2, FREQUENT):
        some = starts[sizes == size]
        if len(some):
            own = owner[some[:, None] + np.arange(size)]
            a, b = np.triu_indices(size, 1)
            cells.append((own[:, a] * m + own[:, b]).ravel())
    counts = np.bincount(np.concatenate(cells), minlength=m * m).reshape(m, m).astype(np.float32) if cells else np.zeros((m, m), dtype=np.float32)
    often = np.flatnonzero(sizes >= FREQUENT)
    for i in range(0, len(often), 2048):
        some = often[i : i + 2048]
        block = np.zeros((m, len(some)), dtype=np.float32)
        for c, k in enumerate(some.tolist()):
            block[owner[starts[k] : starts[k] + sizes[k]], c] = 1
        counts += block @ block.T
    return counts


def _unit_links(percent: int):
    def unit_links(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values("id", kind="stable")
        sets = [np.frombuffer(x, dtype=U) for x in unit["set"]]
        n, component, side = np.array([len(x) for x in sets]), unit["c"].to_numpy(), unit["side"].to_numpy()
        common = common_counts(sets).astype(np.int64)
        i, j = np.nonzero(np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1))
        two = side.max() != side.min()
        keep = (component[i] != component[j]) & ((side[i] != side[j]) | (not two))
        known, own = np.unique(component, return_inverse=True)
        links = list(zip(own[i[keep]].tolist(), own[j[keep]].tolist(), strict=True))
        parent, out = list(range(len(known))), []
        for a, b in dict.fromkeys(links):
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent[b] != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((known[a], known[b]))
        return pd.DataFrame(out, columns=["c_a", "c_b"])

    return unit_links


def _links_in_buckets(placed: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (c_a, c_b) between components that meet in a bucket; ``placed``: (h, id, n, c)."""
    # buckets of other bands that hold the very same texts have the same pairs: one of them is enough (digests of 128 bits)
    digest = [F.sum(F.xxhash64("id", "n", F.lit(seed)).cast("decimal(38,0)")).alias(f"d{seed}") for seed in (1, 2)]
    mixed = placed.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements"), *digest).where("low < high")
    mixed = mixed.groupBy("rows", "elements", "d1", "d2").agg(F.min("h").alias("h")).select("h", "rows", "elements")
    chunks = F.ceil(F.greatest(F.col("rows") / CHUNK_ROWS, F.col("elements") * 8 / CHUNK_BYTES)).cast("int")
    mixed = stored(mixed.select("h", F.when(F.col("rows") > FEW, chunks).otherwise(0).alias("chunks")), "mixed-buckets")
    rows = stored(placed.join(mixed, "h"), "mixed")

    side = lambda x: rows.where("chunks = 0").select("h", F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("c").alias(f"c_{x}"))
    pairs = side("a").join(side("b"), "h").where("c_a < c_b").where(_similar_sizes(percent))
    pairs = stored(pairs.select("a", "b", "n_a", "n_b", "c_a", "c_b").distinct(), "pairs")
    listed = _tested(pairs, sketches, sets, percent).join(pairs.select("a", "b", "c_a", "c_b"), ["a", "b"]).select("c_a", "c_b")

    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    units = rows.where("chunks > 0").select("h", "id", "c", own.alias("p"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("q"))
    # only one side of a pair of chunks is named first; a chunk with itself is a unit too
    units = units.select("h", "id", "c", F.least("p", "q").alias("first"), F.greatest("p", "q").alias("second"), (F.col("p") > F.col("q")).cast("int").alias("side"))
    counted = units.join(sets, "id").groupBy("h", "first", "second").applyInPandas(_unit_links(percent), "c_a long, c_b long")
    return listed.union(counted).distinct()


def _similar_sizes(percent: int):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles (long), component_id (long), kept (boolean).

    Texts are linked if 100 * common shingles >= percent * all shingles of both; words are runs of
    anything but ASCII white space, A-Z as a-z; a text of fewer than k words is one shingle.

    * Null, empty and blank texts have no shingle and are linked with nothing. Texts of any length are read whole, in blocks.
    * component_id is the least id reachable by links; kept marks the rows that have it as their id.
    * Rows that share an id share its component. A row without id is linked with nothing: its
      component is null, and it is kept.
    * Only the two named columns are read; others may have any name. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "sketches")
    rows.mapInArrow(_sketches(k), _SKETCH).write.parquet(path)
    sketches = spark.read.schema(_SKETCH).parquet(path)
    known = sketches.where("n > 0 and id is not null")
    sizes = stored(sketches.select("id", "n"), "sizes")

    classes = known.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last")
    copies = stored(known.select("id", "d1", "d2", "n").join(classes, ["d1", "d2", "n"]).where("id > rep").select("id", "d1", "d2", "rep").distinct(), "copies")
    reps = stored(known.join(copies, ["id", "d1", "d2"], "left_anti").select("id", "n", "registers"), "reps")
    drop_path(spark, path)  # nothing reads it any more, and the shuffle files of a step aren't kept for the next one
    release(spark)

    banded = reps.mapInArrow(_bands, "id long, n long, bands array<long>").select("id", "n", F.explode("bands").alias("h"))
    buckets = stored(banded.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("h"), "buckets")
    release(spark)
    several = stored(banded.join(buckets, "h").select("h", "id", "n"), "in-buckets")
    release(spark)
    leads = several.groupBy("h").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last")).where("first.id < last").select("h", "first")
    inside = stored(several.join(leads, "h").select("h", "id", "n", F.col("first.id").alias("lead"), F.col("first.n").alias("lead_n")), "bucketed")
    candidates = _Marked(stored(inside.select("id").distinct(), "candidates"))
    sets = stored(candidates.kept(rows, "text", "set binary", lambda texts: pa.array([shingle_set(t, k).tobytes() for t in texts_of(texts)], pa.binary())), "sets")
    sized = stored(candidates.kept(reps, "registers", "registers binary"), "registers")
    release(spark)

    led = inside.select(F.col("id").alias("a"), F.col("lead").alias("b"), F.col("n").alias("n_a"), F.col("lead_n").alias("n_b")).where("a > b").where(_similar_sizes(percent))
    shared = led.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("bands"))
    best = shared.groupBy("a", "n_a").agg(F.max(F.struct("bands", (-F.col("b")).alias("no"), "b", "n_b")).alias("x")).select("a", "x.b", "n_a", "x.n_b")
    first = connected_components(_tested(best, sized, sets, percent), "a", "b")
    first = stored(first, "components")

    placed = inside.select("h", "id", "n").join(first, "id", "left").select("h", "id", "n", F.coalesce("component", "id").alias("c"))
    second = connected_components(_links_in_buckets(placed, sized, sets, percent), "c_a", "c_b")

    of_reps = first.join(second.select(F.col("id").alias("component"), F.col("component").alias("c2")), "component", "left").select("id", F.coalesce("c2", "component").alias("component"))
    single = second.join(first.select("id"), "id", "left_anti")
    of_reps = stored(of_reps.union(single).distinct(), "of-reps")
    of_copies = copies.select("id", F.col("rep").alias("r")).join(of_reps.select(F.col("id").alias("r"), F.col("component").alias("c")), "r", "left").select("id", F.coalesce("c", "r").alias("component"))
    # an id with several texts can stand in several components: the least is taken
    members = of_reps.union(of_copies).groupBy("id").agg(F.min("component").alias("component"))
    out = sizes.join(members, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
