"""Pairs of vectors above a cosine threshold, exactly, by dual traversal of cover trees.

Unit vectors' cosine c is the distance sqrt(2 - 2c), so a threshold on cosines is one on distances. A node of a
cover tree has a centre and a covering radius, and children of half the radius that are nested in it. Two
nodes are pruned if their centres are farther apart than both radii and the threshold; all their pairs are
links if the centres' distance and both radii stay below it; else the larger is opened, and leaves are compared.

A label whose vectors fit in one unit of work (``CHUNK_BYTES``) is one tree. A larger one gets a tree at the top too: its
nodes cover a bounded sample of the label's vectors (``CENTRES`` of all labels together), its leaves are cells, and
every vector belongs to the cell of its nearest centre. Covering radii are the largest distances that occur. A dual traversal
of the top tree prunes pairs of cells; of a cell that is left for its own one, a vector goes only to those that it can
reach, by the cell's covering radius and by its distance from the plane between both centres. Cells are cut into chunks, and
each pair of chunks is a unit with trees of its own, of bounded size however many vectors share a label or a cell.

Equal vectors are one vertex with a weight; they are never compared with each other. A unit returns counts of
links and a spanning forest of what it found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import splitmix
from .scratch import stored

#: Bytes of vectors, as doubles, in a chunk; a unit holds two chunks.
CHUNK_BYTES = 4 << 20
#: Centres of all labels together, at most; they are sent to every executor.
CENTRES = 8192
LEAF = 48
#: Rows of a leaf compared with another leaf at once.
ROWS = 512
#: Distances within it of a bound are decided by the vectors themselves.
EPS = 1e-9


class Node:
    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray, children: list[Node]) -> None:
        self.centre, self.radius, self.points, self.children = centre, radius, points, children


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - c) ** 2).sum(axis=1), 0.0))


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, reach: float = 2.0) -> Node:
    """A tree over rows of x; a child's points lie within half its parent's reach of the child's centre, which is a point of it.

    A node is a leaf if it has few points, or if half the reach would take nearly as many children as points.
    """
    points = np.arange(len(x)) if points is None else points
    centre = x[points[0]]
    away = _distances(x[points], centre)
    radius = float(away.max())
    while reach / 2 >= radius and reach > 1e-6:
        reach /= 2
    if len(points) <= LEAF or radius < 1e-6:
        return Node(centre, radius, points, [])
    most, rest, parts = int(4 * len(points) ** 0.5), points, []
    while len(rest):
        if len(parts) >= most:
            return Node(centre, radius, points, [])
        near = _distances(x[rest], x[rest[0]]) <= reach / 2
        near[0] = True
        parts.append(rest[near])
        rest = rest[~near]
    return Node(centre, radius, points, [cover_tree(x, p, reach / 2) for p in parts])


class Links:
    """Counts of links of two sets of weighted points, and a forest that spans them."""

    def __init__(self, n: int, weight: np.ndarray) -> None:
        self.parent = np.arange(n)
        self.weight = weight
        self.count = np.zeros(n, dtype=np.int64)
        self.edges: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self._root(i), self._root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))

    def all_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of a is linked to every one of b; the same set may stand on both sides."""
        if a is b:
            self.count[a] += self.weight[a].sum() - self.weight[a]
        else:
            self.count[a] += self.weight[b].sum()
            self.count[b] += self.weight[a].sum()
        for j in b:
            self.join(int(a[0]), int(j))
        for i in a[1:]:
            self.join(int(i), int(b[0]))

    def _roots(self) -> np.ndarray:
        p = self.parent
        while (p[p] != p).any():
            p = p[p]
        self.parent = p
        return p

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.weight[j])
        np.add.at(self.count, j, self.weight[i])
        while len(i):
            roots = self._roots()
            apart = roots[i] != roots[j]
            i, j = i[apart], j[apart]
            for k in np.unique(i, return_index=True)[1].tolist():  # one pair a point, then look again
                self.join(int(i[k]), int(j[k]))


def dual_traversal(x: np.ndarray, a: Node, b: Node, cosine: float, links: Links) -> None:
    """Finds all pairs of a point of a and one of b (of one tree: each pair once) with at least this cosine."""
    limit = (2 - 2 * cosine) ** 0.5
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        same = a is b
        apart = 0.0 if same else float(np.sqrt(((a.centre - b.centre) ** 2).sum()))
        if apart > a.radius + b.radius + limit + EPS:
            continue
        if apart + a.radius + b.radius < limit - EPS:
            links.all_pairs(a.points, b.points)
        elif same and a.children:
            todo += [(p, q) for k, p in enumerate(a.children) for q in a.children[k:]]
        elif a.children and (a.radius >= b.radius or not b.children):
            todo += [(p, b) for p in a.children]
        elif b.children:
            todo += [(a, q) for q in b.children]
        else:
            for at in range(0, len(a.points), ROWS):
                low = at if same else 0
                i, j = np.nonzero(x[a.points[at : at + ROWS]] @ x[b.points[low:]].T >= cosine)
                if same:
                    i, j = i[i < j], j[i < j]
                links.pairs(a.points[at + i], b.points[low + j])


_VALID = "id long, label long, dim int, v binary, key binary"


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row; v and key are null where the vector can't be linked."""
    import hashlib

    for batch in batches:
        rows = []
        for key, vector, label in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = None
            if key is not None and label is not None and vector and None not in vector:
                v = np.array(vector, dtype=np.float64) + 0.0  # no negative zeros: equal vectors have equal bytes
                if np.isfinite(v).all() and v.any():
                    raw = v.tobytes()
            rows.append((key, label, len(vector or ()), raw, hashlib.md5(raw).digest() if raw is not None else None))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["id", "label", "dim", "v", "key"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ centres.T), 0.0))


class Top:
    """The top tree's cells of one label: centres, covering radii, numbers of chunks, and which cells may hold links with which."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres
        self.radius = np.zeros(len(centres))
        self.chunks = np.zeros(len(centres), dtype=np.int64)
        self.near = np.ones((len(centres), len(centres)), dtype=bool)
        self.between = _apart(centres, centres)

    def prune(self, limit: float) -> None:
        """Dual traversal of the tree of centres; a node covers the vectors of its cells."""
        tree, cells = cover_tree(self.centres), self.centres
        reach: dict[int, float] = {}

        def covered(node: Node) -> float:
            reach[id(node)] = float((_distances(cells[node.points], node.centre) + self.radius[node.points]).max())
            for child in node.children:
                covered(child)
            return reach[id(node)]

        covered(tree)
        self.near = np.zeros_like(self.near)
        todo = [(tree, tree)]
        while todo:
            a, b = todo.pop()
            if a is not b and float(np.sqrt(((a.centre - b.centre) ** 2).sum())) > reach[id(a)] + reach[id(b)] + limit + EPS:
                continue
            if a is b and a.children:
                todo += [(p, q) for k, p in enumerate(a.children) for q in a.children[k:]]
            elif a.children and (reach[id(a)] >= reach[id(b)] or not b.children):
                todo += [(p, b) for p in a.children]
            elif b.children:
                todo += [(a, q) for q in b.children]
            else:
                at = np.ix_(a.points, b.points)
                close = self.between[at] <= self.radius[a.points][:, None] + self.radius[b.points][None, :] + limit + EPS
                self.near[at] |= close
                self.near[np.ix_(b.points, a.points)] |= close.T
        np.fill_diagonal(self.near, True)

    def reached(self, d: np.ndarray, cell: np.ndarray, limit: float) -> np.ndarray:
        """Rows x cells: whether a vector of distances d from the centres can have a partner in a cell."""
        own = d[np.arange(len(d)), cell][:, None]
        # a partner is nearer to its own centre, so x is within the limit of the plane between both centres
        plane = d * d - own * own <= 2 * self.between[cell] * limit + EPS
        return self.near[cell] & (d <= self.radius + limit + EPS) & plane


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    groups: dict[tuple[int, int], list[int]] = {}
    for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        groups.setdefault(k, []).append(i)
    for k, at in groups.items():
        yield k, np.array(at)


def _cells(shared):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = shared.value
        for batch in batches:
            raw = batch.column(2).to_pylist()
            for key, at in _by_group(batch):
                d = _apart(_unit([raw[i] for i in at]), tops[key].centres)
                cell = d.argmin(axis=1)
                found, n = np.unique(cell, return_counts=True)
                radius = [float(d[cell == c, c].max()) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array([key[1]] * len(found), pa.int32()), pa.array(found, pa.int32()), pa.array(radius, pa.float64()), pa.array(n, pa.int64())], ["label", "dim", "cell", "radius", "n"])

    return cells


_UNITS = "label long, dim int, first long, second long, side int, id long, weight long, key binary, v binary"


def _dealt(shared, limit: float):
    """Each vector to the units it is needed in: first and second are numbers of chunks, side 0 is the first of them."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = shared.value
        for batch in batches:
            raw, ids = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            for key, at in _by_group(batch):
                top = tops[key]
                starts = np.concatenate([[0], np.cumsum(top.chunks)])  # chunks are numbered through all cells
                d = _apart(_unit([raw[i] for i in at]), top.centres)
                cell = d.argmin(axis=1)
                random = splitmix(ids[at].astype(np.int64).view(np.uint64))
                own = starts[cell] + (random % top.chunks[cell].astype(np.uint64)).astype(np.int64)
                row, other = np.nonzero(top.reached(d, cell, limit))
                times = top.chunks[other]
                row = np.repeat(row, times)
                chunk = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[other], times)
                for s in range(0, len(row), 4096):
                    r, c = row[s : s + 4096], chunk[s : s + 4096]
                    first, second = np.minimum(own[r], c), np.maximum(own[r], c)
                    taken = batch.take(pa.array(at[r]))
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(first), pa.array(second), pa.array((own[r] > c).astype(np.int32)), taken.column(3), taken.column(4), taken.column(5), taken.column(2)], ["label", "dim", "first", "second", "side", "id", "weight", "key", "v"])

    return dealt


def _compared(cosine: float):
    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (label, dim, first, second), unit in frame.groupby(["label", "dim", "first", "second"], sort=False):
            unit = unit.sort_values(["side", "key"], kind="stable")
            x, ids, side, keys = _unit(unit["v"].tolist()), unit["id"].to_numpy(), unit["side"].to_numpy(), unit["key"].to_numpy()
            links = Links(len(unit), unit["weight"].to_numpy())
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if first == second:
                tree = cover_tree(x, a)
                dual_traversal(x, tree, tree, cosine, links)
            elif len(a) and len(b):
                dual_traversal(x, cover_tree(x, a), cover_tree(x, b), cosine, links)
            some = np.flatnonzero(links.count)
            edges = np.array(links.edges, dtype=np.int64).reshape(-1, 2)
            out.append(pd.DataFrame({"label": label, "dim": dim, "key": keys[some], "n": links.count[some], "a": 0, "b": 0}))
            out.append(pd.DataFrame({"label": label, "dim": dim, "key": b"", "n": 0, "a": ids[edges[:, 0]], "b": ids[edges[:, 1]]}))
        return pd.concat(out)

    return compared


def _top_trees(reps: DataFrame, large: DataFrame, limit: float, most_centres: int) -> dict[tuple[int, int], Top]:
    """The top tree of each large group; ``large``: (label, dim, n, cells, chunk), with at most ``most_centres`` cells in all."""
    spark = reps.sparkSession
    random = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sampled = reps.join(large, ["label", "dim"]).where(random < F.col("cells") / F.col("n")).select("label", "dim", "v")
    found: dict[tuple[int, int], list[bytes]] = {}
    for r in sampled.limit(2 * most_centres).collect():  # any centres will do; the limit holds whatever the hashes are
        found.setdefault((r["label"], r["dim"]), []).append(bytes(r["v"]))
    tops = {k: Top(_unit(sorted(x))) for k, x in found.items()}
    if not tops:
        return tops
    shared = spark.sparkContext.broadcast(tops)
    keys = spark.createDataFrame(list(tops), "label long, dim int")
    members = reps.join(keys, ["label", "dim"], "left_semi").select("label", "dim", "v")
    cells = members.mapInArrow(_cells(shared), "label long, dim int, cell int, radius double, n long").groupBy("label", "dim", "cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
    rows_of = {(r["label"], r["dim"]): r["chunk"] for r in large.join(keys, ["label", "dim"], "left_semi").collect()}
    for r in cells.collect():  # a row a centre
        top = tops[r["label"], r["dim"]]
        top.radius[r["cell"]], top.chunks[r["cell"]] = r["radius"], -(-r["n"] // rows_of[r["label"], r["dim"]])
    shared.unpersist()
    for top in tops.values():
        top.prune(limit)
    return tops


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", chunk: int | None = None, most_centres: int = CENTRES) -> DataFrame:
    """One row per input row: id_col, n_links (long), component_id (long), kept (boolean).

    Two rows are linked if their labels are equal and not null and their vectors' cosine, in double precision,
    reaches the threshold. ``chunk`` is the number of vectors in a chunk (default: as many as ``CHUNK_BYTES`` hold).

    * A vector that is null, empty, zero or holds a null or non-finite component is linked with nothing, and so are vectors
      of different lengths and rows without label. Such a row is its own component.
    * Equal vectors of one label are linked with one another (each row counts). component_id is the least id reachable.
    * Rows that share an id share its component; each has the links of its own vector. A null id is linked with nothing, its
      component is null, and kept is true there.
    * Only the named columns are read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    limit = (2 - 2 * cosine) ** 0.5
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("long").alias("label"))
    valid = stored(rows.mapInArrow(_valid, _VALID), "vectors")
    same = ["label", "dim", "key"]
    reps = valid.where("key is not null").groupBy(*same, "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    reps = stored(reps.select("label", "dim", "v", "id", "weight", "key"), "distinct-vectors")

    in_chunk = F.greatest(F.lit(1), F.floor(F.lit(CHUNK_BYTES) / (8 * F.col("dim")))) if chunk is None else F.lit(chunk)
    sizes = stored(reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("chunk", in_chunk.cast("long")), "label-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # a label gets a cell for each chunk, or for more of its vectors if all labels together would get too many
    cell = F.greatest(F.col("chunk"), F.lit(-(-2 * total // most_centres)))
    large = sizes.where(F.col("n") > cell).withColumn("cells", F.ceil(F.col("n") / cell))
    tops = _top_trees(reps, large, limit, most_centres)

    keys = spark.createDataFrame(list(tops), "label long, dim int")
    treed = reps.join(keys, ["label", "dim"], "left_semi").select("label", "dim", "v", "id", "weight", "key")
    units = treed.mapInArrow(_dealt(spark.sparkContext.broadcast(tops), limit), _UNITS) if tops else spark.createDataFrame([], _UNITS)
    # the other labels: pairs of chunks, most often one chunk; several small labels share a task
    others = reps.join(sizes.join(keys, ["label", "dim"], "left_anti"), ["label", "dim"]).withColumn("chunks", F.ceil(F.col("n") / F.col("chunk")))
    p = F.pmod(F.xxhash64("id"), F.col("chunks"))
    paired = others.select("label", "dim", p.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("q"), "id", "weight", "key", "v", "n", "chunk")
    paired = paired.select("label", "dim", F.least("p", "q").alias("first"), F.greatest("p", "q").alias("second"), (F.col("p") > F.col("q")).cast("int").alias("side"), "id", "weight", "key", "v", (F.col("n") * 32 < F.col("chunk")).alias("small"))
    tasks = max(1, total // 1024)
    task = F.when(F.col("small"), F.pmod(F.xxhash64("label", "dim"), F.lit(tasks))).otherwise(F.xxhash64("label", "dim", "first", "second"))
    units = units.withColumn("small", F.lit(False)).unionByName(paired).withColumn("task", task)
    found = units.groupBy("task", "small").applyInPandas(_compared(cosine), "label long, dim int, key binary, n long, a long, b long")
    found = stored(found, "vector-links")

    counts = found.where("n > 0").groupBy(*same).agg(F.sum("n").alias("others"))
    of_reps = reps.select(*same, "id", "weight").join(counts, same, "left")
    # an id with several vectors is one vertex: it is tied to what stands for each of them
    several = stored(valid.where("key is not null").groupBy("id").agg(F.min(F.struct(*same)).alias("low"), F.max(F.struct(*same)).alias("high")).where("low != high").select("id"), "several")
    ties = valid.join(several, "id", "left_semi").join(reps.select(*same, F.col("id").alias("rep")), same).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    of = connected_components(found.where("n = 0").select("a", "b").union(ties), "a", "b")
    of_reps = of_reps.join(of, "id", "left")
    of_reps = stored(of_reps.select(*same, (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "vector-components")
    out = valid.select("id", *same).join(of_reps, same, "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
