"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by Naive Bayes log-count ratios.

Indicators (present or not, over the whole text) of hashed n-grams: words, pairs of words, and runs of one to
three word shapes. A shape is what a word's first and last two bytes are (small, capital, digit, a certain
sign, beyond ASCII), how long it is, and whether it repeats the word before.

The ratio of a column is the log of its share among good rows over that among bad ones, smoothed; each row's
indicators are multiplied by them and scaled to unit length, and a linear support vector machine is fitted by
dual coordinate descent. Its margins are turned into probabilities by a sigmoid, fitted out of fold.

The model is fitted on a bounded sample of labelled rows (``FIT_ROWS``, those with the least hash of their id, so
the sample doesn't depend on partitioning); its size is fixed by ``WIDTH``. Scoring is one pass over whole texts
without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE, U, blocks, span_hashes, splitmix, texts_of, word_bounds
from .scratch import unused_name
from .svm import fit_hinge, fit_sigmoid, sigmoid

#: Labelled rows a model is fitted on, at most.
FIT_ROWS = 4000
BITS = 18
WIDTH = 1 << BITS
COST = 1.0
SMOOTH = 1.0
FOLDS = 3
THRESHOLD = 0.3

# What a byte is: 0 small letter, 1 capital, 2 digit, 3 beyond ASCII, else a sign of its own.
_KIND = np.arange(256, dtype=np.uint64) + U(8)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 3


def _tokens(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and shape hashes of a whole text."""
    words, shapes = [], []
    for block in blocks(text):
        a, b = word_bounds(block)
        words.append(span_hashes(block, a, b, BYTE))
        n = b - a
        kind = _KIND[block] if len(block) else np.zeros(1, dtype=U)
        long = np.minimum(n, 3) + (n > 12) + (n > 30)
        shapes.append(kind[a] + U(300) * (kind[b - 1] + U(300) * (kind[np.maximum(a, b - 2)] + U(300) * long.astype(U))))
    w, s = np.concatenate(words), np.concatenate(shapes)
    again = np.zeros(len(w), dtype=U)
    again[1:] = w[1:] == w[:-1]
    with np.errstate(over="ignore"):
        return w, splitmix(s * U(2) + again)


def indicators(text: np.ndarray) -> np.ndarray:
    """Distinct columns of a text's n-grams, ascending (int32)."""
    w, s = _tokens(text)
    with np.errstate(over="ignore"):
        grams = [w ^ U(1), splitmix(w[:-1] * U(3) + w[1:]), s ^ U(2), splitmix(s[:-1] * U(5) + s[1:]), splitmix((s[:-2] * U(7) + s[1:-1]) * U(7) + s[2:])]
    return np.unique((np.concatenate(grams) >> U(64 - BITS)).astype(np.int32))


def _fit(rows: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ratio * weight, ratio squared) of each column."""
    counts = [np.bincount(np.concatenate([r for r, g in zip(rows, good, strict=True) if g == side] or [np.zeros(0, dtype=np.int32)]), minlength=WIDTH) + SMOOTH for side in (True, False)]
    ratio = np.log((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum()))
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    columns = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    values, square = ratio[columns], ratio**2
    length = np.sqrt(np.maximum([square[r].sum() for r in rows], 1e-12))
    for a, b, n in zip(starts[:-1].tolist(), starts[1:].tolist(), length.tolist(), strict=True):
        values[a:b] /= n
    y = np.where(good, 1.0, -1.0)
    share = {True: good.mean() if len(good) else 0.5, False: 1 - good.mean() if len(good) else 0.5}
    cost = np.array([COST * 0.5 / max(share[bool(g)], 1e-6) for g in good])
    w = fit_hinge(starts, columns, values, y, cost, WIDTH)
    return (w * ratio).astype(np.float32), (ratio**2).astype(np.float32)


def _margins(rows: list[np.ndarray], weights: np.ndarray, square: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows))
    for i, r in enumerate(rows):
        length = float(square[r].sum(dtype=np.float64)) ** 0.5
        out[i] = float(weights[r].sum(dtype=np.float64)) / length if length else 0.0
    return out


def fit_quality(rows: list[np.ndarray], good: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """The model of rows of indicators and their labels; with one class or none it scores all rows by the share of good ones."""
    n = len(rows)
    if n < 2 * FOLDS or good.all() or not good.any():
        p = (good.sum() + 1) / (n + 2)
        return np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), 0.0, float(np.log(p / (1 - p)))
    fold = np.arange(n) % FOLDS
    margin = np.zeros(n)
    for k in range(FOLDS):
        if len(set(good[fold != k].tolist())) < 2:
            continue
        model = _fit([rows[i] for i in np.flatnonzero(fold != k)], good[fold != k])
        margin[fold == k] = _margins([rows[i] for i in np.flatnonzero(fold == k)], *model)
    a, b = fit_sigmoid(margin, good)
    return (*_fit(rows, good), a, b)


def crc32_of(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary"))


def _indicator_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [indicators(t).tobytes() for t in texts_of(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["columns", "label"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows, as one row."""
    rows = [(c, label) for batch in batches for c, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    rows.sort(key=lambda r: (zlib.crc32(r[0]), r[1], len(r[0])))  # the same order however the rows arrive
    weights, square, a, b = fit_quality([np.frombuffer(c, dtype=np.int32) for c, _ in rows], np.array([label == 1 for _, label in rows], dtype=bool))
    columns = [pa.array([weights.tobytes()], pa.binary()), pa.array([square.tobytes()], pa.binary()), pa.array([a], pa.float64()), pa.array([b], pa.float64())]
    yield pa.RecordBatch.from_arrays(columns, ["weights", "square", "a", "b"])


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple:
    """The model, from at most ``fit_rows`` labelled rows whose id meets ``learn_from`` (a condition on a column ``id``).

    Rows without text or label don't count. An id with several labels counts once for each.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(learn_from)
    # the sample is bounded, so it is broadcast
    sample = known.orderBy(F.xxhash64("id", F.lit(7)), "id", "label").limit(fit_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    picked = texts.join(F.broadcast(sample), "id").select("text", "label", "id")
    found = picked.select("text", "label").mapInArrow(_indicator_rows, "columns binary, label int")
    # a worker fits: the driver gets the model alone, neither the sample nor what the fit makes of it
    model = found.repartition(1).mapInArrow(_fitted, "weights binary, square binary, a double, b double").collect()
    if not model:  # no task runs for an empty sample
        return fit_quality([], np.zeros(0, dtype=bool))
    return np.frombuffer(model[0]["weights"], dtype=np.float32), np.frombuffer(model[0]["square"], dtype=np.float32), model[0]["a"], model[0]["b"]


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out`` (double, 0 to 1) added: how likely the text is good. Null, empty and blank texts get the sigmoid's value at margin 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != out]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, square, a, b = shared.value
        for batch in batches:
            texts = texts_of(batch.column(batch.num_columns - 1))
            margin = _margins([indicators(t) for t in texts], weights, square)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sigmoid(a * margin + b), pa.float64())], [*names, out])

    fields = docs.select(*names).schema.add(out, "double")
    return docs.select(*names, F.col(text_col).alias(unused_name(docs, "text"))).mapInArrow(scored, fields)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` with score (double), predicted (int: 1 if score >= THRESHOLD) and held_out (boolean) added.

    Labels are learnt only from ids whose crc32 (of the id as text) is no multiple of 5; the others are held out.
    Labels, languages, sources and ids are never inputs of a score.

    * A null id is not held out, and never learnt from. Null, empty and blank texts are scored alike.
    * Other columns stay; columns of these three names are replaced. Without usable labels every row gets score 1/2.
    """
    model = train(docs, labels, crc32_of(F.col("id")) % 5 != 0, FIT_ROWS, id_col, text_col, label_col)
    out = score(docs, model, id_col, text_col)
    out = out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    return out.withColumn("held_out", F.coalesce(crc32_of(F.col(id_col)) % 5 == 0, F.lit(False)))
