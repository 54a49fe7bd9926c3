"""Language identification in two levels: the language's family first, then the language within it.

Features are frequencies of hashed pairs and triples of bytes (A-Z as a-z) of the whole text. On the first level each
family has a linear support vector machine against the others (two families share one). Within a family every two
languages have one; a language's share is the mean of its calibrated probabilities against the others, and the largest
share wins (of equal ones the first by name). A family of one language needs no second level. The score is the product
of the winner's shares.

Codes that ``FAMILIES`` doesn't list join the family whose mean features are nearest, if that is near (``NEAR``), else found
one; so a family that isn't listed has ``GROUP`` languages at most, and the number of machines grows with that of languages, not
with its square. All languages are learnt. Machines are fitted on at most ``FIT_ROWS`` rows of each language and about ``FIT_TOTAL`` in
all (by hash of the id, so the sample doesn't depend on partitioning), one at least of each. Their size is fixed by ``WIDTH``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import BLOCK, LOWER, texts_of
from .scratch import stored, unused_name
from .svm import fit_hinge, fit_sigmoid, sigmoid

#: Rows that are learnt from, at most: of a language; and of all languages, but for one row of each.
FIT_ROWS = 700
FIT_TOTAL = 20_000
#: Languages that a family may get beside the listed ones, and the cosine of mean features from which a language is near a family.
GROUP = 6
NEAR = 0.5
BITS = 16
WIDTH = 1 << BITS
#: Frequencies are multiplied by it, which brings rows near unit length.
SCALE = 20.0
COST = 10.0
UNKNOWN = "und"

# Families of language codes.
FAMILIES = {
    "germanic": ["de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["es", "fr", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def listed_family(lang: str) -> str | None:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0])


def families_of(means: dict[str, np.ndarray]) -> dict[str, str]:
    """The family of each language, from its code or else from its mean features."""
    out = {x: f for x in means if (f := listed_family(x))}
    sums: dict[str, np.ndarray] = {}
    for x, f in sorted(out.items()):
        sums[f] = sums.get(f, 0.0) + means[x]
    room = dict.fromkeys(sums, GROUP)
    for x in sorted(set(means) - set(out)):
        near = {f: float(means[x] @ v) / max(1e-12, float(np.linalg.norm(means[x]) * np.linalg.norm(v))) for f, v in sums.items() if room[f]}
        best = min(near, key=lambda f: (-near[f], f), default=None)
        if best is None or near[best] < NEAR:
            best = f"={x}"
            sums[best], room[best] = 0.0, GROUP
        out[x], sums[best], room[best] = best, sums[best] + means[x], room[best] - 1
    return out


def _blocks(text: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces that overlap by two bytes, so that every pair and triple is in one of them, once."""
    for at in range(0, max(1, len(text) - 2), BLOCK):
        yield text[at : at + BLOCK + 2]


def _columns(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the pairs and of the triples that begin in a block (the last two bytes begin none but the text's end)."""
    x = LOWER[block].astype(np.uint32)
    pairs = x[:-1] | x[1:] << np.uint32(8)
    triples = pairs[:-1] | x[2:] << np.uint32(16)
    mixed = lambda v, k: ((v + np.uint32(1)) * np.uint32(k)) >> np.uint32(32 - BITS)
    return mixed(pairs, 0x9E3779B1), mixed(triples, 0x85EBCA6B)


def has_letter(text: np.ndarray) -> bool:
    low = LOWER[text]
    if ((low >= 0x61) & (low <= 0x7A)).any():
        return True
    return bool((text >= 0x80).any()) and any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))


def frequencies(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text."""
    total = np.zeros(WIDTH, dtype=np.int64)
    if len(text) >= 2:
        for block in _blocks(text):
            pairs, triples = _columns(block)
            total += np.bincount(pairs[: max(1, len(block) - 2)], minlength=WIDTH) + np.bincount(triples, minlength=WIDTH)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] * (SCALE / max(1, total.sum()))).astype(np.float32)


def _all_columns(text: np.ndarray) -> Iterator[np.ndarray]:
    """The columns of a text's pairs and triples, block by block."""
    if len(text) >= 2:
        for block in _blocks(text):
            pairs, triples = _columns(block)
            yield np.concatenate([pairs[: max(1, len(block) - 2)], triples])


def margins(columns, weights: np.ndarray, machines: list[int]) -> np.ndarray:
    """A margin for each of some rows of weights (machines x WIDTH), without its bias; ``columns`` gives arrays of columns."""
    sums, n = np.zeros(len(machines)), 0
    for some in columns:
        n += len(some)
        for i, k in enumerate(machines):
            sums[i] += weights[k][some].sum(dtype=np.float64)
    return sums * (SCALE / max(1, n))


class LanguageModel:
    """Machines of the families, and of every two languages of each family with several."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> None:
        self.languages = sorted(set(langs))
        means = {x: np.zeros(WIDTH) for x in self.languages}  # up to a factor, which a cosine doesn't see
        for (columns, values), x in zip(rows, langs, strict=True):
            means[x][columns] += values
        family = families_of(means)
        self.families = sorted(set(family.values()))
        self.within = {f: [x for x in self.languages if family[x] == f] for f in self.families}
        self.machines: dict[tuple[str, str], int] = {}
        weights, self.bias = [], []
        names = np.array(langs, dtype=object)
        groups = np.array([family[x] for x in langs], dtype=object)

        def learn(key: tuple[str, str], at: np.ndarray, positive: np.ndarray) -> None:
            w, a, b = _machine([rows[i] for i in at], positive)
            self.machines[key] = len(weights)
            weights.append((w * a).astype(np.float32))
            self.bias.append(b)

        for f in self.families[: 1 if len(self.families) == 2 else len(self.families) if len(self.families) > 2 else 0]:
            learn(("", f), np.arange(len(rows)), groups == f)
        for f in self.families:
            for one, other in combinations(self.within[f], 2):
                at = np.flatnonzero((names == one) | (names == other))
                learn((one, other), at, names[at] == one)
        self.weights = np.array(weights, dtype=np.float32).reshape(-1, WIDTH)

    def _probabilities(self, keys: list[tuple[str, str]], columns) -> np.ndarray:
        at = [self.machines[k] for k in keys]
        return sigmoid(margins(columns(), self.weights, at) + np.array([self.bias[i] for i in at]))

    def _family(self, columns) -> tuple[str, float]:
        names = self.families
        if len(names) < 3:
            share = [1.0] if len(names) == 1 else [p := float(self._probabilities([("", names[0])], columns)[0]), 1 - p]
        else:
            share = self._probabilities([("", f) for f in names], columns)
            share = share / max(1e-300, share.sum())
        best = int(np.argmax(share))  # the first by name of equal ones
        return names[best], float(share[best])

    def _language(self, names: list[str], columns) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        pairs = list(combinations(names, 2))
        share = dict.fromkeys(names, 0.0)
        for (one, other), p in zip(pairs, self._probabilities(pairs, columns).tolist(), strict=True):
            share[one] += p
            share[other] += 1 - p
        best = min(names, key=lambda c: (-share[c], c))
        return best, share[best] / (len(names) - 1)

    def predict(self, text: np.ndarray) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        once = list(_all_columns(text)) if len(text) <= BLOCK else None  # columns of a long text are made again for each level
        columns = lambda: once if once is not None else _all_columns(text)
        family, p = self._family(columns)
        lang, q = self._language(self.within[family], columns)
        return lang, p * q


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights, and the sigmoid of their margins; the sigmoid is fitted on the half of the rows that a first fit doesn't see."""

    def fit(at: np.ndarray) -> np.ndarray:
        some = [rows[i] for i in at]
        starts = np.concatenate([[0], np.cumsum([len(c) for c, _ in some])])
        share = max(1e-6, positive[at].mean()), max(1e-6, 1 - positive[at].mean())
        cost = np.where(positive[at], COST * 0.5 / share[0], COST * 0.5 / share[1])
        return fit_hinge(starts, np.concatenate([c for c, _ in some]), np.concatenate([v for _, v in some]).astype(np.float64), np.where(positive[at], 1.0, -1.0), cost, WIDTH)

    at = np.arange(len(rows))
    w = fit(at)
    a, b = 1.0, 0.0
    if len(set(positive[at % 2 == 0].tolist())) == 2:
        first, rest = fit(at[at % 2 == 0]), at[at % 2 == 1]
        if len(set(positive[rest].tolist())) == 2:
            a, b = fit_sigmoid(np.array([first[rows[i][0]] @ rows[i][1] for i in rest]), positive[rest])
    return w, max(a, 1e-3), b


def _frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [frequencies(t) for t in texts_of(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), batch.column(1)], ["columns", "values", "lang"])


def train(docs: DataFrame, learn_from: Column, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_total: int = FIT_TOTAL) -> LanguageModel:
    """A model of the rows with a text and a language whose id meets ``learn_from`` (a condition on a column ``id``)."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("id is not null and text is not null and lang is not null").where(learn_from)
    counts = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")  # a row a language
    fit_rows = max(1, min(fit_rows, fit_total // max(1, counts.count())))
    # rows are picked by a hash that is uniform, about fit_rows of each language; the rest over fit_rows is cut off below
    slots, hashed = 1 << 40, F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 40))
    share = F.least(F.lit(slots), F.ceil(F.lit(float(slots) * fit_rows) / F.col("n")))
    picked = known.join(counts, "lang").where(hashed < share)
    found = picked.select("text", "lang").mapInArrow(_frequency_rows, "columns binary, values binary, lang string").collect()
    found.sort(key=lambda r: (r["lang"], zlib.crc32(r["columns"]), zlib.crc32(r["values"])))  # the same order however the rows arrive
    kept: dict[str, int] = {}
    rows, langs = [], []
    for r in found:
        kept[r["lang"]] = kept.get(r["lang"], 0) + 1
        if kept[r["lang"]] <= fit_rows and len(r["columns"]):
            rows.append((np.frombuffer(r["columns"], dtype=np.int32), np.frombuffer(r["values"], dtype=np.float32)))
            langs.append(r["lang"])
    return LanguageModel(rows, langs)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred (string) and score (double) added; one pass over whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in texts_of(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], [*names, "lang_pred", "score"])

    fields = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*names, F.col(text_col).alias(unused_name(docs, "text"))).mapInArrow(predicted, fields)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and held_out added.

    Learnt only from texts and non-null languages of ids whose crc32 (of the id as text) modulo 4 is not 2; ids,
    sources and languages are no inputs of a prediction.

    * lang_pred is a language learnt, or ``und`` (score 0) for a null text, a text without letters, or if nothing was learnt.
    * A null id is not held out, and never learnt from. Very long texts are read whole, in blocks. Repeated rows are learnt from, and
      predicted, as often as they occur; of languages with equal shares the first by name wins.
    * Other columns stay; columns of these three names are replaced.
    """
    remainder = lambda c: F.crc32(c.cast("string").cast("binary")) % 4
    model = train(docs, remainder(F.col("id")) != 2, FIT_ROWS, id_col, text_col, lang_col)
    return predict(docs, model, text_col).withColumn("held_out", F.coalesce(remainder(F.col(id_col)) == 2, F.lit(False)))
