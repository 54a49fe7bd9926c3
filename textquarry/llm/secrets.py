"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class.

All of it is made of column expressions; no shuffle, no Python. Offsets are code points,
ends exclusive.

Fixed patterns are matched leftmost and non-overlapping. The text between matches comes
from ``split`` and the matches from ``regexp_extract_all``; their lengths add up to offsets.

Entropy: candidates are maximal runs of a character class. A window of ``WINDOW`` characters
slides over each; the counts of characters in it change by one entering and one leaving
character a step, and with them the sum of c * log2(c), so a step costs the same whatever
the window holds. A candidate is reported, whole, if some window's entropy reaches the
class's threshold and no allow-list rule covers it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind, pattern, group whose length counts, least length.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: For the kinds whose match is one maximal run, short matches needn't be visited: no match begins inside them that is longer.
LONG_RUN = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

WINDOW = 20
#: Class, pattern of a candidate, least bits a character of a window. log2(20) = 4.32 is the most; no attainable value is near a threshold.
CLASSES = [
    ("entropy_hex", r"[0-9A-Fa-f]{20,}", 3.2),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 3.9),
]
#: A candidate that one of these matches is no secret: without a digit or without a letter; a UUID; a
#: placeholder; the start of the alphabet or of the digits in order; path segments or hyphenated words.
ALLOW = [
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i:example|placeholder|changeme|your_|xxxx|dummy|sample)",
    r"(?i:abcdefgh|01234567|12345678)",
    r"^[A-Za-z]{2,}([/_=-]+([A-Za-z]{2,}|[0-9]{1,4}))+$",
]
#: How the JVM is to match the last rule: a repeated group takes stack for every repetition unless it is possessive. Signs,
#: letters and digits can't stand for each other, so giving nothing back changes no match.
POSSESSIVE = {ALLOW[-1]: r"^[A-Za-z]{2,}(?:[/_=-]+(?:[A-Za-z]{2,}|[0-9]{1,4}))++$"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Sums of c * log2(c) are kept in whole millionths, so that sums don't depend on the order of addition.
UNIT = 1_000_000

SPAN = "array<struct<start:int,end:int>>"


def _weight(c: int) -> int:
    return round(c * math.log2(c) * UNIT) if c else 0


def most_weight(bits: float) -> int:
    """The largest sum of c * log2(c), in units, of a window whose entropy is at least ``bits``."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def _fold(text: Column, pattern: str, keep) -> Column:
    """Spans of the matches of a pattern; ``keep`` decides on each from its fields ``whole`` and ``part``."""
    gap, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), keep[1]
    steps = F.arrays_zip(gap.alias("gap"), whole.alias("whole"), part.alias("part"))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + F.length(step["gap"])
        end = start + F.coalesce(F.length(step["whole"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"))).cast(SPAN)
        kept = step["whole"].isNotNull() & F.coalesce(keep[0](step["whole"], step["part"]), F.lit(False))
        return F.struct(end.cast("int").alias("at"), F.when(kept, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    found = F.aggregate(steps, start, add, lambda state: state["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start,end>> of one of the kinds in ``BASE``; the text must not be null."""
    pattern, group, least = next(x[1:] for x in BASE if x[0] == kind)
    if kind in LONG_RUN:
        whole = F.regexp_extract_all(text, F.lit(LONG_RUN[kind]), F.lit(0))
        return _fold(text, LONG_RUN[kind], (lambda w, p: F.lit(True), whole))
    return _fold(text, pattern, (lambda w, p: F.length(p) >= least, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def least_window_weight(candidate: Column) -> Column:
    """Over all windows of a candidate of ``WINDOW`` characters or more, the least sum of c * log2(c): that of the highest entropy."""
    chars = F.split(candidate, "", -1)
    late = F.concat(F.array_repeat(F.lit(""), WINDOW), chars)
    weights = F.array(*[F.lit(_weight(c)) for c in range(WINDOW + 2)])
    steps = F.filter(F.arrays_zip(chars.alias("enters"), late.alias("leaves")), lambda x: F.coalesce(x["enters"], F.lit("")) != "")

    def step(state: Column, x: Column) -> Column:
        enters = F.instr(F.lit(ALPHABET), x["enters"])
        leaves = F.when(x["leaves"] == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), x["leaves"]))
        before = F.get(state["counts"], enters - 1)
        gone = F.when(leaves == 0, F.lit(0)).otherwise(F.get(state["counts"], leaves - 1))
        same = enters == leaves
        change = F.when(same, F.lit(0)).otherwise(
            F.get(weights, before + 1) - F.get(weights, before) + F.when(leaves == 0, F.lit(0)).otherwise(F.get(weights, gone - 1) - F.get(weights, gone))
        )
        counts = F.when(same, state["counts"]).otherwise(F.transform(state["counts"], lambda c, i: c + F.when(i + 1 == enters, 1).otherwise(0) - F.when(i + 1 == leaves, 1).otherwise(0)))
        weight, seen = state["weight"] + change, state["seen"] + 1
        best = F.when(seen >= WINDOW, F.least(state["best"], weight)).otherwise(state["best"])
        return F.struct(counts.alias("counts"), weight.alias("weight"), seen.alias("seen"), best.alias("best"))

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).alias("weight"), F.lit(0).alias("seen"), F.lit(2**31 - 1).alias("best")
    )
    return F.aggregate(steps, start, step, lambda state: state["best"])


def entropy_spans(text: Column, kind: str) -> Column:
    """array<struct<start,end>> of the candidates of a class with a window of high entropy."""
    pattern, bits = next(x[1:] for x in CLASSES if x[0] == kind)

    def high(whole: Column, _: Column) -> Column:
        allowed = F.lit(False)
        for rule in ALLOW:
            allowed = allowed | whole.rlike(POSSESSIVE.get(rule, rule))
        return F.when(allowed, F.lit(False)).otherwise(least_window_weight(whole) <= most_weight(bits))

    return _fold(text, pattern, (high, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def _labelled(spans: Column, no: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Adds ``out``: array<struct<start,end,kind>> by start, then kind in the order of BASE and CLASSES.

    A null text has no spans, like an empty one; texts and candidates of any length are taken whole. A span of an entropy class is added even where it
    overlaps one of a fixed pattern. All columns stay; one named ``out`` is replaced.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    parts = []
    for no, kind in enumerate([*(x[0] for x in BASE), *(x[0] for x in CLASSES)]):
        spans = base_spans(text, kind) if no < len(BASE) else entropy_spans(text, kind)
        parts.append(_labelled(spans, no, kind))
    ordered = F.array_sort(F.concat(*parts))
    return docs.withColumn(out, F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
