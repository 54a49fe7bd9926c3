"""Text as column expressions and word tables. Offsets are code points, ends exclusive."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ChunkOptions, RegexValidator

# What a word is, by white space or by character (for scripts without spaces). The repeated group is possessive: else
# the JVM takes stack for each repetition, and a long hyphenated word ends it; nothing can follow that it would have to give back.
WORDS = r"(?iU)(?:https?://[^\s]+|www\.[^\s]+)|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|@[a-z0-9_]+|[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*+|\S"
CHARACTERS = r"(?U)[A-Za-z0-9@._\-+]+|\S"
SPLITTERS = {"whitespace": WORDS, "char": CHARACTERS}
# The characters of Unicode's white space; nothing else stands between words.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

SPANS = "array<struct<start:int,end:int,text:string>>"
#: Running sums are made in blocks of this many numbers.
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column, levels: int = 1) -> Column:
    """array<int> -> array<int>: at each place the sum up to it, inside the row.

    Sums are made in blocks, and those of blocks are summed up by the same rule, so no array grows beyond a block.
    """

    def plain(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda done, n: F.concat(done, F.array(n + F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)))))

    def blocked(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: plain(F.slice(x, b * BLOCK + 1, BLOCK)))
        upto = lambda p: running_sums(F.transform(p, lambda y: F.get(y, F.size(y) - 1)), levels - 1)
        moved = lambda p, u: F.zip_with(p, F.concat(F.array(F.lit(0)), F.slice(u, 1, F.size(u) - 1)), lambda y, base: F.transform(y, lambda z: z + base))
        return let(parts, lambda p: let(upto(p), lambda u: F.flatten(moved(p, u))))

    return let(numbers, lambda x: F.when(F.size(x) <= BLOCK, plain(x)).otherwise(blocked(x))) if levels else plain(numbers)


def words(text: Column, splitter: str = "whitespace", max_words: int | None = None) -> Column:
    """array<string> of a text's words, at most the first ``max_words``."""
    found = F.regexp_extract_all(text, F.lit(SPLITTERS[splitter]), F.lit(0))
    return found if max_words is None else F.slice(found, 1, max_words)


def _ends(text: Column, pattern: str, found: Column) -> Column:
    """Where each of a pattern's matches ends: what stands before it and it itself add up. ``found`` has the matches."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    return running_sums(F.zip_with(gaps, found, lambda g, w: F.length(g) + F.length(w)))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of the leftmost non-overlapping matches of a pattern that never matches nothing."""
    span = lambda w, end: F.struct((end - F.length(w)).alias("start"), end.alias("end"), w.alias("text"))
    none = F.array().cast(SPANS)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(F.zip_with(found, _ends(text, pattern, found), span).cast(SPANS)))


def led_words(text: Column, splitter: str = "whitespace") -> Column:
    """array<string> of a text's words, each with the white space that stands before it: one pass over the text gives words and places."""
    return F.regexp_extract_all(text, F.lit(rf"(?U)\s*+(?:{SPLITTERS[splitter]})"), F.lit(0))


def unled(led: Column) -> Column:
    return F.ltrim(led, F.lit(SPACES))


def word_spans(text: Column, splitter: str = "whitespace", max_words: int | None = None) -> Column:
    """array<struct<start,end,text>> of a text's words, at most the first ``max_words``."""
    span = lambda w, end: let(unled(w), lambda x: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("text")))
    led = led_words(text, splitter) if max_words is None else F.slice(led_words(text, splitter), 1, max_words)
    return let(led, lambda x: F.zip_with(x, running_sums(F.transform(x, F.length)), span).cast(SPANS))


def word_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", splitter: str = "whitespace", max_words: int | None = None) -> DataFrame:
    """(id, ix, word, start, end): a row a word, ``ix`` from 0. Offsets are made inside a text's row; nothing is moved."""
    # the outer form isn't given a filter on what it explodes, which would make all of it twice
    each = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode_outer(word_spans(F.col(text_col), splitter, max_words)).alias("ix", "x"))
    return each.where("x is not null").select("id", "ix", F.col("x.text").alias("word"), "x.start", "x.end")


def first_words(text: Column, most: int, splitter: str = "whitespace") -> Column:
    """A text up to the end of its ``most``-th word."""
    return F.array_join(F.slice(led_words(text, splitter), 1, most), "")


def with_end_mark(text: Column) -> Column:
    """An empty text becomes a full stop; any other gets one unless it ends in ``.``, ``!`` or ``?``."""
    return F.when(text == "", F.lit(".")).when(text.rlike(r"[.!?]\z"), text).otherwise(F.concat(text, F.lit(".")))


def surface(text: Column, start: Column, end: Column) -> Column:
    """The trimmed slice; offsets stay as they are. Clipped to the text's length."""
    return F.trim(F.substring(text, start + 1, F.greatest(F.least(end, F.length(text)) - start, F.lit(0))))


def semantic_text(text: Column) -> Column:
    """Lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.split(semantic_text(text), " "))


def strict_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))


def literal_pattern(literal: str) -> str:
    """A case-insensitive literal that isn't part of a longer word."""
    quoted = "".join(f"\\Q{x}\\E" for x in re.split(r"\\E", literal)) if "\\E" in literal else f"\\Q{literal}\\E"
    return rf"(?iU)(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])"


def literal_mentions(text: Column, literal: str) -> Column:
    return match_spans(text, literal_pattern(literal))


#: Surfaces longer than it aren't matched by the JVM against a pattern with repeated groups, which would take stack for each repetition.
LONG_SURFACE = 1000


def _searched(pattern: str):
    @F.pandas_udf("boolean")
    def searched(texts: pd.Series) -> pd.Series:
        found = re.compile(pattern)
        return pd.Series([None if t is None else found.search(t) is not None for t in texts], dtype=object)

    return searched


def matches(text: Column, validator: RegexValidator) -> Column:
    """Whether a surface passes a validator. ``.`` stops at newlines alone, and an end is the text's end; an invalid pattern matches nothing.

    A pattern with a repeated group is matched on long surfaces by Python, whose stack doesn't grow with a match; only they are sent there.
    """
    if not validator.valid:
        return F.lit(validator.exclude)
    flags = "(?d" + ("i" if validator.case_insensitive else "") + "U)"
    full = validator.mode == "full"
    found = text.rlike(flags + (f"^(?:{validator.pattern})\\z" if full else validator.pattern))
    if re.search(r"\)[*+{]", validator.pattern):
        other = ("(?i)" if validator.case_insensitive else "") + (f"\\A(?:{validator.pattern})\\Z" if full else validator.pattern)
        long = F.length(text) > LONG_SURFACE
        found = F.when(long, _searched(other)(F.when(long, text))).otherwise(F.when(~long, text).rlike(flags + (f"^(?:{validator.pattern})\\z" if full else validator.pattern)))
    return ~found if validator.exclude else found


def chunks(docs: DataFrame, options: ChunkOptions | None = None, id_col: str = "doc_id", text_col: str = "text", splitter: str = "whitespace") -> DataFrame:
    """(id, chunk_ix, start, text): windows of ``size`` words, ``size - overlap`` apart; the last one reaches the end.

    A text without words is one chunk. All is made inside a text's row: a window begins where the steps before it end, and its text is
    joined from its words with the white space between them, so the work is in proportion to the windows' lengths; nothing is moved.
    """
    o = options or ChunkOptions()
    text = F.col(text_col)

    def windows(led: Column) -> Column:
        n = F.size(led)
        last = F.ceil(F.greatest(n - o.size, F.lit(0)) / o.step).cast("int")
        steps = F.transform(F.sequence(F.lit(0), last), lambda c: F.aggregate(F.slice(led, c * o.step + 1, o.step), F.lit(0), lambda a, w: a + F.length(w)))

        def window(c: Column, upto: Column) -> Column:
            head = F.get(led, c * o.step)
            before = F.when(c == 0, F.lit(0)).otherwise(F.get(upto, c - 1))
            words = F.concat(F.array(unled(head)), F.slice(led, c * o.step + 2, o.size - 1))
            return F.struct(c.alias("chunk_ix"), (before + F.length(head) - F.length(unled(head))).cast("int").alias("start"), F.array_join(words, "").alias("text"))

        many = let(running_sums(steps), lambda upto: F.transform(upto, lambda _, c: window(c, upto)))
        one = F.array(F.struct(F.lit(0).alias("chunk_ix"), F.lit(0).alias("start"), text.alias("text")))
        return F.when(n == 0, one).otherwise(many)

    kept = docs.where(text.isNotNull())
    out = kept.select(F.col(id_col).alias("id"), F.explode_outer(let(led_words(text, splitter), windows)).alias("x"))
    return out.select("id", "x.chunk_ix", "x.start", "x.text")
