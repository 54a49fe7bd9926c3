"""Benchmark decontamination by pigeonhole edit matching.

A text holds a test item if some passage of it is within ``floor(len * rate)`` edits of the
item. Each item is split into that budget plus one pieces: of these, one at least stands in the
passage unchanged. All pieces go into one automaton, which each text is run through once; a hit
fixes, up to the budget, where the passage must lie, and that window is verified by Myers'
bit-parallel distance.

Texts and items are compared in normal form: lower case, white space runs as one space.
The items are read as blocks of a bounded number of characters. A block's hits are written before the next block is
broadcast, and a Python worker keeps one block's automaton (about 55 bytes a character), so a benchmark of any size fits; each
block is a pass over the texts. No text is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

RATE = 0.05
#: Characters of items that are matched in one pass over the texts.
BLOCK_CHARS = 2_000_000
#: An item whose pieces would be shorter gets fewer pieces, and so a smaller budget.
LEAST_PIECE = 8

_SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    return _SPACE.sub(" ", text.lower()).strip()


def budget(length: int, rate: float = RATE) -> int:
    return max(0, min(int(length * rate), length // LEAST_PIECE - 1))


def split_pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` neighbouring pieces of about equal length, with their places."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def best_match(item: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the passage of ``text`` nearest to ``item``, the first such end, by Myers' bit vectors over the item's characters.

    An anchored passage begins where the text does.
    """
    m = len(item)
    every, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    plus, minus, score = every, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & every
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | anchored) & every
        down = down << 1 & every
        plus = down | ~(xv | up) & every
        minus = up & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def nearest_start(item: str, text: str, end: int, edits: int) -> int:
    """Where the passage begins that ends at ``end`` within ``edits`` of ``item``; of several starts the latest."""
    low = max(0, end - len(item) - edits)
    return end - best_match(item[::-1], text[low:end][::-1], anchored=True)[1]


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = [(key, text, budget(len(text), rate)) for key, text in items]
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for no, (_, text, edits) in enumerate(self.items):
            for at, piece in split_pieces(text, edits):
                pieces.setdefault(piece, []).append((no, at))
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's key, edits, start, end in the normal form) of the best passage for each item within its budget."""
        found: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        if not len(self.automaton):
            return []
        for last, (length, owners) in self.automaton.iter(text):
            for no, at in owners:
                _, item, edits = self.items[no]
                begin = last + 1 - length - at  # where the item would begin, without edits before this piece
                if no in found and found[no][0] == 0:
                    continue
                # the passage lies in [begin - edits, begin + len + edits]; within a window that has been tried it needs no second look
                windows = tried.setdefault(no, [])
                if any(low <= begin - edits and begin + len(item) + edits <= high for low, high in windows[-8:]):
                    continue
                low, high = begin - 2 * edits, begin + len(item) + 2 * edits
                windows.append((low, high))
                distance, end = best_match(item, text[max(0, low) : high])
                if distance <= edits and (no not in found or distance < found[no][0]):
                    found[no] = (distance, max(0, low) + end)
        out = []
        for no, (distance, end) in found.items():
            key, item, edits = self.items[no]
            out.append((key, distance, end - len(item) if not distance else nearest_start(item, text, end, edits), end))
        return out


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``most`` characters (or one item)."""
    block: list[tuple[int, str]] = []
    chars = 0
    for key, text in items.toLocalIterator():
        text = normal(text)
        if not text:
            continue
        if block and chars + len(text) > most:
            yield block
            block, chars = [], 0
        block.append((key, text))
        chars += len(text)
    if block:
        yield block


_matcher: list = []  # of this worker: the block's name and its matcher


def _matcher_of(name: str, shared, rate: float) -> Matcher:
    if not _matcher or _matcher[0] != name:
        _matcher.clear()
        _matcher.extend([name, Matcher(shared.value, rate)])
    return _matcher[1]


def _matched(rows: DataFrame, shared, rate: float, schema: str) -> DataFrame:
    name = uuid.uuid4().hex

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher_of(name, shared, rate)
        names = ["id", "item", "edits", "start", "end"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            found = [(key, *x) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in matcher.matches(normal(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 5, kinds, strict=True)], names)

    return rows.mapInArrow(match, schema)


def benchmark_matches(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, item_col, edits, start, end) for every row and item it holds; ends exclusive, in the text's normal form.

    * Null and empty texts hold nothing; null, empty and blank items are held by nothing.
    * Several passages of one item in a text give one row, for one with the fewest edits: of those the first that is found, walking
      the item's pieces through the text; of its ends the first, of its starts the latest.
    * Texts of any length are searched whole.
    * Equal items, and repeated rows, are all reported. A null id is reported as null.
    * Only the named columns are read. An empty table on either side gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null and text != ''")
    wanted = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    schema = "id long, item long, edits int, start long, end long"
    spark, out = docs.sparkSession, None
    waiting = None  # a block is matched when it is known whether another follows: a single one needs no table
    for block in _blocks(wanted, block_chars):
        if waiting is not None:
            done = stored(_matched(rows, waiting, rate, schema), "block-matches")
            waiting.unpersist()
            out = done if out is None else out.union(done)
        waiting = spark.sparkContext.broadcast(block)
    if waiting is None:
        out = spark.createDataFrame([], schema)
    else:
        last = _matched(rows, waiting, rate, schema)
        out = last if out is None else out.union(last)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "start", "end")


def without_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a test item; all columns stay. Rows of one id go together."""
    hits = stored(benchmark_matches(docs, items, rate, id_col, text_col).select(F.col(id_col).alias("__hit")).distinct(), "contaminated")
    return docs.join(hits, docs[id_col].eqNullSafe(hits["__hit"]), "left_anti")
