"""Best-fit packing of tokenized documents into sequences of a fixed capacity, in bulk-synchronous supersteps.

Documents and gaps (what is left of opened sequences) are tables. A superstep takes the documents of one band of
sizes, largest bands first, and does the following:

1. Range sort: both are put in one order of falling size, a gap before a document of its size. A row's place comes from
   the counts of the size classes and its rank in its own class, so no task ever sorts a whole class.
2. Successor sweep: walking down that order, a gap is pushed and a document pops the smallest gap that is still free and
   holds it. As with brackets, a gap and its document are neighbours among the rows of one nesting level, so the
   sweep is a window over levels; a level crosses a size class once at most, which bounds its rows by the capacity.
3. Conflicts: documents that want one gap are served by rank. The first gets it, the others the next gaps up; what finds
   none waits for the next superstep. A gap that holds several documents of the band whatever their sizes is offered
   as often, so few supersteps are needed however small documents are.
4. Gaps are updated. Before a superstep sequences are opened for documents larger than every gap, and, where a band's sizes are
   close to one another, for as many documents as there are more than offers.

The bands are shares of the capacity (``BANDS``). On all distributions tried the number of sequences is that of sequential
best-fit decreasing or within 0.1 % of it. Only counts of size classes, at most ``capacity`` of them, reach the driver.
"""

from __future__ import annotations

import json
import pathlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .scratch import release, stored

#: Rows of one size class ranked by one task, about.
BUCKET_ROWS = 4000
#: Where bands of sizes end, as divisors of the capacity: a sequence holds one document of the first band, two of the second, and so on.
BANDS = (2, 3, 4, 6, 16)
#: New sequences in a row of the table that they are made from.
OPENED = 100_000


# How a byte-level vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def rank_encoder(path: str):
    """A faster encoder of the same ids, or None if the file doesn't prove that it is one.

    Merging by the order of merges is merging by the least id of what results if the file's merges yield, in their
    order, rising ids, and if it splits texts by ``SPLIT`` and changes them in no other way.
    """
    import tiktoken

    spec = json.loads(pathlib.Path(path).read_text(encoding="utf-8"))
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
        return None
    vocabulary, letters = model["vocab"], byte_letters()
    made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    base = [vocabulary.get(c) for c in letters]
    if None in made or None in base or made != sorted(set(made)) or max(base) > made[0] or len(made) + len(base) < len(vocabulary) - len(spec.get("added_tokens", [])):
        return None
    known = set(made) | set(base)
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i in known}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class WordEncoder:
    """Ids of whole texts under a byte-level BPE whose pre-tokens never run from a character into a following space.

    So a text's ids are those of its parts before spaces, each with the space that leads it, and
    the ids of a part are kept for its next occurrence. Texts with white-space runs around spaces, or
    white space beyond ASCII, are encoded as a whole.
    """

    RUNS = ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
    WIDE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
    KEPT = 100_000
    PIECE = 1 << 20
    JOINED = 256

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # found in texts before they are split
        self.ranks = rank_encoder(path)
        self.kept: dict[str, bytes] = {"": self._ids([" "])[0]}
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True  # tokens that begin with a space

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined_ids(self, texts: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self._ids(texts)
        return [np.array(self.ranks.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]

    def _ids_of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of non-empty parts, each with a leading space; many are encoded as one text, and told apart by their first tokens."""
        groups = [parts[i : i + self.JOINED] for i in range(0, len(parts), self.JOINED)]
        out: list[bytes] = []
        for group, code in zip(groups, self._joined_ids(["".join(f" {w}" for w in g) for g in groups]), strict=True):
            at = np.flatnonzero(self.leads[np.frombuffer(code, dtype="<u4")]).tolist()
            if len(at) != len(group):
                out += self._ids([f" {w}" for w in group])
                continue
            out += [code[4 * a : 4 * b] for a, b in zip(at, [*at[1:], len(code) // 4], strict=True)]
        return out

    def _encode_parts(self, parts: list[str]) -> bytes:
        kept = self.kept
        new = set(parts).difference(kept)
        if new:
            if len(kept) > self.KEPT:
                # short words come again the soonest
                short = {w: code for w, code in kept.items() if len(w) < 8}
                kept = self.kept = short if len(short) < self.KEPT // 2 else {"": kept[""]}
                new = set(parts).difference(kept)
            words = list(new)
            kept.update(zip(words, self._ids_of_parts(words), strict=True))
        return b"".join(map(kept.__getitem__, parts))

    def _plain(self, text: str) -> bool:
        return not any(x in text for x in self.special) and not any(x in text for x in self.RUNS) and (text.isascii() or not self.WIDE.search(text))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        cut = text.find(" ", 1)
        if cut < 0 or not self._plain(text):
            return self._ids([text])[0]
        out, at = self._ids([text[:cut]]) if not text.startswith(" ") else [self._encode_parts([text[1:cut]])], cut + 1
        while at <= len(text):
            end = text.find(" ", at + self.PIECE) if len(text) - at > self.PIECE else -1
            end = len(text) if end < 0 else end
            out.append(self._encode_parts(text[at:end].split(" ")))
            at = end + 1
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder a worker process: what it has kept serves its next tasks too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut_starts(total: int, capacity: int) -> list[int]:
    """Where a document's pieces begin: all but the first hold ``capacity`` tokens."""
    first = total % capacity or capacity
    return [0, *range(first, total, capacity)]


_PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document: its ids, then ``end_id``, cut to the capacity."""
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            ids: list[bytes] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code = encoder.encode(text.as_py() or "") + end
                starts = cut_starts(len(code) // 4, capacity)
                for no, (a, b) in enumerate(zip(starts, [*starts[1:], len(code) // 4], strict=True)):
                    part = memoryview(code)[4 * a : 4 * b]
                    rows.append((key, no, a, b - a, zlib.crc32(part)))
                    if with_ids:
                        ids.append(part)
            names = ["id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            if with_ids:
                flat = pa.Array.from_buffers(pa.int32(), sum(map(len, ids)) // 4, [None, pa.py_buffer(b"".join(ids))])
                offsets = pa.array([0, *(len(x) // 4 for x in ids)], pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.compute.cumulative_sum(offsets), flat))
                names = [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    import pyarrow.compute  # noqa: F401  for the closure

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, _PIECES + (", ids array<int>" if with_ids else ""))


def _buckets(most: int) -> int:
    buckets = 1
    while buckets < 1 << 16 and most > buckets * BUCKET_ROWS:
        buckets *= 2
    return buckets


def _bands(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sizes, largest first, cut at the bands' ends."""
    ends = [capacity / d for d in BANDS] + [0.0]
    tops = [float("inf"), *ends[:-1]]
    found = [[n for n in sorted(lengths, reverse=True) if low < n <= high] for low, high in zip(ends, tops, strict=True)]
    return [b for b in found if b]


class _Order:
    """Where each size class of offered gaps and of documents begins in the order of falling size, as nesting depths."""

    def __init__(self, gaps: dict[int, int], docs: dict[int, int]) -> None:
        self.most, least, wanted = max(docs), min(docs), sum(docs.values())
        # of the gaps that hold any document of the band no more are offered than documents are left, the smallest first
        self.gaps: dict[int, tuple[int, int, int]] = {}  # gap: (depth before, offers a gap, gaps offered)
        offered: list[tuple[int, int, int]] = []
        for gap in sorted(g for g in gaps if g >= self.most):
            if wanted <= 0:
                break
            offers = gap // self.most
            n = min(gaps[gap], -(-wanted // offers))
            offered.append((gap, offers, n))
            wanted -= n * offers
        depth = 0
        for gap, offers, n in reversed(offered):
            self.gaps[gap] = (depth, offers, n)
            depth += n * offers
        self.docs: dict[int, int] = {}  # length: depth before
        for size in range(self.most, least - 1, -1):
            if size < self.most and gaps.get(size):
                self.gaps[size] = (depth, 1, gaps[size])
                depth += gaps[size]
            if size in docs:
                self.docs[size] = depth
                depth -= docs[size]


def _table(spark, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of whole numbers, as data of the plan: the code made for a superstep's expressions is the same for all of them."""
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)}))


def _superstep(state: DataFrame | None, docs: DataFrame, gaps: dict[int, int], left: dict[int, int], first: dict[int, int], new: tuple[int, int], buckets: int, capacity: int) -> DataFrame:
    """One sweep, as rows (seq, gap, length, rank, offset): a pair placed has its length, rank and offset, a gap what is left of it.

    ``state``: the sweep before; ``gaps`` and ``left``: counts of the gaps of use and of the band's documents; ``first``: the least rank
    of a size that is left; ``new``: the first new sequence and how many there are.
    """
    spark, order = docs.sparkSession, _Order(gaps, left)
    # both tables of classes have at most ``capacity`` rows, whatever the corpus's size
    of_gaps = _table(spark, ["gap", "depth", "offers", "n", "size"], [(g, *order.gaps.get(g, (0, 0, 0)), min(g, order.most)) for g in gaps])
    of_docs = _table(spark, ["length", "depth", "first"], [(n, d, first[n]) for n, d in order.docs.items()])
    opened = _table(spark, ["a", "b"], [(a, min(a + OPENED, sum(new)) - 1) for a in range(new[0], sum(new), OPENED)])
    free = opened.select(F.explode(F.sequence("a", "b")).alias("seq"), F.lit(capacity).cast("long").alias("gap"))
    free = free if state is None else state.select("seq", "gap").union(free)
    free = free.join(F.broadcast(of_gaps), "gap")  # the others are too small for what is left
    hashed = free.withColumn("bucket", F.pmod(F.xxhash64("seq"), F.lit(buckets)).cast("int"))
    offers = ranked(hashed, ["gap"], "bucket", ["seq"], "at").where("at < n")
    offers = offers.select("seq", "gap", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("offers") - 1)).alias("t"), "depth", "at", "offers")
    none = F.lit(None).cast("long")
    pushed = offers.select((F.col("depth") + F.col("at") * F.col("offers") + F.col("t") + 1).alias("level"), "size", F.lit(0).alias("kind"), "seq", "gap", "t", none.alias("rank"))
    popped = docs.join(F.broadcast(of_docs), "length").where("rank >= first")
    popped = popped.select((F.col("depth") - (F.col("rank") - F.col("first"))).alias("level"), F.col("length").alias("size"), F.lit(1).alias("kind"), none.alias("seq"), none.alias("gap"), none.alias("t"), "rank")
    sweep = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    before = lambda c: F.lag(c).over(sweep).alias(c)  # noqa: E731  null where the row before is no gap
    pairs = pushed.union(popped).select("kind", F.col("size").alias("length"), "rank", before("seq"), before("gap"), before("t")).where("kind = 1 and seq is not null")
    both = pairs.select("seq", "gap", "t", "length", "rank").union(free.select("seq", "gap", none.alias("t"), none.alias("length"), none.alias("rank")))
    whole = Window.partitionBy("seq")
    earlier = whole.orderBy(F.col("t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    used, taken = F.coalesce(F.sum("length").over(earlier), F.lit(0)), F.coalesce(F.sum("length").over(whole), F.lit(0))
    pair = F.col("length").isNotNull()
    both = both.withColumn("used", used).withColumn("taken", taken)
    return both.select("seq", F.when(~pair, F.col("gap") - F.col("taken")).alias("gap"), "length", "rank", F.when(pair, F.lit(capacity) - F.col("gap") + F.col("used")).alias("offset"))


def _to_open(band: list[int], left: dict[int, int], gaps: dict[int, int], capacity: int) -> int:
    """How many sequences to open before a superstep of a band (sizes left, the largest first)."""

    def sequences(docs: list[tuple[int, int]]) -> int:
        each = capacity // docs[0][0]
        return -(-sum(n for _, n in docs) // each) if each < 4 else -(-sum(size * n for size, n in docs) // capacity)

    most = max(gaps, default=0)
    unfit = [(size, left[size]) for size in band if size > most]
    new = sequences(unfit) if unfit else 0
    short = sum(left[size] for size in band) - sum(n * max(1, g // band[0]) for g, n in gaps.items() if g >= band[-1])
    if short > 0 and band[0] * BANDS[-1] > capacity:  # the smallest sizes fill what others leave, in later supersteps
        least: list[tuple[int, int]] = []  # the smallest documents, as many as there are more than offers
        for size in reversed(band):
            least.insert(0, (size, min(short, left[size])))
            short -= left[size]
            if short <= 0:
                break
        new = max(new, sequences([(band[0], 0), *least]))
    return new


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset (long) to a stored table of pieces (id, piece, length, ...)."""
    spark = pieces.sparkSession
    # at most ``capacity`` rows, whatever the corpus's size
    left = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = dict.fromkeys(left, 0)
    bands = _bands(list(left), capacity)
    hashed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(_buckets(max(left.values(), default=0)))).cast("int"))
    order = [F.col("id").asc_nulls_first(), "piece", "ids_crc32"]
    # a superstep reads its own band alone
    band_of = F.lit(0)
    for no, band in enumerate(bands):
        band_of = F.when(F.col("length") <= band[0], F.lit(no)).otherwise(band_of)
    rows = stored(ranked(hashed, ["length"], "bucket", order, "rank").drop("bucket").withColumn("band", band_of), "ranked-pieces", "band")
    placed = spark.createDataFrame([], "length long, rank long, sequence_id long, offset long")
    opened, state, gaps, buckets = 0, None, {}, _buckets(sum(left.values()) // 4)
    for no, band in enumerate(bands):
        docs = rows.where(F.col("band") == no).select("length", "rank")
        if 2 * band[-1] > capacity:  # no two of them fit in one sequence, and nothing is open yet: each opens one
            starts = []
            for n in band:
                starts.append((n, opened))
                opened += left[n]
                gaps[capacity - n], left[n] = left[n], 0
            alone = docs.join(F.broadcast(_table(spark, ["length", "start"], starts)), "length")
            alone = alone.select("length", "rank", (F.col("start") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
            placed = alone
            state = alone.select(F.col("sequence_id").alias("seq"), (F.lit(capacity) - F.col("length")).alias("gap"))
            gaps = {g: n for g, n in gaps.items() if g >= _least(left, capacity)}
        while any(left[n] for n in band):
            band = [n for n in band if left[n]]
            new = _to_open(band, left, gaps, capacity)
            if new:
                gaps[capacity] = gaps.get(capacity, 0) + new
            step = _superstep(state, docs, gaps, {n: left[n] for n in band}, first, (opened, new), buckets, capacity)
            opened += new
            state = stored(step, "superstep")
            placed = placed.union(state.where("length is not null").select("length", "rank", F.col("seq").alias("sequence_id"), "offset"))
            gaps = {}
            for r in state.groupBy("length", "gap").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows a size at most
                if r["length"] is None:
                    gaps[r["gap"]] = r["n"]
                else:
                    left[r["length"]] -= r["n"]
                    first[r["length"]] += r["n"]
            gaps = {g: n for g, n in gaps.items() if g >= _least(left, capacity)}
            release(spark)  # the plans of a band's supersteps together can fill the driver's heap
    return rows.drop("band").join(placed, ["length", "rank"]).drop("rank")


def _least(left: dict[int, int], capacity: int) -> int:
    """The smallest size that is left."""
    return min((n for n in left if left[n]), default=capacity + 1)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A document is its ids, then ``end_id``. Longer ones than the capacity are cut so that all pieces but
    the first are full.

    * A null or empty text is ``end_id`` alone. A null id stays null. Repeated rows are packed as often as they occur.
    * Strings of the tokenizer's special tokens in a text are these tokens, as ``tokenizers`` itself has it. Texts of any length are
      tokenized whole.
    * Offsets in a sequence are gapless from 0; sequence numbers are any.
    * Only the two named columns are read. An empty table gives an empty result.
    """
    pieces = stored(tokenized_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "pieces")
    out = pack(pieces, capacity)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset")
