"""Array kernels over the bytes of Arrow string columns: words, their hashes, shingles.

All work on whole texts. A batch is handled in blocks of about ``BLOCK`` bytes, cut at
white space, so that temporary arrays stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    return splitmix(np.arange(n, dtype=U) + splitmix(np.array([seed], dtype=U)))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: A random number for each byte, capitals as small letters.
BYTE = stream(11, 256)[LOWER]
#: An odd base of the polynomial hash, and its inverse.
BASE = 0x9B97F4A7C15F39CD
INVERSE = pow(BASE, -1, 1 << 64)

_powers = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers 0 to n - 1."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for i, b in enumerate((BASE, INVERSE)):
                p = np.full(n + (n >> 2), U(b), dtype=U)
                p[0] = 1
                _powers[i] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


def texts_of(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each text, without a copy; a null is as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return []
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [flat[a:b] if ok else flat[:0] for a, b, ok in zip(at[:-1].tolist(), at[1:].tolist(), valid.tolist(), strict=True)]


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't ASCII white space."""
    inside = np.empty(len(text) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~SPACE[text]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of byte numbers times powers of a base."""
    up, down = powers(len(text) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(text) + 1, dtype=U)
        np.cumsum(table[text] * up[: len(text)], dtype=U, out=sums[1:])
        return splitmix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def blocks(text: np.ndarray, size: int = BLOCK) -> Iterator[np.ndarray]:
    """The text in pieces of about ``size`` bytes, cut at white space."""
    at = 0
    while len(text) - at > size:
        cut, step = at + size, 1 << 12
        while cut < len(text):
            found = np.flatnonzero(SPACE[text[cut : cut + step]])
            if len(found):
                cut += int(found[0])
                break
            cut = min(len(text), cut + step)
        yield text[at:cut]
        at = cut
    if at < len(text) or not at:
        yield text[at:]


def word_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of each word, A-Z as a-z."""
    parts = []
    for block in blocks(text):
        starts, ends = word_bounds(block)
        parts.append(span_hashes(block, starts, ends))
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


def shingle_set(text: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of a text's runs of k words, ascending; with fewer words, that of the whole sequence."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    width, count = min(k, n), max(1, n - k + 1)
    with np.errstate(over="ignore"):
        h = np.full(count, U(width), dtype=U)
        for i in range(width):
            h = h * U(0xD6E8FEB86659FD93) + words[i : i + count]
    return np.unique(splitmix(h))
