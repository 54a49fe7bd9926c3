"""SetSketch registers of sets of 64-bit hashes: mergeable, locality-sensitive, jointly estimated.

Register i of a set is ``floor(1 - log_b(min over elements of x_i))``, clipped to
``[0, Q + 1]``, where an element's x_i is exponential with rate A: the minima are truncated
to exponentially spaced values. A union's registers are the element-wise maxima. Registers
of two sets agree with a probability that rises with their Jaccard similarity; for sets
with nothing in common it is about (b - 1) / 4, so b close to 1 keeps chance agreement rare.
"""

from __future__ import annotations

import numpy as np

from .kernels import U, splitmix, stream

B = 1.001
A = 20.0
Q = (1 << 16) - 2
LOG_B = np.log(B)
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS

_FLIP = (stream(21, REGISTERS) >> U(32)).astype(np.uint32)
_TIMES = (stream(22, REGISTERS) >> U(32)).astype(np.uint32) | np.uint32(1)
_CHUNK = 1 << 10


def registers(elements: np.ndarray) -> np.ndarray:
    """uint16 registers of a set; all 0 for the empty set.

    x_i = -ln(1 - u_i) / A falls in step with u_i, so minima are taken over the hashed
    integers, and only the least of each register is turned into an exponential.
    """
    if not len(elements):
        return np.zeros(REGISTERS, dtype=np.uint16)
    small = (elements ^ (elements >> U(32))).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(small), _CHUNK):
        x = small[i : i + _CHUNK, None] ^ _FLIP
        x *= _TIMES
        np.minimum(least, x.min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    x = -np.log1p(-u) / A
    return np.clip(np.floor(1.0 - np.log(x) / LOG_B), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def band_hashes(found: np.ndarray) -> np.ndarray:
    """A signed 64-bit number for each band of registers (rows of a matrix: sets); equal bands get equal numbers."""
    bands = found.reshape(-1, BANDS, ROWS).astype(U)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(BANDS, dtype=U), bands.shape[:2]) + U(1)
        for i in range(ROWS):
            h = splitmix(h * U(0x9E3779B97F4A7C15) + bands[:, :, i])
    return h.view(np.int64)


#: Similarities at which the likelihood is evaluated.
_GRID = np.linspace(0.0, 1.0, 201)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / LOG_B


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates of the Jaccard similarity of pairs of sets (rows) of known sizes.

    With u and v the sizes' shares, a register of a is the larger with probability p(u - v J) and the
    smaller with p(v - u J); J is at most the smaller size over the larger.
    """
    out = np.zeros(len(a))
    for i in range(0, len(a), 4096):
        s = slice(i, i + 4096)
        more = (a[s] > b[s]).sum(axis=1)[:, None]
        less = (a[s] < b[s]).sum(axis=1)[:, None]
        same = a.shape[1] - more - less
        u = (n_a[s] / (n_a[s] + n_b[s]))[:, None]
        v = 1.0 - u
        j = _GRID * np.minimum(u / v, v / u)
        up, down = np.maximum(_p(np.maximum(u - v * j, 0)), 1e-12), np.maximum(_p(np.maximum(v - u * j, 0)), 1e-12)
        value = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
        out[s] = j[np.arange(len(j)), value.argmax(axis=1)]
    return out
