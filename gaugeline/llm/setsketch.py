"""SetSketch registers: exponentially spaced truncated minima.

For each of ``m`` registers a set's elements draw exponentially distributed values of rate ``RATE``;
the register keeps ``floor(1 - log_b(least))``, at least 0.  An element's draws are the points of one
Poisson process dealt to the registers at random, so only its first few points matter; they are drawn
until they exceed every register's least value, and the result is that of drawing them all.

Sketches of a union are the elementwise maximum (``merge``).  With b this close to 1 two registers
agree with a probability that is almost the Jaccard similarity; band values find candidates, and the
counts of greater, equal and less registers give the maximum of the joint likelihood for known sizes.
"""

from __future__ import annotations

import numpy as np

from .shingles import U, mixed

M = 252
#: Registers of a band that divide ``M``, the most first.
ROWS = (7, 6, 4, 3, 2, 1)
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: The bits of a band value that tell the band.
LOW = 63
#: Registers of a sharp sketch, of which the two lowest bits are kept.
SHARP = 2048


def sketches(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """A row of ``m`` unsigned 16-bit registers a set; sets must not be empty."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, U)
    least = np.full(n * m, np.inf)
    at = np.zeros(len(element))
    step = 0
    while len(element):
        step += 1
        z = mixed(element + U((step * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        at = at - np.log(((z >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
        register = ((mixed(z ^ U(0xD1B54A32D192ED03)) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        np.minimum.at(least, doc * m + register, at)
        if step * len(element) < m and step % 8:  # few are left: look less often whether they are done
            continue
        here, back = np.unique(doc, return_inverse=True)
        most = least.reshape(n, m)[here].max(axis=1)
        go = at < most[back]
        element, doc, at = element[go], doc[go], at[go]
    values = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(values, 0, TOP).astype(np.uint16).reshape(n, m)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def rows_of_a_band(similarity: float, miss: float = 1e-5) -> int:
    """The most registers with which sets of the similarity share a band but for a probability of ``miss``."""
    return next((r for r in ROWS if (1 - similarity**r) ** (M // r) <= miss), 1)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A value for each band of each sketch: 58 bits of a hash, then the band's."""
    x = sketch.astype(U).reshape(len(sketch), -1, rows)
    factors = mixed(np.arange(1, rows + 1, dtype=U) * U(0xA0761D6478BD642F)) | U(1)
    number = np.arange(M // rows, dtype=U)
    return (mixed((x * factors).sum(axis=2, dtype=U) + (number >> U(6))) & ~U(LOW) | number & U(LOW)).view(np.int64)


def at_least(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the likelihood's maximum is at ``similarity`` or above, for rows of registers.

    With u and v the sizes' shares, a register is greater, less or equal with probability u - vJ,
    v - uJ and J.  The log-likelihood is concave in J, so its slope at the point tells the side.
    """
    more, less = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    u = size_a / (size_a + size_b)
    v, j = 1 - u, similarity
    p, q = u - v * j, v - u * j
    possible = (p > 0) & (q > 0)  # else the sizes alone rule the similarity out
    slope = (M - more - less) / j - v * more / np.where(possible, p, 1) - u * less / np.where(possible, q, 1)
    return possible & (slope >= 0)


def sharp(sets: list[np.ndarray]) -> np.ndarray:
    """The two lowest bits of ``SHARP`` registers a set, four registers a byte.

    Registers that differ do so by hundreds of steps, so their low bits agree once in four times.
    """
    bits = (sketches(sets, SHARP) & 3).astype(np.uint8).reshape(len(sets), -1, 4)
    return bits[:, :, 0] | bits[:, :, 1] << 2 | bits[:, :, 2] << 4 | bits[:, :, 3] << 6


def sharply(a: np.ndarray, b: np.ndarray, similarity: float, errors: float = 5) -> np.ndarray:
    """Whether rows of sharp sketches allow the similarity: no more registers differ than ``errors`` standard errors above the mean."""
    x = a ^ b
    differ = np.bitwise_count((x | x >> np.uint8(1)) & np.uint8(0x55)).sum(axis=-1, dtype=np.int64)
    p = (1 - similarity) * 0.75
    return differ <= SHARP * p + errors * (SHARP * p * (1 - p)) ** 0.5
