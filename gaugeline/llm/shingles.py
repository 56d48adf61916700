"""Word shingles of whole texts as 64-bit hashes, many texts at a time.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case; a document's set holds the hashes of
its distinct shingles of ``width`` words, of its only sequence if it has fewer, and nothing if it has
no word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}
#: Bytes whose words are hashed at a time.
STEP = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(which: str, base: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        factors = np.full(max(n, 1 << 20), U(base))
        factors[0] = 1
        _powers[which] = np.cumprod(factors)
    return _powers[which][:n]


def forget() -> None:
    """Gives the powers back, which are as many as the longest text so far asked for."""
    _powers.update(up=np.ones(1, U), down=np.ones(1, U))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each word's hash, and where it starts and ends."""
    raw = _LOWER[raw] if lower else raw
    solid = ((raw - np.uint8(9)) > 4) & (raw != 32)
    n = len(raw)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if n else solid
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.concatenate([solid[1:], [False]]) if n else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    value = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        at = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, at + STEP, side="right")))
        part = raw[at : ends[b - 1]]
        total = np.zeros(len(part) + 1, U)
        np.add(part, U(1), out=total[1:])
        total[1:] *= _power("up", _BASE, len(part))
        np.cumsum(total, out=total)
        value[a:b] = (total[ends[a:b] - at] - total[starts[a:b] - at]) * _power("down", _BACK, len(part))[starts[a:b] - at]
        a = b
    value = mixed(value + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    return value, starts, ends


def laid_out(texts) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string array's bytes, and where each text begins and ends in them."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def with_digit(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether the words that begin there have a digit; between words there are only blanks."""
    return np.logical_or.reduceat((raw - np.uint8(48)) < 10, begins) if len(begins) else np.zeros(0, dtype=bool)


def shingle_sets(texts, width: int = 5):
    """Each text's sorted distinct shingle hashes; ``texts`` is an Arrow string array without nulls."""
    raw, offsets = laid_out(texts)
    words, starts, _ = word_hashes(raw, offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(counts)
    factors = [U(f) for f in mixed(np.arange(1, width + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)]
    many = max(len(words) - width + 1, 0)
    joined = np.zeros(many, U)
    for k, f in enumerate(factors):
        joined += words[k : k + many] * f
    joined = mixed(joined)
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= width:
            x = np.sort(joined[end - n : end - width + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif n:
            yield mixed(np.array([sum(int(w) * int(f) for w, f in zip(words[end - n : end], factors)) + n & (1 << 64) - 1], dtype=U))
        else:
            yield np.zeros(0, U)


def slices(column, most: int = 1 << 22):
    """A text column in parts of about ``most`` bytes, nulls made empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, side="right")))
        yield a, min(b, len(column)), column.slice(a, min(b, len(column)) - a)
        a = b
