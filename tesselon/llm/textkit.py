"""Array kernels over Arrow text: words, word hashes and n-grams of a whole batch at once, with no Python loop over words.

A word is a maximal run of ASCII letters and digits and of bytes outside ASCII, after Unicode lower-casing. Hashes are
64-bit polynomials read off one running sum, (S[end] - S[start]) / B**start modulo 2**64, then scrambled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LONGEST_WORD = 1 << 16  # longer words are hashed one by one, in pieces
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
IS_WORD[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
        done += step
    return out


POW = _powers(BASE, BLOCK + LONGEST_WORD + 64)
INV = _powers(pow(BASE, -1, 1 << 64), BLOCK + LONGEST_WORD + 64)
GRAM = [U((0xD6E8FEB86659FD93 * (2 * k + 1) ^ (k << 40)) % (1 << 64) | 1) for k in range(64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def polynomial(data: np.ndarray) -> np.ndarray:
    """Of bytes of any number, as one value: pieces combined by their shift."""
    total = 0
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK].astype(U) + U(1)
        total += int((part * POW[: len(part)]).sum(dtype=U)) * pow(BASE, at, 1 << 64)
    return np.array([total % (1 << 64)], U)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null reads as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if big else np.int32, len(texts) + 1, texts.offset * (8 if big else 4)).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of parts of about ``most`` bytes, one row at least."""
    _, offsets = raw(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


class Words:
    """Words of a string array. start, end: byte positions; first: for each row the number of words before it."""

    def __init__(self, texts: pa.Array, lower: bool = True, prefixes: tuple[int, ...] = (), gaps: int = 0):  # gaps: at most 32
        self.data, self.offsets = raw(pc.utf8_lower(texts) if lower else texts)
        data, offsets = self.data, self.offsets
        self.rows = len(offsets) - 1
        inside = IS_WORD[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        opens[edge] |= inside[edge]
        closes[edge - 1] |= inside[edge - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)
        self.count = np.diff(self.first)
        self.hash = np.empty(len(start), U)
        self.prefix = {p: np.empty(len(start), U) for p in prefixes}
        # What follows a word, up to the next one or the text's end, as far as its first ``gaps`` bytes.
        self.gap = np.empty(len(start) if gaps else 0, U)
        after = np.append(start[1:], len(data))
        if gaps and len(start):
            after = np.minimum(after, np.minimum(end + gaps, offsets[1:][np.repeat(np.arange(self.rows), self.count)]))
        short = np.flatnonzero(end - start <= LONGEST_WORD)
        at = 0
        while at < len(short):
            base = start[short[at]]
            to = max(at + 1, int(np.searchsorted(end[short], base + BLOCK, "right")))
            these = slice(short[at], short[to - 1] + 1) if short[to - 1] - short[at] == to - 1 - at else short[at:to]
            part = data[base : end[short[to - 1]] + gaps].astype(U)
            part += U(1)
            sums = np.zeros(len(part) + 1, U)
            np.cumsum(part * POW[: len(part)], out=sums[1:])
            s, e = start[these] - base, end[these] - base
            low = sums[s]
            self.hash[these] = mix((sums[e] - low) * INV[s])
            for p, into in self.prefix.items():
                into[these] = mix((sums[np.minimum(e, s + p)] - low) * INV[s] + U(p))
            if gaps:
                self.gap[these] = mix((sums[after[these] - base] - sums[e]) * INV[e] + U(255))
            at = to
        for k in np.flatnonzero(end - start > LONGEST_WORD) if len(short) < len(start) else ():
            self.hash[k] = mix(polynomial(data[start[k] : end[k]]))[0]
            for p, into in self.prefix.items():
                into[k] = mix(polynomial(data[start[k] : start[k] + p]) + U(p))[0]
            if gaps:
                self.gap[k] = mix(polynomial(data[end[k] : after[k]]) + U(255))[0]

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.rows), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-grams in order, and for each row the number of n-grams before it."""
        return grams(self.hash, self.first, n)


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.maximum(np.diff(first) - n + 1, 0)
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(count, out=bounds[1:])
    if len(words) < n:
        return np.zeros(0, U), bounds
    total = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * GRAM[k]
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], count)
    return mix(total[at]), bounds


def pack(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary array of which item i holds the bytes of values[bounds[i]:bounds[i + 1]]."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(kind or pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((np.asarray(bounds, np.int64) * values.itemsize).tobytes()), pa.py_buffer(values)])


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """As pack, with 32-bit offsets, as Spark's BINARY expects. Callers cut what they send into batches far below 2 GB."""
    values = np.ascontiguousarray(values)
    if int(bounds[-1]) * values.itemsize >= 1 << 31:
        raise OverflowError("a batch of 2 GB; a single text is too long")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((np.asarray(bounds, np.int64) * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values)])


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part, and the bounds of each part in it."""
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    bounds = np.zeros(parts + 1, np.int64)
    np.cumsum(np.bincount(part, minlength=parts), out=bounds[1:])
    return order, bounds


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    if len(sorted_values) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; by sorting, which is several times as fast as NumPy's hashing of 64-bit values."""
    values = np.sort(values)
    return values[runs(values)[:-1]] if len(values) else values


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(start - before, count)
