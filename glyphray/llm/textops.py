"""Words, hashes and shingle sets of whole batches of texts, as array operations on their UTF-8 bytes.

Texts are lower-cased in A-Z only; a word is a run of anything but ASCII white space. Bytes of one batch are worked on in
pieces of bounded size that end between words, so memory follows the piece, not the text (one word is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BYTES = stream(1, 256)[LOWER]
_COEFFICIENT = stream(2, SHINGLE * 2) | np.uint64(1)
_BASE = 0x9E6C63D0876A9A47
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE)
        rows = []
        for base in (_BASE, _UNBASE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            rows.append(np.multiply.accumulate(p))
        if n > PIECE:
            return rows[0], rows[1]
        _powers = rows[0], rows[1]
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs_of_texts(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive texts with about ``limit`` bytes together, at least one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for every text the index of its first word (one more at the end).

    ``blank`` says of every byte whether it separates words.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[offsets < len(data)]
    first[at] = inside[at]
    to = offsets[offsets > 0] - 1
    last[to] = inside[to]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span: a polynomial in random numbers per byte, by differences of running sums."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        piece = data[base:int(ends[j - 1])]
        power, inverse = powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTES[piece] * power[:len(piece)], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[b] - sums[a]) * inverse[a])
        i = j
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of every text, and their offsets by text.

    A text with fewer words, but at least one, gives its whole sequence as one.
    """
    count = np.diff(first)
    number = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(int(offsets[-1]), np.uint64)
    seed = stream(3, k + 1)
    if len(hashes) >= k:
        n = len(hashes) - k + 1
        rolled = np.full(n, seed[k], np.uint64)
        for t in range(k):
            rolled += hashes[t:t + n] * _COEFFICIENT[t]
        owner = np.repeat(np.arange(len(count)), count)
        out[np.repeat(count >= k, number)] = mix(rolled[owner[:n] == owner[k - 1:]])
    for m in range(1, k):
        short = np.flatnonzero(count == m)
        if len(short):
            total = np.full(len(short), seed[m], np.uint64)
            for t in range(m):
                total += hashes[first[short] + t] * _COEFFICIENT[t]
            out[offsets[short]] = mix(total)
    return out, offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every text, and their offsets."""
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        values[a:b].sort()
    if not len(values):
        return values, offsets
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(values)]] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[offsets]


def shingle_sets(
    column: pa.Array, k: int = SHINGLE, limit: int = PIECE
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts ``i..j`` of the column, of about ``limit`` bytes: their sets of shingles as sorted hashes, and offsets by text."""
    data, offsets = buffers(column)
    for i, j in runs_of_texts(offsets, limit):
        piece, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, ends, first = words(piece, at)
        yield i, j, *distinct(*shingles(hash_spans(piece, starts, ends), first, k))
