"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A
text's set holds its distinct ``width``-word shingles; a text with fewer words
has its whole word sequence as one; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Bytes of text that are hashed at once.
SLICE = 1 << 18

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= SLICE + 1:
        if not _POWERS:
            _POWERS[0] = (_power_table(BASE, SLICE + 1), _power_table(BASE_INVERSE, SLICE + 1))
        return _POWERS[0]
    return _power_table(BASE, n), _power_table(BASE_INVERSE, n)


def text_slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) over runs of rows of about ``size`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MULTIPLIERS[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and where each text's words begin (one more entry than texts)."""
    data = LOWER[data]
    word = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    after = np.empty_like(word)
    if len(word):
        before[0], before[1:] = False, word[:-1]
        after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return spans_hash(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles."""
    factors = MULTIPLIERS[:width] if width <= 5 else _power_table(MULTIPLIERS[1], width)
    for _, _, data, offsets in text_slices(column):
        words, bounds = word_hashes(data, offsets)
        n = len(words) - width + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(width if n > 0 else 0):
            rolled += words[k : k + n] * factors[k]
        rolled = mix(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                own = np.sort(rolled[a : b - width + 1])
                if len(own) > 1:
                    fresh = np.empty(len(own), bool)
                    fresh[0] = True
                    np.not_equal(own[1:], own[:-1], out=fresh[1:])
                    own = own[fresh]
                yield own
            elif b > a:
                yield mix((words[a:b] * factors[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
