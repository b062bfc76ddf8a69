"""Vectorised hashing of words and word windows over Arrow string columns.

All functions work on one flat UTF-8 buffer with row offsets, so a batch of texts costs a few
numpy passes instead of a Python loop over words. Hashes are 64 bits wide and the same on
every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BYTE_BASE = _U(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = _U(0xC2B2AE3D27D4EB4F | 1)

#: ASCII white space: the words are `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: All that is neither an ASCII letter nor part of a multi-byte character.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[0x41:0x5B] = NOT_LETTER[0x61:0x7B] = NOT_LETTER[0x80:] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int, memo: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base^i and base^-i modulo 2^64 for i up to n; the longest table made so far is kept."""
    have = memo.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = _U(pow(int(base), -1, 1 << 64))
        made = []
        for b in (base, inverse):
            p = np.full(size, b, _U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = memo[base] = tuple(made)
        if size > 1 << 24:  # a single huge text: do not keep its table
            memo.pop(base)
    return have


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (int64, rows + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """The batch in runs of rows of about `most` text bytes; a longer text makes a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) if batch.num_rows else []
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)


class Words:
    """The words of a batch: start and end byte, row, and 64-bit hash of each; row offsets into them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE, table: np.ndarray | None = None):
        rows = len(offsets) - 1
        if table is not None:
            data = table[data]
        inside = ~gap[data]
        before = np.empty_like(inside)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            firsts = offsets[:-1][offsets[:-1] < len(data)]
            before[firsts] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
            lasts = offsets[1:-1]
            lasts = lasts[lasts > 0] - 1
            after[lasts] = False
        end = np.flatnonzero(inside & ~after) + 1
        self.data, self.start, self.end = data, start, end
        self.first = np.searchsorted(start, offsets)  # of each row, and one past the last
        self.rows = rows
        power, inverse = _powers(_BYTE_BASE, len(data))
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=sums[1:])
        self._sums, self._inverse = sums, inverse
        self.hash = self._between(start, end)

    def _between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(_U))

    def beginnings(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the first k bytes of the words `at`, unlike those of whole words."""
        return mix(self._between(self.start[at], self.start[at] + k) + _U(k))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self, at: np.ndarray | None = None) -> np.ndarray:
        rows = np.repeat(np.arange(self.rows), self.counts)
        return rows if at is None else rows[at]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of k words in one row, and the windows' hashes."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(n) + k <= last)
        power, inverse = _powers(_WORD_BASE, n)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.hash * power[:n], out=sums[1:])
        return at, mix((sums[at + k] - sums[at]) * inverse[at] + _U(k))

    def whole(self) -> np.ndarray:
        """A hash of each row's whole word sequence."""
        n = len(self.hash)
        power, inverse = _powers(_WORD_BASE, n)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.hash * power[:n], out=sums[1:])
        a, b = self.first[:-1], self.first[1:]
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(_U))
