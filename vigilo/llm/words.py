"""Vectorised word tables of Arrow text columns.

A word is a run of bytes other than space and 0x09-0x0D (equal to the pattern
``[^\\x20\\x09-\\x0D]+`` on the characters).  Hashes are 64-bit, independent of
process, platform and batch borders, so they may be compared across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20            # bytes hashed at once
BATCH_BYTES = 4 << 20      # text bytes of one sub-batch (a longer document is a sub-batch of its own)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def _cached_powers() -> tuple[np.ndarray, np.ndarray]:
    return _make_powers(PIECE + 1)


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= PIECE + 1:
        power, inverse = _cached_powers()
        return power[:n], inverse[:n]
    return _make_powers(n)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset).copy()
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of a text column: byte ranges, document pointers, hashes."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_buffers(column)
        self.n_docs = len(self.offsets) - 1
        inside = ~_SPACE[self.data]
        n = len(self.data)
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        close = np.zeros(n + 1, bool)
        close[1:] = inside
        close[:n] &= ~inside
        border = self.offsets[:-1]
        border = border[border < n]
        begin[border] = inside[border]
        border = self.offsets[1:]
        border = border[border > 0]
        close[border] = inside[border - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(close)
        self.ptr = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.ptr)
        self._inside = inside

    def take(self, rows: np.ndarray) -> Words:
        """The words of some documents, without looking for them again."""
        out = object.__new__(Words)
        spans = [slice(a, b) for a, b in zip(self.offsets[rows].tolist(), self.offsets[rows + 1].tolist())]
        none = slice(0, 0)
        out.data = np.concatenate([self.data[x] for x in spans] or [self.data[none]])
        out._inside = np.concatenate([self._inside[x] for x in spans] or [self._inside[none]])
        out.n_docs, out.counts = len(rows), self.counts[rows]
        out.offsets, out.ptr = np.zeros(len(rows) + 1, np.int64), np.zeros(len(rows) + 1, np.int64)
        np.cumsum(self.offsets[rows + 1] - self.offsets[rows], out=out.offsets[1:])
        np.cumsum(out.counts, out=out.ptr[1:])
        word = np.arange(out.ptr[-1]) + np.repeat(self.ptr[rows] - out.ptr[:-1], out.counts)
        moved = np.repeat(out.offsets[:-1] - self.offsets[rows], out.counts)
        out.starts, out.ends = self.starts[word] + moved, self.ends[word] + moved
        return out

    @property
    def doc(self) -> np.ndarray:
        """Document index of every word."""
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(out)
        while i < n:
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + PIECE, "right")))
            seg = self.data[base:self.ends[j - 1]]
            power, inverse = _powers(len(seg) + 1)
            total = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(_TABLE[seg] * power[:len(seg)], out=total[1:])
            s = self.starts[i:j] - base
            out[i:j] = (total[self.ends[i:j] - base] - total[s]) * inverse[s]
            i = j
        return mix(out)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte-level 0/1 array in every document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_chars(self) -> np.ndarray:
        """Code points inside words, by document."""
        return self.per_doc(self._inside & ((self.data & 0xC0) != 0x80))

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


class Spans:
    """Hashes of word ranges [a, b) of a hash sequence, equal for equal sequences."""

    def __init__(self, hashes: np.ndarray):
        power, self.inverse = _powers(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[:len(hashes)], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def gram_positions(ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of every k-word window that lies in one document."""
    n = np.maximum(np.diff(ptr) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    return np.arange(first[-1]) - first[doc] + ptr[doc], doc


def sub_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` text bytes, so that temporaries stay bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
