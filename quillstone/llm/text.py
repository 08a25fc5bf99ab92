"""Words of Arrow text columns as flat arrays, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; texts are UTF-8 and null counts as empty.
Work goes in runs of rows of about CHUNK bytes, so memory doesn't follow the batch; one longer text is its own run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 1 << 64)


def give_back() -> None:
    """Returns freed memory to the system, which glibc does by itself only at the end of its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """run(batches) that gives its memory back when the task ends: workers are kept, and idle ones count beside the next stage."""

    @wraps(run)
    def tidied(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK + 1), base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have


class Words:
    """Of some rows: buf, the words' byte bounds, and bound[i]:bound[i+1], the words of row i."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool):
        self.buf = _LOWER[buf] if lower else buf
        self.off = off
        word = np.zeros(len(buf) + 2, np.int8)
        word[1:-1] = ~_SPACE[buf]
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = off[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(buf))])
        cuts = cuts[(word[cuts] == 1) & (word[cuts + 1] == 1)]  # two rows' words that touch
        if len(cuts):
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        self.start, self.end = start, end
        self.bound = np.searchsorted(start, off)

    def hashes(self) -> np.ndarray:
        """64 bits of each word, equal for equal words: a polynomial of mixed letters, shifted to a common origin."""
        n = len(self.buf)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters()[self.buf] * _power(_BASE, n)[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _power(_INV, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the rows' bounds in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + chunk, "right")) - 1)
        yield a, min(b, n)
        a = b


def chunks(batches, column: str = "text", lower: bool = True, chunk: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """(rows, their words) for every run of rows of every batch."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back
    for batch in batches:
        buf, off = utf8(batch.column(batch.schema.get_field_index(column)))
        for a, b in runs(off, chunk):
            yield batch.slice(a, b - a), Words(buf[off[a] : off[b]], off[a : b + 1] - off[a], lower)
