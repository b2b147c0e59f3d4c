"""Arrow text columns as flat numpy arrays: word spans and hashes for a batch at once.

A batch's texts lie in one byte buffer.  Words, lines and n-grams are index arrays
into it, so nothing is done per word in Python.  Hashes are 64-bit; two different
strings of one corpus collide with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null rows are empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offs[0]:offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text; a longer row comes alone."""
    if batch.num_rows == 0:
        return
    _, offs = utf8(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(33))
    x = x * _C1
    x ^= x >> np.uint64(29)
    x *= _C2
    x ^= x >> np.uint64(32)
    return x


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK_BYTES:  # the table of one very long text isn't kept
            _powers[kind] = have
    return have[:n]


class Spans:
    """Polynomial prefix hashes of a byte buffer: the hash of any span in O(1)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n + 1)[:n],
                  out=self.prefix[1:])
        self.down = _power("down", _INVERSE, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * _C2)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): spans of ``[^\\x20\\x09-\\x0D]+``; row r's words are bounds[r]:bounds[r+1]."""
    inside = ~SPACE[data]
    return runs(inside.astype(np.uint8), offs)


def runs(kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero ``kind`` within a row."""
    n = len(kind)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offs] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(starts, offs)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each window of n words inside one row, in text order."""
    at = window_starts(bounds, n)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * _BASE + hashes[at + k]
    return mix(out), rows_of(bounds)[at]


def window_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """First word of each window of n words that lies in one row."""
    last = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(bounds[-1])
    return at[at + n <= last]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(any, later): keys that occur twice or more, and those after their first occurrence."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    every = later.copy()
    every[order[:-1]] |= same
    return every, later


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if give_back is not None:
        give_back(0)
