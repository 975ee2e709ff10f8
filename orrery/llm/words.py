"""Vectorised words and word shingles of Arrow string batches.

All functions work on the UTF-8 bytes of whole texts.  A word's hash is a
64-bit polynomial over its bytes, taken from one prefix sum over the batch, so
that a batch costs a fixed number of numpy passes whatever its words are.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_PLACE = _RANDOM.integers(1, 2**63, 4096, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of `[^\x20\x09-\x0D]+`.
VISIBLE = np.ones(256, bool)
VISIBLE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = np.zeros(256, bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[0x80:] = True

_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3, on unsigned 64-bit arrays."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a reused worker gives back to the system what its task has freed."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of some systems has none
            trim(0)

    return own


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about ``limit`` bytes of text each; a longer text comes alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the index of each text's first word (one more entry at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def prefix_of(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of 64-bit symbols: one more entry than symbols."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of bytes."""
    return prefix_of(_LETTER[data])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [start, end); equal strings have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * _power(len(sums))[1][start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """Words of a batch of texts: ``data`` (bytes as compared), spans, ``first`` (a text's first word) and hashes."""

    def __init__(self, column: pa.Array, kind: np.ndarray, lower: bool = True):
        data, self.offsets = raw(column)
        self.data = LOWER[data] if lower else data
        self.start, self.end, self.first = spans(self.data, self.offsets, kind)
        self.hash = span_hash(prefix(self.data), self.start, self.end) if len(self.start) else np.zeros(0, U)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive word hashes (windows run over text ends; the caller drops those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, U)
    for j in range(size):
        out += words[j : j + n] * _PLACE[j % 4096]
    return mix(out)


def shingle_sets(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles; a text of fewer words than ``size`` has its whole sequence as one."""
    all_of = windows(words.hash, size)
    first = words.first
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(all_of[a : b - size + 1])
        else:
            yield windows(words.hash[a:b], b - a) if b > a else np.zeros(0, U)


def lists(counts: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    """List array whose i-th list has the next ``counts[i]`` of ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def blobs(counts: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary array whose i-th entry has the next ``counts[i]`` bytes of ``data``."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
