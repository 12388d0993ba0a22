"""Whole-text tokenisation over Arrow buffers, without a Python object per word.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z is lower-cased. A
word's 64-bit hash is a polynomial over its bytes, read off prefix sums, so a
block of texts takes a handful of numpy passes. Blocks hold ``BLOCK`` bytes at
most; a longer text is cut at white space into several, hence memory does not
depend on the longest text beyond its own bytes and word hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))[LOWER]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def blocks(data: np.ndarray, off: np.ndarray, size: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of runs of rows; a text beyond ``size`` is several blocks, cut before white space."""
    size = size or BLOCK
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        lo, hi = int(off[i]), int(off[j])
        while hi - lo > size:
            cut = np.flatnonzero(SPACE[data[lo + size : hi]][: size * 64])
            if not len(cut):
                break
            yield i, j, lo, lo + size + int(cut[0])
            lo = lo + size + int(cut[0])
        yield i, j, lo, hi
        i = j


def spans(data: np.ndarray, off: np.ndarray, i: int, j: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (from ``lo``) and row of each word of a block."""
    solid = ~SPACE[data[lo:hi]]
    first = np.zeros(hi - lo + 1, dtype=bool)
    edges = off[i : j + 1] - lo
    first[edges[(edges >= 0) & (edges <= hi - lo)]] = True
    first[0] = first[-1] = True
    before = np.empty(hi - lo, dtype=bool)
    if hi > lo:
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (first[:-1] | ~before))
    after = np.zeros(hi - lo, dtype=bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (first[1:] | ~after)) + 1
    rows = np.searchsorted(off[i : j + 1], starts + lo, side="right") - 1 + i
    return starts, ends, rows


def hash_spans(data: np.ndarray, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(hi - lo)
    with np.errstate(over="ignore"):
        v = _BYTE[data[lo:hi]] * up[: hi - lo]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slices(batch: pa.RecordBatch, column: int, size: int = 0) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about ``size`` bytes of text, so that word arrays stay small."""
    _, off = text_buffer(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + (size or BLOCK), side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def words(column: pa.Array, stem: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all rows, and each row's bounds in them; with ``stem``, of words cut to so many bytes."""
    data, off = text_buffer(column)
    out, counts = [], np.zeros(len(off), dtype=np.int64)
    for i, j, lo, hi in blocks(data, off):
        starts, ends, rows = spans(data, off, i, j, lo, hi)
        out.append(hash_spans(data, lo, hi, starts, ends if stem is None else np.minimum(ends, starts + stem)))
        counts[i + 1 : j + 1] += np.bincount(rows - i, minlength=j - i)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingles(hashes: np.ndarray, off: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each row's set of ``n``-word shingles, sorted; fewer words are one shingle, none give the empty set."""
    with np.errstate(over="ignore"):
        size = max(0, len(hashes) - n + 1)
        acc = np.zeros(size, dtype=np.uint64)
        for k in range(n):
            acc = mix(acc * _U(_BASE) + hashes[k : k + size])
        for a, b in zip(off[:-1], off[1:], strict=True):
            if b - a >= n:
                yield np.unique(acc[a : b - n + 1])
            elif b > a:
                h = np.zeros(1, dtype=np.uint64)
                for x in hashes[a:b]:
                    h = mix(h * _U(_BASE) + x)
                yield h ^ _U(b - a)
            else:
                yield np.zeros(0, dtype=np.uint64)


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with its memory released at the end of the task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
