"""Ragged text in numpy: what Arrow batches of documents become inside a task.

A chunk holds whole documents only: their bytes end to end, and offsets. Words,
hashes and windows are then whole-array operations, bounded by the chunk's size
(one very long document is a chunk of its own).
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text in a chunk; temporaries are some 40 times this.
CHUNK_BYTES = 1 << 21

#: ASCII white space, the only word separator of the word contracts.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.default_rng(0x5EED)
#: Odd multipliers, one for each place in a window.
_PLACE = _RNG.integers(1, 2**63, size=(2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Chunk:
    """Whole documents: row numbers in their batch, bytes and offsets."""

    __slots__ = ("rows", "buf", "offsets")

    def __init__(self, rows: np.ndarray, buf: np.ndarray, offsets: np.ndarray):
        self.rows, self.buf, self.offsets = rows, buf, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The documents of a batch in order, as chunks of about `size` bytes."""
    buf, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Chunk(np.arange(first, last), buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def slices(b: pa.RecordBatch, at: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of about `size` bytes of the text in column `at`."""
    for c in chunks(b.column(at), size):
        yield b.slice(int(c.rows[0]), len(c))


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which what the task has freed goes back to the machine: Spark's workers live on, and those of a later stage would hold it beside their own."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run, none across documents, and the index of each document's first run."""
    n = len(is_word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    starts[inner] = is_word[inner]
    ends[inner - 1] = is_word[inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each run, from the first runs of all documents."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes, by which runs are told apart: XXH64, of a seed of its own."""
    return xxh64(buf, starts, ends, 0x5EED)


def window_hash(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each `length` consecutive word hashes (also those that span documents); two independent families."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    place, h = _PLACE[which], np.zeros(n, dtype=np.uint64)
    for k in range(length):
        h += words[k : k + n] * place[k % 64] + np.uint64(k // 64)
    return mix(h)


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Which runs have `length` runs of their document from there on, over all runs."""
    ok = np.zeros(first[-1], dtype=bool)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= length:
            ok[a : b - length + 1] = True
    return ok


def covered(hit: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n runs lie in a window of `length` that begins at a hit (hits are distinct)."""
    step = np.zeros(n + length + 1, dtype=np.int64)
    step[hit] += 1
    step[hit + length] -= 1
    return np.cumsum(step[:n]) > 0


def spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kept runs, each followed by one space, end to end; where each begins and ends there."""
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    sizes = ends - starts + 1
    new_end = np.cumsum(sizes)
    new_start = new_end - sizes
    total = int(new_end[-1]) if len(new_end) else 0
    take = np.arange(total) + np.repeat(starts - new_start, sizes)
    out = buf[np.minimum(take, len(buf) - 1)] if total else np.zeros(0, dtype=np.uint8)
    out[new_end - 1] = 0x20
    return out, new_start, new_end - 1


# XXH64 by its public specification; fixed values.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64_long(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of 64-bit integers, as Spark's xxhash64 of a long."""
    h = np.uint64((seed + int(_P5) + 8) % 2**64) ^ _round(np.zeros(len(values), np.uint64), values.view(np.uint64))
    return _avalanche(_rotl(h, 27) * _P1 + _P4)


#: Bytes from which a slice is hashed by itself, not beside the others.
ALONE = 512


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice of the buffer."""
    padded = np.concatenate([buf, np.zeros(32, dtype=np.uint8)])
    at8 = np.ndarray((len(buf) + 24,), dtype="<u8", buffer=padded.data, strides=(1,))
    at4 = np.ndarray((len(buf) + 28,), dtype="<u4", buffer=padded.data, strides=(1,))
    n = ends - starts
    h = np.full(len(starts), (seed + int(_P5)) % 2**64, dtype=np.uint64)
    pos, left = starts.copy(), n.copy()
    alone = np.flatnonzero(n >= ALONE)
    left[alone] = 0
    long = np.flatnonzero(left >= 32)
    if len(long):
        p, stripes = pos[long].copy(), n[long] // 32
        acc = [np.full(len(long), (seed + x) % 2**64, dtype=np.uint64) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        for k in range(int(stripes.max())):
            m = np.flatnonzero(stripes > k)
            for i in range(4):
                acc[i][m] = _round(acc[i][m], at8[p[m] + 8 * i])
            p[m] += 32
        hl = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for i in range(4):
            hl = (hl ^ _round(np.zeros(len(long), np.uint64), acc[i])) * _P1 + _P4
        h[long], pos[long] = hl, p
        left[long] = ends[long] - p
    h += n.astype(np.uint64)
    zero = np.zeros(1, np.uint64)
    while True:
        m = np.flatnonzero(left >= 8)
        if not len(m):
            break
        h[m] = _rotl(h[m] ^ _round(zero, at8[pos[m]]), 27) * _P1 + _P4
        pos[m] += 8
        left[m] -= 8
    m = np.flatnonzero(left >= 4)
    h[m] = _rotl(h[m] ^ at4[pos[m]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    pos[m] += 4
    left[m] -= 4
    for _ in range(3):
        m = np.flatnonzero(left >= 1)
        h[m] = _rotl(h[m] ^ padded[pos[m]].astype(np.uint64) * _P5, 11) * _P1
        pos[m] += 1
        left[m] -= 1
    h = _avalanche(h)
    for k in alone:
        h[k] = xxhash.xxh64_intdigest(padded[starts[k] : ends[k]].data, seed)
    return h
