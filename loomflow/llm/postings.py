"""Postings of windows as compact binary rows: what goes through a shuffle in place of a row for each window.

A blob lists occurrences (document, place) in order of both. Documents are named by
id and by a 32-bit tag of their text, so that rows which share an id stay apart.
Numbers are written as byte planes of differences, which the shuffle's compression
reduces to the bytes that carry information.
"""

from __future__ import annotations

import numpy as np

#: What a null id counts as: larger than any other.
NO_ID = np.int64(2**63 - 1)


def planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def pack(ids: np.ndarray, tags: np.ndarray, places: np.ndarray) -> bytes:
    """Occurrences sorted by document and place, as one blob."""
    n = len(ids)
    new = np.ones(n, dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    at = np.flatnonzero(new)
    step = np.diff(places.astype(np.int64), prepend=0)
    step[at] = places[at]
    counts = np.diff(np.append(at, n))
    head = np.array([n, len(at)], dtype="<u8").tobytes()
    return head + planes(np.diff(ids[at].view(np.uint64), prepend=np.uint64(0)), 8) + planes(tags[at].astype(np.uint64), 4) + planes(counts, 4) + planes(step, 4)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(blob)
    n, docs = (int(x) for x in np.frombuffer(data[:16], dtype="<u8"))
    data = data[16:]
    ids = np.cumsum(unplanes(data, docs, 8)).view(np.int64)
    tags = unplanes(data[docs * 8 :], docs, 4).astype(np.uint32)
    counts = unplanes(data[docs * 12 :], docs, 4).astype(np.int64)
    step = unplanes(data[docs * 16 :], n, 4).astype(np.int64)
    total = np.cumsum(step)
    at = np.cumsum(counts) - counts
    base = total[at] - step[at] if n else total[:0]
    return np.repeat(ids, counts), np.repeat(tags, counts), total - np.repeat(base, counts)
