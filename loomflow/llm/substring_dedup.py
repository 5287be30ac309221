"""Substring deduplication by level-wise doubling.

Windows of a short first length that occur in one document alone are dropped; those
repeated in another document are extended to twice that length (the last step ends at
the wanted length), until the wanted length is reached or nothing survives. A longer
window is a candidate only where the two shorter ones that make it up both survive,
so each level shuffles what the level before left over.

Each task sends a window once for the many documents it has read (a passage in a
third of all documents is one entry for each block of some millions of words), as
packed postings; answers go back to shards of documents, which meet their text once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm import arrays as A
from loomflow.llm.postings import NO_ID, pack, unpack

LENGTH, FIRST = 13, 7
#: Windows that a task gathers before it sends them, windows of a bucket and bytes of text of a shard.
GATHER, BUCKET_WINDOWS, SHARD_BYTES = 1 << 20, 1 << 20, 6 << 20

SENT = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary())])
SENT_DDL = "dest int, kind int, docs binary, hashes binary"
FOUND = pa.schema([("shard", pa.int32()), ("docs", pa.binary())])
FOUND_DDL = "shard int, docs binary"
OWNED, KNOWN, SETTLED = 0, 1, 2


def lengths(first: int, length: int) -> list[int]:
    """The lengths of the levels: each twice the one before, the last as wanted."""
    out = [min(first, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _split(dest: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each destination, in order."""
    order = np.argsort(dest, kind="stable")
    at = np.flatnonzero(np.diff(dest[order], prepend=-1))
    for a, b in zip(at, np.append(at[1:], len(order))):
        yield int(dest[order[a]]), order[a:b]


def _shard(ids: np.ndarray, shards: int) -> np.ndarray:
    return A.xxh64_long(ids).view(np.int64) % shards


class _Gather:
    """Windows of some documents, resolved among themselves as far as possible before they are sent."""

    def __init__(self, last: bool, buckets: int, shards: int, width: int):
        self.last, self.buckets, self.shards, self.width = last, buckets, shards, width
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, h: np.ndarray, bucket: np.ndarray, ids: np.ndarray, tags: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.width < 8:
            h = h & np.uint64((1 << 8 * self.width) - 1)
        self.held.append((h, bucket.astype(np.int32), ids, tags, places.astype(np.int32)))
        self.n += len(h)
        if self.n >= GATHER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        h, bucket, ids, tags, places = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        o = _order(bucket, h, ids)
        h, bucket, ids, tags, places = h[o], bucket[o], ids[o], tags[o], places[o]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        end = np.append(at[1:], len(h)) - 1
        if self.last:
            hit = ids != ids[at][group]
            owned = ~hit
        else:
            many = ids[at] != ids[end]
            hit = many[group]
            owned = ~hit
        out: list[tuple[int, int, bytes | None, bytes | None]] = []
        self._owned(out, h[owned], bucket[owned], ids[owned], tags[owned], places[owned])
        if not self.last:
            known = at[many]
            for d, rows in _split(bucket[known]):
                out.append((d, KNOWN, None, h[known[rows]].view(np.uint8).reshape(-1, 8)[:, : self.width].tobytes()))
        out += [(shard % self.buckets, SETTLED, blob, np.int32(shard).tobytes()) for shard, blob in _by_shard(ids[hit], tags[hit], places[hit], self.shards)]
        for k in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out[k : k + 256]), SENT)], schema=SENT)

    def _owned(self, out: list, h: np.ndarray, bucket: np.ndarray, ids: np.ndarray, tags: np.ndarray, places: np.ndarray) -> None:
        o = _order(bucket, ids, tags, places)
        h, bucket, ids, tags, places = h[o], bucket[o], ids[o], tags[o], places[o]
        for d, rows in _split(bucket):
            a, b = rows[0], rows[-1] + 1
            out.append((d, OWNED, pack(ids[a:b], tags[a:b], places[a:b]), h[a:b].view(np.uint8).reshape(-1, 8)[:, : self.width].tobytes()))


def _by_shard(ids: np.ndarray, tags: np.ndarray, places: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    if not len(ids):
        return
    shard = _shard(ids, shards)
    o = _order(shard, ids, tags, places)
    shard, ids, tags, places = shard[o], ids[o], tags[o], places[o]
    for d, rows in _split(shard):
        a, b = rows[0], rows[-1] + 1
        yield d, pack(ids[a:b], tags[a:b], places[a:b])


def _first_level(length: int, last: bool, buckets: int, shards: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(last, buckets, shards, width)
        for batch in batches:
            all_ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            for c in A.chunks(batch.column(1)):
                s, e, first = A.word_bounds(~A.SPACE[c.buf], c.offsets)
                if len(s) < length:
                    continue
                w = A.word_hash(c.buf, s, e)
                ok = np.flatnonzero(A.window_starts(first, length))
                h, b = A.window_hash(w, length, 0)[ok], A.window_hash(w, length, 1)[ok] % np.uint64(buckets)
                doc = A.doc_of(first)[ok]
                yield from gather.add(h, b, all_ids[c.rows][doc], _tags(c)[doc], ok - first[doc])
        yield from gather.flush()

    return run


def _tags(c: A.Chunk) -> np.ndarray:
    """A 32-bit tag of each document's text."""
    return (A.word_hash(c.buf, c.offsets[:-1], c.offsets[1:]) >> np.uint64(32)).astype(np.uint32)


def _match(last: bool, shards: int, width: int):
    """All windows of a bucket: which of them other documents have too (at the last level: documents of smaller id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ids, tags, places, known, settled = [], [], [], [], [], []
        for batch in batches:
            for kind, docs, data in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if kind == SETTLED:
                    settled.append((int(np.frombuffer(data.as_py(), np.int32)[0]), docs.as_py()))
                    if len(settled) >= 256:
                        yield _found(settled)
                        settled = []
                    continue
                raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, width)
                h = np.zeros((len(raw), 8), dtype=np.uint8)
                h[:, :width] = raw
                h = h.view("<u8").ravel()
                if kind == KNOWN:
                    known.append(h)
                else:
                    i, t, p = unpack(docs.as_py())
                    hashes.append(h), ids.append(i), tags.append(t), places.append(p.astype(np.int32))
        if settled:
            yield _found(settled)
        if not hashes:
            return
        h, i, t, p = np.concatenate(hashes), np.concatenate(ids), np.concatenate(tags), np.concatenate(places)
        del hashes, ids, tags, places
        o = _order(h, i)
        h, i = h[o], i[o]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        if last:
            hit = i != i[at][group]
        else:
            many = i[at] != i[np.append(at[1:], len(h)) - 1]
            if known:
                many |= np.isin(h[at], np.concatenate(known))
            hit = many[group]
        out = list(_by_shard(i[hit], t[o][hit], p[o][hit], shards))
        for k in range(0, len(out), 256):
            yield _found(out[k : k + 256])

    return run


def _found(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), FOUND)], schema=FOUND)


class _Hits:
    """Places found in the documents of a shard."""

    def __init__(self, table: pa.Table):
        got = [unpack(x.as_py()) for x in table.column("docs")]
        if got:
            i, t, p = (np.concatenate(x) for x in zip(*got))
            o = _order(i, t, p)
            self.i, self.t, self.p = i[o], t[o], p[o]
            new = np.ones(len(o), dtype=bool)
            new[1:] = (self.i[1:] != self.i[:-1]) | (self.t[1:] != self.t[:-1])
            at = np.flatnonzero(new)
            self.at = {(int(self.i[a]), int(self.t[a])): (a, b) for a, b in zip(at, np.append(at[1:], len(o)))}
        else:
            self.at = {}

    def of(self, doc_id: int, tag: int) -> np.ndarray:
        a, b = self.at.get((doc_id, tag), (0, 0))
        return np.unique(self.p[a:b]) if b > a else np.zeros(0, dtype=np.int64)


def _extend(before: int, length: int, last: bool, buckets: int, shards: int, width: int):
    """Candidates of the next level in a shard's documents, sent to their buckets."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        hits, gather = _Hits(found), _Gather(last, buckets, shards, width)
        out: list[pa.RecordBatch] = []
        if hits.at and docs.num_rows:
            ids = docs.column("id").combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            for c in A.chunks(docs.column("text")):
                s, e, first = A.word_bounds(~A.SPACE[c.buf], c.offsets)
                if len(s) < length:
                    continue
                tags = _tags(c)
                alive = np.zeros(len(s), dtype=bool)
                for k, (row, a) in enumerate(zip(c.rows, first[:-1])):
                    alive[a + hits.of(int(ids[row]), int(tags[k]))] = True
                both = alive.copy()
                step = length - before
                both[: len(s) - step] &= alive[step:]
                both[len(s) - step :] = False
                ok = np.flatnonzero(both & A.window_starts(first, length))
                if not len(ok):
                    continue
                w = A.word_hash(c.buf, s, e)
                doc = A.doc_of(first)[ok]
                h, b = A.window_hash(w, length, 0)[ok], A.window_hash(w, length, 1)[ok] % np.uint64(buckets)
                out += gather.add(h, b, ids[c.rows][doc], tags[doc], ok - first[doc])
        out += gather.flush()
        return pa.Table.from_batches(out, schema=SENT)

    return run


def _finish(length: int):
    """Texts without the words that hit windows cover."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        hits = _Hits(found)
        ids = docs.column("id").combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        n_words, n_removed, kept = [], [], []
        for c in A.chunks(docs.column("text")):
            s, e, first = A.word_bounds(~A.SPACE[c.buf], c.offsets)
            tags, gone = _tags(c), np.zeros(len(s), dtype=bool)
            for k, (row, a, b) in enumerate(zip(c.rows, first[:-1], first[1:])):
                at = hits.of(int(ids[row]), int(tags[k]))
                if len(at):
                    gone[a:b] = A.covered(at, length, b - a)
            stay = ~gone
            out, ks, ke = A.spaced(c.buf, s, e, stay)
            seen = np.concatenate([[0], np.cumsum(stay)])
            raw = out.tobytes()
            for a, b in zip(first[:-1], first[1:]):
                i, j = seen[a], seen[b]
                n_words.append(int(b - a)), n_removed.append(int(b - a - (j - i)))
                kept.append(raw[ks[i] : ke[j - 1]] if j > i else b"")
        return pa.table({
            "id": docs.column("id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, first: int = FIRST, texts: bool = True) -> DataFrame:
    """Words of each document without those in a `length`-word window that also starts in a document of smaller id.

    Returns `id_col`, n_words, n_removed, kept_sha256 and, if `texts`, kept_text (kept words
    joined by one space). Null and empty texts have no words and keep the hash of nothing.
    A null id counts as larger than every other. Rows that share an id don't remove
    from each other; identical rows get the same result each. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    buckets = max(12, -(-total // (6 * BUCKET_WINDOWS)))
    levels = lengths(first, length)
    width = lambda k: 8 if k == len(levels) - 1 else 5  # noqa: E731  a false match of a lower level is found at the next
    by_shard = own.withColumn("shard", _shard_column(shards)).groupBy("shard")
    sent = own.mapInArrow(_first_level(levels[0], len(levels) == 1, buckets, shards, width(0)), SENT_DDL)
    for k, n in enumerate(levels):
        last = k == len(levels) - 1
        found = sent.repartitionById(buckets, F.col("dest")).mapInArrow(_match(last, shards, width(k)), FOUND_DDL).groupBy("shard")
        if not last:
            sent = by_shard.cogroup(found).applyInArrow(_extend(n, levels[k + 1], k + 1 == len(levels) - 1, buckets, shards, width(k + 1)), SENT_DDL)
    out = by_shard.cogroup(found).applyInArrow(_finish(length), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    kept = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts
    return out.select(F.col("id").alias(id_col), *kept)


def _shard_column(shards: int):
    """As _shard, of the column id."""
    return F.pmod(F.xxhash64(F.coalesce("id", F.lit(int(NO_ID)))), F.lit(shards)).cast("int")
