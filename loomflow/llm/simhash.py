"""SimHash fingerprints, and their exact pairs within a Hamming radius by vantage-point trees.

A tree of vantage points deals all distinct fingerprints into shards: inside a node's
distance, or outside. A fingerprint outside but within the radius of the boundary is
also a query of the inner shard, so that each pair within the radius meets in one shard
at least (triangle bound). A node splits until the rows that its share of the sample
stands for, copies included, are under a shard's bound, so the tree grows with the
data. Within a shard the same tree goes on down to small leaves. Shards return spanning
edges only, so a dense group costs no more edges than it has members.

In a ball of fingerprints that all lie close together no point parts a node. Two that
differ in two bits have a neighbour in common, one bit from both, and any two of one
neighbour differ in two at most. So such nodes are linked by their 65 neighbours
each, which is linear; a shard that stays over its bound is dealt out by neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.llm import arrays as A
from loomflow.llm.components import components
from loomflow.llm.tables import fresh, parts, row_key, written

RADIUS, SHINGLE = 2, 3
#: Fingerprints of a shard at least and at most (about a share of all for each partition), and of a leaf within it.
SHARD_LEAST, SHARD_MOST, LEAF = 1 << 15, 1 << 19, 384
#: Fingerprints of the sample for each shard, and of the sample at most (8 bytes each).
SAMPLE, SAMPLE_MOST = 256, 1 << 22
#: A node stays whole if its better half would still have this share of its rows.
WHOLE = 0.9
#: Fingerprints from which a node that no point parts is linked by neighbours; neighbours that are sorted at once.
DENSE, SORTED = 4096, 1 << 22

LANES = np.uint64(0x0101010101010101)


def fingerprint_chunk(c: A.Chunk, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each document of a chunk, as unsigned 64-bit integers."""
    s, e, first = A.word_bounds(~A.SPACE[c.buf], c.offsets)
    out = np.zeros(len(c), dtype=np.uint64)
    if not len(s):
        return out
    text, ws, we = A.spaced(A.LOWER[c.buf], s, e)
    words = np.diff(first)
    per_doc = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    doc = np.repeat(np.arange(len(c)), per_doc)
    begin = np.cumsum(per_doc) - per_doc
    lead = np.arange(len(doc)) - begin[doc] + first[:-1][doc]
    last = np.minimum(lead + shingle, first[1:][doc]) - 1
    h = A.xxh64(text, ws[lead], we[last])
    return _majority(h, begin, per_doc)


def _majority(h: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits set in over half of the hashes of each document: `size` of them from `begin` on, one document after another."""
    full = np.flatnonzero(size)
    if not len(full):
        return np.zeros(len(size), dtype=np.uint64)
    # Sums of each bit over runs of 255 hashes at most, in eight one-byte lanes at a time.
    per = -(-size[full] // 255)
    run_doc = np.repeat(full, per)
    runs = begin[run_doc] + 255 * (np.arange(len(run_doc)) - np.repeat(np.cumsum(per) - per, per))
    counts = np.zeros((len(size), 64), dtype=np.int64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & LANES, runs)
        np.add.at(counts[:, bit::8], run_doc, lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64))
    return np.packbits(counts * 2 > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint_chunk(c, shingle) for c in A.chunks(b.column(1))]
            fp = np.concatenate(got) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long; no words: zero."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(A.freed(_fingerprints(shingle)), "id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Vantage points; each node has its point, the distance within which a fingerprint is inside, and its two children. A negative child is a shard."""

    def __init__(self, sample: np.ndarray, rows: float = 1.0, bound: int = SHARD_LEAST, radius: int = RADIUS, seed: int = 7):
        """`rows` that each fingerprint of the sample stands for, and the bound of a shard."""
        rng = np.random.default_rng(seed)
        point, within, child = [], [], []
        self.shards = 0
        self.dense: list[int] = []  # shards over their bound
        stack = [(sample, -1, 0)]
        while stack:
            own, parent, side = stack.pop()
            at, large = -1, len(own) * rows > bound and len(own) > 8
            if large:
                p, d, cost = min((_vantage(own, rng, radius) for _ in range(4)), key=lambda x: x[2])
                if cost < WHOLE:
                    at = len(point)
                    point.append(p), within.append(d), child.append([0, 0])
                    far = distance(own, p).astype(np.int64)
                    stack += [(own[far <= d + radius], at, 0), (own[far > d], at, 1)]
            if at < 0:
                if large:
                    self.dense.append(self.shards)
                self.shards += 1
                at = -self.shards
            if parent >= 0:
                child[parent][side] = at
        self.point, self.within, self.child, self.radius = np.array(point, np.uint64), np.array(within, np.int64), np.array(child, np.int64).reshape(-1, 2), radius

    def deal(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard): the shard of each fingerprint, and each inner shard whose boundary it is within the radius of."""
        row, node = np.arange(len(fp)), np.full(len(fp), 0 if len(self.point) else -1, dtype=np.int64)
        done_row, done = [], []
        while len(row):
            out = node < 0
            done_row.append(row[out]), done.append(-node[out] - 1)
            row, node = row[~out], node[~out]
            over = distance(fp[row], self.point[node]).astype(np.int64) - self.within[node]
            near = (over > 0) & (over <= self.radius)
            row, node = np.concatenate([row, row[near]]), np.concatenate([self.child[node, (over > 0).astype(np.int64)], self.child[node[near], 0]])
        return np.concatenate(done_row or [row]), np.concatenate(done or [node])


def _vantage(own: np.ndarray, rng: np.random.Generator, radius: int = RADIUS) -> tuple[np.uint64, int, float]:
    """A point, the distance that halves `own` best, and the share of its rows in the larger half."""
    p = own[rng.integers(len(own))]
    d = distance(own, p).astype(np.int64)
    counts = np.bincount(d, minlength=65)
    inside = np.cumsum(counts)
    ahead = np.concatenate([inside[radius:], np.repeat(inside[-1], radius)])
    cost = np.maximum(ahead, inside[-1] - inside) / len(own)
    at = int(np.argmin(cost[:64]))
    return p, at, float(cost[at])


def spanning_edges(fp: np.ndarray, radius: int = RADIUS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that connect exactly what all such pairs connect, among distinct fingerprints."""
    rng = np.random.default_rng(seed)
    a, b = [], []
    stack = [np.arange(len(fp))]
    while stack:
        own = stack.pop()
        if len(own) > LEAF:
            p, at, cost = min((_vantage(fp[own], rng, radius) for _ in range(3)), key=lambda x: x[2])
            if cost < WHOLE:
                d = distance(fp[own], p).astype(np.int64)
                stack += [own[d <= at + radius], own[d > at]]
                continue
            if radius == 2 and len(own) > DENSE:
                u, v = _by_neighbours(fp[own])
                a.append(own[u]), b.append(own[v])
                continue
        for k in range(0, len(own), 1024):
            for j in range(k, len(own), 4096):
                x, y = own[k : k + 1024], own[j : j + 4096]
                i, m = np.nonzero(distance(fp[x][:, None], fp[y][None, :]) <= radius)
                keep = x[i] < y[m]
                if keep.any():
                    u, v = _forest(x[i[keep]], y[m[keep]])
                    a.append(u), b.append(v)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(a), np.concatenate(b))


NEIGHBOURS = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])


def _by_neighbours(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within two bits that connect all such pairs: those next to each other at a neighbour, a part of the neighbours at a time."""
    turns = np.uint64(-(-len(NEIGHBOURS) * len(fp) // SORTED))
    a, b = [], []
    for turn in range(int(turns)):
        near, row = [], []
        for bit in NEIGHBOURS:
            z = fp ^ bit
            own = np.flatnonzero((z * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % turns == turn)
            near.append(z[own]), row.append(own)
        z, at = np.concatenate(near), np.concatenate(row)
        order = np.argsort(z, kind="stable")
        z, at = z[order], at[order]
        same = z[1:] == z[:-1]
        u, v = _forest(at[:-1][same], at[1:][same])
        a.append(u), b.append(v)
    return _forest(np.concatenate(a), np.concatenate(b))


def neighbour_links(distinct: DataFrame) -> DataFrame:
    """(u, v): links of fingerprints within two bits that connect all such, dealt by neighbour, of each of which 65 fingerprints at most have a row."""
    bits = F.array(*[F.lit(int(x)) for x in NEIGHBOURS.astype(np.int64)])
    near = distinct.select("fp", F.explode(F.transform(bits, lambda b: F.col("fp").bitwiseXOR(b))).alias("z"))
    least = near.groupBy("z").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("z", "low")
    return near.join(least, "z").where("fp > low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges out of those given that connect the same nodes without a cycle: each part takes its first edge out, until none leads out."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = flat[: len(u)], flat[len(u) :]
    label, edge, taken = np.arange(len(nodes)), np.arange(len(u)), []
    while len(edge):
        a, b = label[x[edge]], label[y[edge]]
        out = a != b
        edge, a, b = edge[out], a[out], b[out]
        if not len(edge):
            break
        first = np.full(len(nodes), len(edge))
        np.minimum.at(first, a, np.arange(len(edge)))
        np.minimum.at(first, b, np.arange(len(edge)))
        pick = np.unique(first[first < len(edge)])
        taken.append(edge[pick])
        label = _joined(label, a[pick], b[pick])
    pick = np.concatenate(taken) if taken else edge
    return nodes[x[pick]], nodes[y[pick]]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the parts `a` and `b` have become one, each by the smallest of its parts."""
    to = np.arange(len(label))
    while True:
        low = np.minimum(to[a], to[b])
        new = to.copy()
        np.minimum.at(new, to[a], low)
        np.minimum.at(new, to[b], low)
        new = new[new]
        if (new == to).all():
            return to[label]
        to = new


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): spanning edges of the fingerprints (column fp, distinct) within the radius of each other."""
    n = distinct.count()
    bound = max(SHARD_LEAST, min(SHARD_MOST, n // parts(distinct.sparkSession)))
    sample = np.zeros(0, np.uint64)
    if n > bound:
        want = min(SAMPLE_MOST, max(SAMPLE * n // bound, 4096))
        part = distinct.sample(fraction=min(1.0, want / n), seed=11)  # the points only; every fingerprint is dealt out below
        sample = np.array(sorted(r[0] for r in part.collect()), dtype=np.int64).view(np.uint64)
    tree = Tree(sample, n / max(1, len(sample)), bound, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            row, shard = tree.deal(fp)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[row].view(np.int64))], names=["shard", "fp"])

    def pairs(t: pa.Table) -> pa.Table:
        fp = np.unique(t.column("fp").to_numpy().view(np.uint64))
        u, v = spanning_edges(fp, radius)
        return pa.table({"u": fp[u].view(np.int64), "v": fp[v].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(A.freed(deal), "shard long, fp long")
    if radius != 2 or not tree.dense:
        return dealt.groupBy("shard").applyInArrow(pairs, "u long, v long")
    dealt = written(dealt, "shards")
    over = F.col("shard").isin(tree.dense)
    return dealt.where(~over).groupBy("shard").applyInArrow(pairs, "u long, v long").unionByName(neighbour_links(dealt.where(over).select("fp").distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, component_id): the smallest id reachable by links of fingerprints that differ in `radius` bits or fewer.

    Every row is a document. Null and empty texts have fingerprint zero and are linked
    like any other. A null id keeps its fingerprint and gets its class's smallest id
    (null if the class has none). An empty table gives an empty result. Other columns
    are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    smallest = written(fps.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    label = components(links(smallest, radius))
    rooted = smallest.join(label, smallest.fp == label.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Members of an anchor's group up to which all meet all.
FEW = 16
#: Times that hubs of large groups are sought, before all that is left of a group meets all.
HUB_ROUNDS = 2
#: Shingles among which those that several texts have are counted at a time, the fewest such by which one comes late, and such shingles at most (8 bytes each, and as many for the count). They decide what is fast, not what is found.
ORDER_BLOCK, ORDER_LEAST, ORDER_MOST = 1 << 21, 3, 1 << 18
#: Postings of a partition; bits of the map of texts whose shingles are wanted.
POSTINGS, MAP_BITS = 1 << 19, 24
#: Bytes of text whose shingles are worked out together.
SHINGLE_BYTES = 1 << 19
#: Bits of a sketch at least, which are those that large groups are compared by.
SKETCH_BITS = 512
#: Members of a large group that are compared in one place, and rows of these that are taken against all at once.
MEET, MEET_ROWS = 4096, 256
#: Members of large groups in a partition, some 100 bytes each.
MEETING = 1 << 18


def _shingle_hashes(c: A.Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document) of each distinct shingle, in order of document and hash, and a hash of each document's words."""
    s, e, first = A.word_bounds(~A.SPACE[c.buf], c.offsets)
    words = np.diff(first)
    text, ws, we = A.spaced(A.LOWER[c.buf], s, e)
    whole = np.zeros(len(c), dtype=np.uint64)
    some = np.flatnonzero(words)
    if len(some):
        whole[some] = A.xxh64(text, ws[first[:-1][some]], we[first[1:][some] - 1])
    per = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    doc = np.repeat(np.arange(len(c)), per)
    lead = np.arange(len(doc)) - (np.cumsum(per) - per)[doc] + first[:-1][doc]
    last = np.minimum(lead + shingle, first[1:][doc]) - 1
    h = A.xxh64(text, ws[lead], we[last]) if len(doc) else np.zeros(0, np.uint64)
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new], whole


def _needed(n: np.ndarray, similarity: float) -> np.ndarray:
    """Anchors of sets of `n` shingles: any two sets alike by `similarity` share one of so many first ones, whatever order all sets keep."""
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def _rank(h: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How late each shingle comes: zero, or its count among the texts of the order."""
    if not len(common):
        return np.zeros(len(h), dtype=np.int64)
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return np.where(common[at] == h, count[at], 0)


def _sketches(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each document a bit for each place that the last bits of its shingles' hashes point to: whether an odd number do. So many places, a power of two, as shingles or more."""
    bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(bits)])
    odd = np.bincount(ends[doc] + (h & (bits[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(ends[-1])) & 1
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd.astype(np.uint8), bitorder="little"))])


def _folded(sketches: pa.Array, size: int) -> np.ndarray:
    """Sketches of equal length as rows of words, folded to `size` bytes: a shorter sketch is the parts of a longer one, added up without carry."""
    whole = np.frombuffer(b"".join(sketches.to_pylist()), "<u8").reshape(len(sketches), -1, size // 8)
    return np.bitwise_xor.reduce(whole, axis=1)


def _apart(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Bits in which sketches differ, pair by pair: at most the number of shingles that only one of the two texts has."""
    lengths = np.stack([pc.binary_length(x).to_numpy(), pc.binary_length(y).to_numpy()])
    out = np.zeros(len(x), dtype=np.int64)
    for both in np.unique(lengths, axis=1).T:
        at = np.flatnonzero((lengths == both[:, None]).all(axis=0))
        a, b = (_folded(z.take(pa.array(at)), int(both.min())) for z in (x, y))
        out[at] = np.bitwise_count(a ^ b).sum(axis=1)
    return out


def _most_apart(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles at most that only one of two texts of `n` and `m` shingles has if these are alike."""
    return (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _features(shingle: int, similarity: float, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in A.chunks(b.column(2), SHINGLE_BYTES):
                h, doc, whole = _shingle_hashes(c, shingle)
                at = np.searchsorted(doc, np.arange(len(c) + 1))
                n = np.diff(at)
                bits, sketches = _majority(h, at[:-1], n), _sketches(h, doc, n)
                h = h[np.lexsort((h, _rank(h, *order.value), doc))]
                few = _needed(n, similarity)
                ends = np.cumsum(few)
                anchors = h[np.arange(int(ends[-1])) + np.repeat(at[:-1] - (ends - few), few)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(anchors.view(np.int64)))
                own = b.slice(int(c.rows[0]), len(c))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(whole.view(np.int64)), pa.array(n), pa.array(bits.view(np.int64)), sketches, lists], names=["id", "row_key", "node", "n", "fp", "sketch", "anchors"])

    return run


def _counted(shingle: int):
    """Shingles that several texts of a block have, with the number of these."""

    def count(own: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(own), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[np.ndarray] = []
        for b in batches:
            for c in A.chunks(b.column(0), SHINGLE_BYTES):
                own.append(_shingle_hashes(c, shingle)[0])
                if sum(map(len, own)) >= ORDER_BLOCK:
                    yield count(own)
                    own = []
        if own:
            yield count(own)

    return run


def _order(own: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come late in every set, and their counts over all texts. Any order finds the same pairs; one that puts frequent shingles last proposes fewer in vain.

    What is frequent occurs twice in some block, so only what does is counted: a shingle that a
    fixed share of the texts has is found however large the table is, and groups of texts
    that share a rare one do not grow in proportion to it.
    """
    counts = written(own.select("text").mapInArrow(A.freed(_counted(shingle)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= ORDER_LEAST), "counts")
    least, total = ORDER_LEAST, 0
    for r in counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().orderBy(F.desc("n")).collect():
        total += r["count"]
        if total > ORDER_MOST:
            least = r["n"] + 1
            break
    got = counts.where(F.col("n") >= F.lit(least)).toPandas()
    h, count = got["h"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    by = np.argsort(h)
    return h[by], count[by]


def _beginning(key: str) -> Column:
    """The first bits of a row key, counted from one."""
    return F.conv(F.substring(F.hex(key), 1, MAP_BITS // 4), 16, 10).cast("long") + 1


def _map(keys: DataFrame, key: str) -> DataFrame:
    """(k, bits): which beginnings of row keys are among `keys`, 32,768 of them a row."""
    return keys.select(_beginning(key).alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))


def _wanted(keys: DataFrame) -> np.ndarray:
    """A map of fixed size: which beginnings of row keys are among `keys`."""
    out = np.zeros(1 << MAP_BITS, dtype=bool)
    for r in _map(keys, "row_key").collect():
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        out[(r["k"] - 1) * len(own) : r["k"] * len(own)] = own
    return np.packbits(out)


def among(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose row key may be among `keys`, and those whose is not, told by a map of fixed size and so without a shuffle of `rows`."""
    at, bucket, bits = fresh(rows, "at", "bucket", "bits")
    there = F.broadcast(written(_map(keys, key), "map").select(F.col("k").alias(bucket), F.col("bits").alias(bits)))
    marked = rows.withColumn(at, _beginning(key)).join(there, F.expr(f"bitmap_bucket_number(`{at}`)") == F.col(bucket), "left")
    place = F.expr(f"bitmap_bit_position(`{at}`)")
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    return marked.where(found).select(*rows.columns), marked.where(~found).select(*rows.columns)


def _wanted_rows(b: pa.RecordBatch, wanted) -> pa.RecordBatch:
    head = np.array([int.from_bytes(x[: MAP_BITS // 8], "big") for x in b.column(0).to_pylist()], dtype=np.int64)
    return b.filter(pa.array((wanted.value[head >> 3] >> (7 - (head & 7))) & 1 == 1))


def _shingle_sets(shingle: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = _wanted_rows(b, wanted)
            for c in A.chunks(b.column(1), SHINGLE_BYTES):
                h, doc, _ = _shingle_hashes(c, shingle)
                at = np.searchsorted(doc, np.arange(len(c) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(int(c.rows[0]), len(c)), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], names=["row_key", "shingles"])

    return run


def _of_nodes(own: DataFrame, keys: DataFrame, make, shingle: int, columns: str, what: str) -> DataFrame:
    """(node, columns) that `make` works out from the texts of `keys` (node, row_key)."""
    wanted = own.sparkSession.sparkContext.broadcast(_wanted(keys))
    got = own.select("row_key", "text").mapInArrow(A.freed(make(shingle, wanted)), f"row_key binary, {columns}")
    return written(got.join(keys, "row_key").dropDuplicates(["node"]).drop("row_key"), what)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, node); equal texts of a batch count once."""
    for b in batches:
        node = b.column(0).to_numpy()
        one = np.sort(np.unique(node, return_index=True)[1])
        lists = b.column(1).take(pa.array(one))
        yield pa.RecordBatch.from_arrays([lists.flatten(), pa.array(np.repeat(node[one], np.diff(lists.offsets.to_numpy())))], names=["anchor", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all postings of a partition's anchors, those of anchors that several texts have, with their number."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    anchor, node = (np.concatenate(x) for x in zip(*got))
    o = np.lexsort((node, anchor))
    anchor, node = anchor[o], node[o]
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (node[1:] != node[:-1])
    anchor, node = anchor[new], node[new]
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(anchor)))
    m = np.repeat(size, size)
    keep = m > 1
    anchor, node, m = anchor[keep], node[keep], m[keep]
    for k in range(0, len(anchor), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (anchor, node, m)], names=["anchor", "node", "m"])


def _anchored(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(anchor, node, n, fp, m): the texts at each anchor that m texts share, m over one."""
    total = rows.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0]
    dealt = rows.select("node", "anchors").mapInArrow(A.freed(_postings), "anchor long, node long").repartition(max(parts(rows.sparkSession), -(-total // POSTINGS)), "anchor")
    return written(dealt.mapInArrow(A.freed(_shared), "anchor long, node long, m long"), "postings").join(nodes, "node").select("anchor", "node", "n", "fp", "m")


def _within_reach(similarity: float) -> F.Column:
    """Whether a text and its head may be alike, by their sizes."""
    return F.least("n", "head.n") >= F.lit(similarity - 1e-9) * F.greatest("n", "head.n")


def _pair() -> list[F.Column]:
    return [F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")]


def _heads(post: DataFrame) -> DataFrame:
    """(anchor, head) of each large group: the member whose fingerprint is nearest to the majority of each bit, and one drawn by its hash, so that anchors of the same members have the same."""
    own, many = F.struct("node", "n", "fp"), post.where(F.col("m") > FEW)
    set_bits = [F.sum(F.getbit("fp", F.lit(k)).cast("long")).alias(f"bit{k}") for k in range(64)]
    ones = [F.when(2 * F.col(f"bit{k}") > F.col("m"), F.lit(np.uint64(1 << k).astype(np.int64).item())).otherwise(0) for k in range(64)]
    middle = many.groupBy("anchor").agg(F.first("m").alias("m"), *set_bits).select("anchor", reduce(lambda x, y: x.bitwiseOR(y), ones).alias("middle"))
    away = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    two = many.join(middle, "anchor").groupBy("anchor").agg(F.min_by(own, F.struct(away, "node")).alias("a"), F.min_by(own, F.struct(F.xxhash64("node"), "node")).alias("b"))
    return two.select("anchor", F.explode(F.array("a", "b")).alias("head"))


def _proposed(nodes: DataFrame, post: DataFrame, heads: DataFrame, similarity: float) -> DataFrame:
    """(u, v, bits): pairs of texts to be compared first.

    All pairs of an anchor's group of FEW members at most; of a larger one, its heads with
    all (the rest of it comes later, see _rest). The pairs of fingerprints that the vantage-point search finds are paired as they
    are, equal ones with the least node.
    """
    own, many = F.struct("node", "n", "fp"), post.where(F.col("m") > FEW)
    met = many.join(heads, "anchor").select("node", "n", "fp", "head")
    few = post.where(F.col("m") <= FEW).select("anchor", "node", "n", "fp")
    met = met.unionByName(few.join(few.select("anchor", own.alias("head")), "anchor").where("node < head.node").select("node", "n", "fp", "head"))
    near = met.where(_within_reach(similarity)).select("node", F.col("head.node").alias("other"), F.bit_count(F.col("fp").bitwiseXOR(F.col("head.fp"))).alias("bits"))
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    same = nodes.join(first, "fp").select("node", F.col("head").alias("other"), F.lit(0).alias("bits"))
    found = links(first.select("fp"))
    tree = found.join(first.select(F.col("fp").alias("u"), F.col("head").alias("node")), "u").join(first.select(F.col("fp").alias("v"), F.col("head").alias("other")), "v")
    tree = tree.select("node", "other", F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).alias("bits"))
    both = near.unionByName(same).unionByName(tree).where("node != other")
    return both.select(*_pair(), "bits").distinct()


def _hubs(post: DataFrame, found: DataFrame, label: DataFrame, tried: DataFrame) -> DataFrame:
    """(anchor, head) of each large group that has several classes: the member with the most links so far that was not a head yet."""
    degree = found.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    many = post.where(F.col("m") > FEW).join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = many.groupBy("anchor").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("anchor")
    left = many.join(degree, "node").join(tried, "node", "left_anti").join(mixed, "anchor", "left_semi")
    return left.groupBy("anchor").agg(F.max_by(F.struct("node", "n", "fp", "root"), F.struct("degree", "node")).alias("head"))


def _toward(post: DataFrame, hubs: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the hubs and the members of their groups that are of other classes."""
    many = post.join(hubs, "anchor").join(label, "node", "left").where((F.coalesce("root", "node") != F.col("head.root")) & _within_reach(similarity))
    return many.select("node", F.col("head.node").alias("other")).select(*_pair()).distinct()


def _meeting(similarity: float):
    """Pairs of a partition's groups (anchor, low, high) that are of different classes and can be alike by their sizes and sketches; of two parts of one group each of one with each of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        anchor, low, high, part, node, n, root = (t.column(x).to_numpy() for x in ("anchor", "low", "high", "part", "node", "n", "root"))
        o = np.lexsort((n, high, low, anchor))
        anchor, low, high, part, node, n, root = (x[o] for x in (anchor, low, high, part, node, n, root))
        words = _folded(t.column("sketch").combine_chunks(), SKETCH_BITS // 8)[o]
        begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        found = np.zeros((0, 2), dtype=np.int64)
        for k, end in zip(begin, np.append(begin[1:], len(node))):
            for x in range(k, end, MEET_ROWS):
                last = min(x + MEET_ROWS, end)
                # A smaller text with those after it, up to the largest that can be like it.
                stop = x + int(np.searchsorted(n[x:end], n[last - 1] / (similarity - 1e-9), side="right"))
                y = slice(x, min(stop, end))
                i, j = np.nonzero((root[x:last, None] != root[None, y]) & (np.arange(x, last)[:, None] < np.arange(y.start, y.stop)[None, :]))
                i, j = i + x, j + x
                if low[k] != high[k]:
                    across = part[i] != part[j]
                    i, j = i[across], j[across]
                near = n[i] >= (similarity - 1e-9) * n[j]
                i, j = i[near], j[near]
                apart = np.zeros(len(i), dtype=np.int64)
                for w in range(words.shape[1]):
                    apart += np.bitwise_count(words[i, w] ^ words[j, w])
                near = apart <= _most_apart(n[i], n[j], similarity)
                if near.any():
                    both = np.sort(np.stack([node[i[near]], node[j[near]]], axis=1), axis=1)
                    found = np.unique(np.concatenate([found, both]), axis=0)
            if len(found) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])
                found = found[:0]
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return run


def _folded_column(sketches: pa.Array) -> pa.Array:
    """Each sketch folded to SKETCH_BITS."""
    length = pc.binary_length(sketches).to_numpy()
    words = np.zeros((len(sketches), SKETCH_BITS // 64), dtype="<u8")
    for one in np.unique(length):
        at = np.flatnonzero(length == one)
        words[at] = _folded(sketches.take(pa.array(at)), SKETCH_BITS // 8)
    return pa.Array.from_buffers(pa.binary(), len(sketches), [None, pa.py_buffer((np.arange(len(sketches) + 1) * (SKETCH_BITS // 8)).astype(np.int32)), pa.py_buffer(words)])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), _folded_column(b.column("sketch"))], names=["node", "n", "sketch"])


def _rest(post: DataFrame, nodes: DataFrame, label: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs of a large group's members that are of different classes still, and can be alike by sizes and sketches.

    A group of over MEET members is dealt out by pairs of its parts. Pairs that can't be
    alike are told where the members meet, so that no row is made of them.
    """
    many = post.where(F.col("m") > FEW).join(label, "node", "left").select("anchor", "m", "node", F.coalesce("root", "node").alias("root"))
    mixed = many.groupBy("anchor").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("anchor")
    left = written(many.join(mixed, "anchor", "left_semi"), "mixed")
    sketches = nodes.select("node", "n", "sketch").mapInArrow(A.freed(_fold), "node long, n long, sketch binary")
    cuts = F.ceil(F.col("m") / F.lit(MEET)).cast("int")
    dealt = left.withColumn("part", F.pmod(F.xxhash64("node"), cuts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    dealt = dealt.select("anchor", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "root").join(sketches, "node")
    dealt = dealt.select("anchor", "low", "high", "part", "node", "n", "root", "sketch")
    count = max(parts(post.sparkSession), -(-left.count() // MEETING))
    return dealt.repartition(count, "anchor", "low", "high").mapInArrow(A.freed(_meeting(similarity)), "u long, v long").distinct()


def _near(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(x).to_numpy() for x in ("n", "m"))
            keep = _apart(b.column("x"), b.column("y")) <= _most_apart(n, m, similarity)
            yield b.select(["u", "v", "bits"]).filter(pa.array(keep))

    return run


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set the number of its shingles, and their first 16 bits, each once and in order: a quarter of the set."""
    for b in batches:
        sets = b.column(1)
        at = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        image, doc = (sets.flatten().to_numpy().view(np.uint64) >> np.uint64(48)).astype("<u2"), np.repeat(np.arange(len(b)), np.diff(at))
        new = np.ones(len(image), dtype=bool)
        new[1:] = (image[1:] != image[:-1]) | (doc[1:] != doc[:-1])
        ends = pa.py_buffer((2 * np.searchsorted(doc[new], np.arange(len(b) + 1))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(b), [None, ends, pa.py_buffer(image[new])])], names=["node", "n", "images"])


def _may_be_alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            for k, (n, m, x, y) in enumerate(zip(b.column("n").to_pylist(), b.column("m").to_pylist(), b.column("x"), b.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), "<u2"), np.frombuffer(y.as_buffer(), "<u2")
                most = len(np.intersect1d(x, y, assume_unique=True)) + min(n - len(x), m - len(y))
                keep[k] = most >= similarity * (n + m - most) - 1e-9
            yield b.select(["u", "v", "bits"]).filter(pa.array(keep))

    return run


def _with_ends(pairs: DataFrame, of: DataFrame, what: str) -> DataFrame:
    """The pairs with n and `what` of u, as n and x, and of v, as m and y."""
    both = pairs.join(of.select(F.col("node").alias("u"), "n", F.col(what).alias("x")), "u").join(of.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col(what).alias("y")), "v")
    return both.select("u", "v", "bits", "n", "m", "x", "y")


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v, bits) that can be alike by their sketches, which differ in no more bits than there are shingles that only one of the two has."""
    return written(_with_ends(pairs, nodes, "sketch").mapInArrow(A.freed(_near(similarity)), "u long, v long, bits int"), "likely")


def _close(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs that can be alike by their images: sets have no more shingles in common than images, and than images that stand for several."""
    images = sets.select("node", "shingles").mapInArrow(A.freed(_images), "node long, n long, images binary")
    return written(_with_ends(pairs, images, "images").mapInArrow(A.freed(_may_be_alike(similarity)), "u long, v long, bits int"), "close")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node"))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets of shingles are alike by `similarity` or more."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("u", "v")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, row_key, component): classes of texts whose sets of `shingle` words are alike by `similarity` or more.

    Sets that are alike share one of their first shingles in an order common to all, so
    the pairs that share one are all that there can be. SimHash fingerprints say which of
    them come first: each text's nearest pair, then the pairs that lead from one class
    found so far to another, then those of large groups' hubs, HUB_ROUNDS times, and at
    last all pairs of those groups that still lead from one class to another. Sketches of the
    sets, of one to two bits a shingle, and images of 16 bits a shingle say which of them can
    be alike at all, and the sets decide on those exactly, so classes are those of all links. Texts of equal words (A-Z lower-cased) are one node, by a
    64-bit hash. component is the class's smallest node; row_key identifies the row's id
    and text. Null and empty texts are one class; identical rows share a row_key. An empty
    table gives an empty result. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    context = own.sparkSession.sparkContext
    order = context.broadcast(_order(own, shingle))
    rows = written(own.mapInArrow(A.freed(_features(shingle, similarity, order)), f"id {kind}, row_key binary, node long, n long, fp long, sketch binary, anchors array<long>"), "features")
    nodes = written(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.min("row_key").alias("row_key")), "nodes")
    post = written(_anchored(rows, nodes.select("node", "n", "fp")), "anchors")
    heads = written(_heads(post), "heads")
    pairs = written(_proposed(nodes, post, heads, similarity), "pairs")
    def sets_of(likely: DataFrame) -> DataFrame:
        some = written(nodes.select("node", "row_key").join(_ends(likely).distinct(), "node", "left_semi"), "keys")
        return _of_nodes(own, some, _shingle_sets, shingle, "shingles array<long>", "shingles")

    def links_of(proposed: DataFrame) -> DataFrame:
        likely = _likely(proposed.withColumn("bits", F.lit(0)), nodes, similarity)
        if likely.isEmpty():
            return likely.select("u", "v")
        sets = sets_of(likely)
        return written(_alike(_close(likely, sets, similarity), sets, similarity), "links")

    pairs = _likely(pairs, nodes, similarity)
    sets = sets_of(pairs)
    each = pairs.select("u", "v", "bits", F.explode(F.array("u", "v")).alias("node"))
    nearest = each.groupBy("node").agg(F.min(F.struct("bits", "u", "v")).alias("x")).select("x.u", "x.v").distinct()
    found = written(_alike(nearest, sets, similarity), "links")
    label = components(found)
    at = lambda end: label.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    rest = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left").where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")
    more = written(_alike(rest, sets, similarity), "links")
    found = found.unionByName(more)
    label = label if more.isEmpty() else components(found)
    tried = heads.select("head.node")
    for _ in range(HUB_ROUNDS):
        hubs = written(_hubs(post, found, label, tried.distinct()), "hubs")
        if hubs.isEmpty():
            break
        more = links_of(_toward(post, hubs, label, similarity))
        tried = tried.unionByName(hubs.select("head.node"))
        if not more.isEmpty():
            found = found.unionByName(more)
            label = components(found)
    more = links_of(_rest(post, nodes, label, similarity))
    if not more.isEmpty():
        label = components(found.unionByName(more))
    return rows.select("id", "row_key", "node").join(label, "node", "left").select("id", "row_key", F.coalesce("root", "node").alias("component"))
