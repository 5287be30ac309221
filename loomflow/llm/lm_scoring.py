"""Language-model scores of whole texts by context mixing over their tokens and the bytes of their words.

A token's probability is that of its class, a byte of its word's hash, given the words
before it (token_mixing), times that of the word within its class. The latter weighs
the word's corpus-wide count against its spelling (context_mixing); the strings that
were never counted are taken to be spread evenly over the classes, as hashes are.

Words are gathered in blocks of some millions, each distinct word once, and sent to
buckets by hash; a bucket counts its words and returns, for each block, what its
words' counts and probabilities are. A word in a third of all documents is one entry
a block. The model's counts come from all training words, the weights that mix contexts
from a step of Newton's method over all training tokens, whose sums tasks make; its
tables have a fixed size, and so has what the driver gets.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm import arrays as A
from loomflow.llm import context_mixing as M
from loomflow.llm import token_mixing as T
from loomflow.llm.postings import planes, unplanes
from loomflow.llm.tables import fold, fold_of, written

#: Words of a block, bytes of text of a bucket, words of a batch of the model, slots of a slice of its tables.
BLOCK_WORDS, BUCKET_BYTES, BATCH, SLICE = 1 << 20, 24 << 20, 1 << 13, 1 << 14
#: Distinct words of a task that trains the model, and such tasks at most.
TASK_WORDS, MODEL_TASKS = 200_000, 512
#: Bytes of a short word, and short words that are looked at together: beginnings that they share are worked out once.
SHORT, TOGETHER = 32, 1 << 15
#: The token that ends a text.
END_TOKEN = b"\n"
VOCAB, QUERY, POSTINGS = 0, 1, 2


def _join(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([b for b, _ in parts]), np.concatenate([s for _, s in parts])


def _take(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of some words, end to end."""
    ends = np.cumsum(sizes)
    return buf[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _closed(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The documents' words, each document's followed by the end."""
    return np.insert(words, first[1:], _END_HASH)


class _Block:
    """Documents whose distinct words are sent together."""

    def __init__(self):
        self.docs: list[tuple[np.ndarray, ...]] = []
        self.tokens: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray, null: np.ndarray, held: np.ndarray, c: A.Chunk) -> None:
        low = A.LOWER[c.buf]
        s, e, first = A.word_bounds(~A.SPACE[low], c.offsets)
        h = A.word_hash(low, s, e)
        back, u = pd.factorize(h)
        at = np.empty(len(u), dtype=np.int64)
        at[back[::-1]] = np.arange(len(h) - 1, -1, -1)
        sizes = (e - s)[at]
        self.docs.append((ids, null, held, np.diff(first), u, _take(low, s[at], sizes), sizes, back, np.diff(c.offsets)))
        self.tokens.append(_closed(h, first))
        self.n += len(s)

    def distinct(self):
        """(hash, bytes, sizes) of the distinct words, and for each document's words their index among them."""
        u, at, back = np.unique(np.concatenate([d[4] for d in self.docs]), return_index=True, return_inverse=True)
        buf, sizes = _join([(d[5], d[6]) for d in self.docs])
        starts = np.cumsum(sizes) - sizes
        base = np.cumsum([0] + [len(d[4]) for d in self.docs])
        index = np.concatenate([back[b : b + len(d[4])][d[7]] for b, d in zip(base, self.docs)])
        return u, _take(buf, starts[at], sizes[at]), sizes[at], index


def _packed(buf: np.ndarray, sizes: np.ndarray) -> bytes:
    return np.array([len(sizes)], "<u8").tobytes() + planes(sizes, 4) + buf.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = memoryview(blob)
    n = int(np.frombuffer(data[:8], "<u8")[0])
    return np.frombuffer(data[8 + 4 * n :], np.uint8), unplanes(data[8:], n, 4).astype(np.int64)


def _by_bucket(u: np.ndarray, buf: np.ndarray, sizes: np.ndarray, buckets: int):
    """(bucket, rows, packed words) of hashes in order."""
    bucket = (u % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.cumsum(sizes) - sizes
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(at, np.append(at[1:], len(order))):
        rows = order[a:b]
        yield int(bucket[rows[0]]), rows, _packed(_take(buf, starts[rows], sizes[rows]), sizes[rows])


_END_HASH = A.word_hash(np.frombuffer(END_TOKEN, np.uint8), np.array([0]), np.array([1]))[0]

#: Rows with a slice have counts of contexts, all others have words.
COUNTS = "dest int, words binary, counts binary, slice int"
_COUNTS = pa.schema([("dest", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("slice", pa.int32())])
VOCABULARY = "dest int, part int, words binary, counts binary, n_words long, n_tokens long, n_once long, slice int"
_VOCABULARY = pa.schema([("dest", pa.int32()), ("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_once", pa.int64()), ("slice", pa.int32())])


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)


def _count_words(buckets: int, parts: int, out_fold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table = _Block(), np.zeros((2, T.SLOTS), dtype=np.float32)
        for b in batches:
            ids, null, held = _ids(b, parts, out_fold)
            for c in A.chunks(b.column(1)):
                block.add(ids[c.rows], null[c.rows], held[c.rows], c)
                if block.n >= BLOCK_WORDS:
                    yield from sent(block, table)
                    block = _Block()
        yield from sent(block, table)
        for k in range(0, T.SLOTS, SLICE):
            part = table[:, k : k + SLICE]
            if part.any():
                yield _row(_COUNTS, k // SLICE % buckets, None, zlib.compress(part.tobytes(), 1), k // SLICE)

    def sent(block: _Block, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not block.docs:
            return
        own = np.concatenate([tokens[np.repeat(~held, words + 1)] for (_, _, held, words, *_), tokens in zip(block.docs, block.tokens)])
        T.count(own, _END_HASH, table)
        u, buf, sizes, index = block.distinct()
        held = np.repeat(np.concatenate([d[2] for d in block.docs]), np.concatenate([d[3] for d in block.docs]))
        n = np.bincount(index[~held], minlength=len(u))
        n_docs = int(sum((~d[2]).sum() for d in block.docs))
        keep = n > 0
        starts = np.cumsum(sizes) - sizes
        buf, u, sizes, n = _take(buf, starts[keep], sizes[keep]), u[keep], sizes[keep], n[keep]
        rows = [(k, blob, planes(n[at], 6)) for k, at, blob in _by_bucket(u, buf, sizes, buckets)]
        if n_docs:
            rows.append((int(_END_HASH % np.uint64(buckets)), _packed(np.frombuffer(END_TOKEN, np.uint8), np.array([1])), planes(np.array([n_docs]), 6)))
        for k in range(0, len(rows), 256):
            d, w, c = zip(*rows[k : k + 256])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((d, w, c, [None] * len(d)), _COUNTS)], schema=_COUNTS)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All distinct words of a bucket with their counts, in rows of bounded size and in order of hashes, and its slices of contexts."""
    parts, counts, dest = [], [], 0
    slices: dict[int, np.ndarray] = {}
    for b in batches:
        for d, w, c, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist()):
            if k is not None:
                got = np.frombuffer(zlib.decompress(c.as_py()), np.float32)
                slices[k] = slices[k] + got if k in slices else got.astype(np.float64)
                dest = d
                continue
            buf, sizes = _unpacked(w.as_py())
            parts.append((buf, sizes)), counts.append(unplanes(memoryview(c.as_py()), len(sizes), 6))
            dest = d
    for k, total in sorted(slices.items()):
        yield _row(_VOCABULARY, dest, -1, None, zlib.compress(total.astype(np.float32).tobytes(), 1), 0, 0, 0, k)
    if not parts:
        return
    buf, sizes = _join(parts)
    n = np.concatenate(counts).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    u, at, back = np.unique(A.word_hash(buf, starts, starts + sizes), return_index=True, return_inverse=True)
    total = np.bincount(back, weights=n).astype(np.int64)
    for k in range(0, len(u), 1 << 16):
        rows = at[k : k + (1 << 16)]
        c = total[k : k + (1 << 16)]
        blob = _packed(_take(buf, starts[rows], sizes[rows]), sizes[rows])
        yield _row(_VOCABULARY, dest, k >> 16, blob, planes(c, 6), len(c), int(c.sum()), int((c == 1).sum()), None)


def _ids(b: pa.RecordBatch, parts: int, out_fold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which are null, and which rows are held out (a null id is)."""
    null = np.asarray(b.column(0).is_null())
    ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    return ids, null, np.array([bool(n) or fold_of(int(i), parts) == out_fold for i, n in zip(ids, null)], dtype=bool)


def _model_batches(b: pa.RecordBatch) -> Iterator[tuple[M.Words, np.ndarray]]:
    for w, c in zip(b.column("words"), b.column("counts")):
        buf, sizes = _unpacked(w.as_py())
        n = unplanes(memoryview(c.as_py()), len(sizes), 6).astype(np.float64)
        starts = np.cumsum(sizes) - sizes
        for k in range(0, len(sizes), BATCH):
            yield M.Words(buf, starts[k : k + BATCH], sizes[k : k + BATCH]), n[k : k + BATCH]


def _together(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Words in batches: short ones of like beginnings together, long ones by their size."""
    head = np.zeros(len(sizes), dtype=np.uint64)
    for i in range(8):
        head <<= np.uint64(8)
        own = np.flatnonzero(sizes > i)
        head[own] += buf[starts[own] + i]
    order = np.lexsort((head, np.where(sizes > SHORT, sizes, 0)))
    short = int((sizes <= SHORT).sum())
    for lo, hi, n in ((0, short, TOGETHER), (short, len(order), BATCH)):
        for k in range(lo, hi, n):
            yield order[k : min(hi, k + n)]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros((2, M.SLOTS))
    for b in batches:
        for w, c in zip(b.column("words"), b.column("counts")):
            buf, sizes = _unpacked(w.as_py())
            n, starts = unplanes(memoryview(c.as_py()), len(sizes), 6).astype(np.float64), np.cumsum(sizes) - sizes
            for rows in _together(buf, starts, sizes):
                M.count(M.Words(buf, starts[rows], sizes[rows]), n[rows], table)
    table = table.astype(np.float32)
    for k in range(0, M.SLOTS, SLICE):
        part = table[:, k : k + SLICE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "counts"])


def _slice_sum(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column("counts"):
            got = np.frombuffer(zlib.decompress(x.as_py()), np.float32).astype(np.float64)
            total = got if total is None else total + got
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([zlib.compress(total.astype(np.float32).tobytes(), 1)], pa.binary())], names=["slice", "counts"])


class Model:
    """A trained model: tables of a fixed size and a mixer."""

    def __init__(self, table: np.ndarray, mixer: M.Mixer, tokens: T.Mixer, class_counts: np.ndarray, n_tokens: int, n_words: int, n_once: int):
        self.table, self.mixer, self.tokens, self.n_tokens, self.n_words = table, mixer, tokens, n_tokens, n_words
        #: The share of tokens that are known words, by the number of words seen once.
        self.known = min(0.999, max(0.001, 1 - n_once / n_tokens)) if n_tokens else 0.0
        #: The probability of each class where nothing is known of the words before.
        self.mass = (1 - self.known) / T.CLASSES + self.known * class_counts / max(1, n_tokens)

    def __getstate__(self):
        return self.__dict__ | {"table": zlib.compress(self.table.tobytes(), 1)}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.table = np.frombuffer(zlib.decompress(state["table"]), np.float32).reshape(2, -1)

    def log10(self, words: M.Words, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """log10 probability, within their classes, of words that occur so often in the training texts."""
        spelled = (1 - self.known) * 10.0 ** np.maximum(self.mixer.log10(words, self.table), -300)
        return np.log10(spelled + self.known * counts / max(1, self.n_tokens)) - np.log10(self.mass[T.classes(hashes)])


def _learned(learner):
    """The sums of a task's training texts, in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = T.Sums()
        for b in batches:
            for c in A.chunks(b.column(0)):
                low = A.LOWER[c.buf]
                s, e, first = A.word_bounds(~A.SPACE[low], c.offsets)
                learner.value.learn(_closed(A.word_hash(low, s, e), first), sums)
        vector = sums.vector()
        for k in range(0, len(vector), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([zlib.compress(vector[k : k + SLICE].tobytes(), 1)], pa.binary())], names=["slice", "sums"])

    return run


def _sums_sum(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for b in batches:
        for x in b.column("sums"):
            total = total + np.frombuffer(zlib.decompress(x.as_py()), np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slice", "sums"])


def mixed(texts: DataFrame, counted: np.ndarray) -> T.Mixer:
    """The mixer over tokens: from fixed weights a step of Newton's method over all tokens of `texts`, and the corrections that they call for."""
    learner = texts.sparkSession.sparkContext.broadcast(T.Learner(counted, _END_HASH, T.START))
    slices = texts.mapInArrow(_learned(learner), "slice long, sums binary").groupBy("slice").applyInArrow(_sums_sum, "slice long, sums binary").orderBy("slice").collect()
    learner.destroy()
    sums = T.Sums.of_vector(np.concatenate([np.frombuffer(r["sums"], np.float64) for r in slices])) if slices else T.Sums()
    return T.Mixer.of_sums(counted, _END_HASH, T.stepped(T.START, sums), sums)


def train(table_of_counts: DataFrame, texts: DataFrame) -> Model:
    """The model of a table of counts and of the training texts; the driver gets tables of a fixed size and one mixer from each task.

    Tasks get whole buckets in a fixed order, so the model does not depend on how files were dealt to tasks.
    """
    spark = table_of_counts.sparkSession
    vocabulary = table_of_counts.where("slice is null")
    counted = np.zeros((2, T.SLOTS), dtype=np.float32)
    for r in table_of_counts.where("slice is not null").select("slice", "counts").collect():
        part = np.frombuffer(zlib.decompress(r["counts"]), np.float32).reshape(2, -1)
        counted[:, r["slice"] * SLICE : r["slice"] * SLICE + part.shape[1]] = part
    tokens = mixed(texts, counted)
    n_words, n_tokens, n_once = vocabulary.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_once"), F.lit(0))).first()
    table = np.zeros((2, M.SLOTS), dtype=np.float32)
    tasks = max(1, min(MODEL_TASKS, n_words // TASK_WORDS))
    slices = vocabulary.coalesce(tasks).select("words", "counts").mapInArrow(_tables, "slice long, counts binary")
    for k, blob in slices.groupBy("slice").applyInArrow(_slice_sum, "slice long, counts binary").collect():
        part = np.frombuffer(zlib.decompress(blob), np.float32).reshape(2, -1)
        table[:, k : k + part.shape[1]] = part
    shared = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, k = M.Mixer(), 0
        table = np.frombuffer(zlib.decompress(shared.value), np.float32).reshape(2, -1)
        for b in batches:
            for words, n in _model_batches(b):
                mixer.learn(words, n, table, 0.01)
                k += 1
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((mixer.weights, mixer.seen, mixer.ones, mixer.mass))], pa.binary())], names=["mixer"])

    mixers = []
    dealt = vocabulary.repartitionById(tasks, F.col("dest") % tasks).sortWithinPartitions("dest", "part")
    for (blob,) in dealt.select("words", "counts").mapInArrow(learn, "mixer binary").collect():
        m = M.Mixer()
        m.weights, m.seen, m.ones, m.mass = pickle.loads(blob)
        mixers.append(m)
    shared.destroy()
    return Model(table, M.merged(mixers), tokens, T.class_counts(counted), int(n_tokens), int(n_words), int(n_once))


SENT = "dest int, kind int, block long, a binary, b binary"
_SENT = pa.schema([("dest", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
GOT = "block long, dest int, a binary, b binary"
_GOT = pa.schema([("block", pa.int64()), ("dest", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_OUT = "id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long"


def _ask(buckets: int, parts: int, out_fold: int, model):
    """Each block's distinct words to their buckets; its documents as lists of words, with what their tokens' classes score in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        block = _Block()
        for b in batches:
            ids, null, held = _ids(b, parts, out_fold)
            for c in A.chunks(b.column(1)):
                block.add(ids[c.rows], null[c.rows], held[c.rows], c)
                if block.n >= BLOCK_WORDS:
                    yield from sent(block, (task << 32) + seq)
                    block, seq = _Block(), seq + 1
        yield from sent(block, (task << 32) + seq)

    def sent(block: _Block, key: int) -> Iterator[pa.RecordBatch]:
        if not block.docs:
            return
        u, buf, sizes, index = block.distinct()
        place = np.empty(len(u), dtype=np.int64)
        rows, at = [], 0
        for k, own, blob in _by_bucket(u, buf, sizes, buckets):
            place[own] = np.arange(at, at + len(own))
            at += len(own)
            rows.append((k, QUERY, key, blob, None))
        words = np.concatenate([d[3] for d in block.docs])
        mixer = model.value.tokens
        classes = np.concatenate([np.add.reduceat(mixer.log10(t), np.cumsum(d[3] + 1) - (d[3] + 1)) for d, t in zip(block.docs, block.tokens)])
        doc = np.repeat(np.arange(len(words)), words)
        pair, tf = np.unique((doc << 32) + place[index], return_counts=True)
        doc, word = pair >> 32, pair & 0xFFFFFFFF
        new = np.diff(doc, prepend=-1) != 0
        step = np.diff(word, prepend=0)
        step[new] = word[new]
        head = {
            "ids": np.concatenate([d[0] for d in block.docs]), "null": np.concatenate([d[1] for d in block.docs]), "held": np.concatenate([d[2] for d in block.docs]),
            "words": words, "classes": classes, "bytes": np.concatenate([d[8] for d in block.docs]), "distinct": np.bincount(doc, minlength=len(words)),
        }
        rows.append((key % buckets, POSTINGS, key, pickle.dumps(head), planes(step, 4) + planes(tf, 4)))
        for k in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[k : k + 256]), _SENT)], schema=_SENT)

    return run


def _answer(model):
    """What each block's words are in a bucket: training counts and log10 probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, counts, asked = [], [], []
        dest = 0
        for b in batches:
            for d, kind, key, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4)):
                if kind == POSTINGS:
                    yield _got([(key, -1, x.as_py(), y.as_py())])
                    continue
                dest = d
                buf, sizes = _unpacked(x.as_py())
                if kind == VOCAB:
                    vocab.append((buf, sizes)), counts.append(unplanes(memoryview(y.as_py()), len(sizes), 6))
                else:
                    asked.append((key, buf, sizes))
        if not asked:
            return
        hashed = lambda buf, sizes: A.word_hash(buf, np.cumsum(sizes) - sizes, np.cumsum(sizes))
        known = hashed(*_join(vocab)) if vocab else np.zeros(0, np.uint64)
        n = np.concatenate(counts).astype(np.int64) if vocab else np.zeros(0, np.int64)
        order = np.argsort(known)
        known, n = known[order], n[order]
        buf, sizes = _join([(b, s) for _, b, s in asked])
        starts = np.cumsum(sizes) - sizes
        u, at, back = np.unique(A.word_hash(buf, starts, starts + sizes), return_index=True, return_inverse=True)
        where = np.minimum(np.searchsorted(known, u), max(0, len(known) - 1))
        c = np.where(known[where] == u, n[where], 0) if len(known) else np.zeros(len(u), np.int64)
        score = np.zeros(len(u))
        m = model.value
        for rows in _together(buf, starts[at], sizes[at]):
            score[rows] = m.log10(M.Words(buf, starts[at[rows]], sizes[at[rows]]), c[rows], u[rows])
        done = 0
        for key, _, s in asked:
            own = back[done : done + len(s)]
            done += len(s)
            yield _got([(key, dest, planes(c[own], 6), score[own].astype("<f4").tobytes())])

    return run


def _got(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _GOT)], schema=_GOT)


def _gathered(n_tokens: int, n_words: int, end_count: int, end_score: float):
    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.select(["dest", "a", "b"]).to_pylist(), key=lambda r: r["dest"])
        head, body = pickle.loads(rows[0]["a"]), memoryview(rows[0]["b"])
        c = np.concatenate([unplanes(memoryview(r["a"]), len(r["b"]) // 4, 6) for r in rows[1:]] or [np.zeros(0)]).astype(np.float64)
        s = np.concatenate([np.frombuffer(r["b"], "<f4") for r in rows[1:]] or [np.zeros(0)]).astype(np.float64)
        per = head["distinct"]
        n = int(per.sum())
        step, tf = unplanes(body, n, 4).astype(np.int64), unplanes(body[4 * n :], n, 4).astype(np.float64)
        doc = np.repeat(np.arange(len(per)), per)
        total = np.cumsum(step)
        at = np.cumsum(per) - per
        full = per > 0
        base = np.zeros(len(per), dtype=np.int64)
        base[full] = total[at[full]] - step[at[full]]
        word = total - base[doc]
        add = lambda x: np.bincount(doc, weights=x, minlength=len(per))
        tokens = head["words"] + 1
        known = add(tf * (c[word] > 0)) + (end_count > 0)
        bottom = np.log10(n_tokens + 0.5 * (n_words + 1))
        base_score = add(tf * np.log10(c[word] + 0.5)) + np.log10(end_count + 0.5) - tokens * bottom
        return pa.table({
            "id": pa.array(head["ids"], pa.int64(), mask=head["null"]), "held_out": pa.array(head["held"] & ~head["null"]), "n_tokens": pa.array(tokens.astype(np.int64)),
            "n_known": pa.array(known.astype(np.int64)), "base": pa.array(base_score), "score": pa.array(head["classes"] + add(tf * s[word]) + end_score),
            "n_bytes": pa.array(head["bytes"].astype(np.int64)),
        })

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits, bits_per_byte) of each whole text.

    Learns from the rows whose crc32(id as text) mod `folds` is not `held_fold`; a row of
    null id is scored, not learned from, and counts as not held out. Null and empty texts
    are the end token alone, and have no bits per byte. Without training rows all words are unknown. Sums depend on
    the order of addition in their last bits only. Other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(12, -(-total // BUCKET_BYTES))
    counted = own.mapInArrow(_count_words(buckets, folds, held_fold), COUNTS)
    vocabulary = written(counted.repartitionById(buckets, F.col("dest")).mapInArrow(_summed, VOCABULARY), "vocabulary")
    model = train(vocabulary, own.where(fold(F.col("id"), folds) != held_fold).select("text"))
    end = np.frombuffer(END_TOKEN, np.uint8)
    words = vocabulary.where("slice is null")
    end_row = words.where(F.col("dest") == int(_END_HASH % np.uint64(buckets))).select("words", "counts").mapInArrow(_end_count, "n long").agg(F.sum("n")).first()[0] or 0
    end_score = float(model.log10(M.Words(end, np.array([0]), np.array([1])), np.array([end_row]), np.array([_END_HASH]))[0])
    shared = spark.sparkContext.broadcast(model)
    asked = own.mapInArrow(_ask(buckets, folds, held_fold, shared), SENT)
    vocab = words.select("dest", F.lit(VOCAB).alias("kind"), F.lit(0).cast("long").alias("block"), F.col("words").alias("a"), F.col("counts").alias("b"))
    answers = asked.unionByName(vocab).repartitionById(buckets, F.col("dest")).mapInArrow(_answer(shared), GOT)
    out = answers.groupBy("block").applyInArrow(_gathered(model.n_tokens, model.n_words, int(end_row), end_score), _OUT)
    bits = F.col("score") * F.lit(-float(np.log2(10.0)))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", bits.alias("bits"), F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"))


def _end_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = 0
        for w, c in zip(b.column(0), b.column(1)):
            buf, sizes = _unpacked(w.as_py())
            starts = np.cumsum(sizes) - sizes
            n += int(unplanes(memoryview(c.as_py()), len(sizes), 6)[A.word_hash(buf, starts, starts + sizes) == _END_HASH].sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])
