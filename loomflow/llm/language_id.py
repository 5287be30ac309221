"""Language identification by a byte convolutional network.

Filters of several widths over embedded bytes, max pooling over a window of fixed
length, and softmax; trained in numpy on windows drawn over the whole of all labelled texts. A text
is all of its windows, none left out; its languages' probabilities are the windows'
mean, weighted by the bytes in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm import arrays as A
from loomflow.llm.tables import fold

#: Bytes of a window; embedding size; filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
#: Windows of each language and of all in the sample, about; and of each language however many there are.
SAMPLE, SAMPLE_ALL, SAMPLE_LEAST = 3_200, 640_000, 16
UNKNOWN = "und"


class Network:
    """Weights of the network; widths share one matrix of the widest, zero outside a filter's own width."""

    def __init__(self, labels: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels = labels
        wide = max(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.concatenate([np.repeat((np.arange(wide) < w)[:, None], FILTERS, 1) for w in WIDTHS], axis=1)
        self.mask = np.repeat(self.mask, EMBED, axis=0).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.mask.shape[1], len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        wide = max(WIDTHS)
        e = self.embed[windows]  # windows, places, EMBED
        return np.lib.stride_tricks.sliding_window_view(e, wide, axis=1).transpose(0, 1, 3, 2).reshape(len(windows), -1, wide * EMBED)

    def forward(self, windows: np.ndarray):
        x = self._columns(windows)
        conv = x @ self.filters
        at = conv.argmax(axis=1)
        top = np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0] + self.bias
        hidden = np.maximum(top, 0)
        return x, at, hidden, _softmax(hidden @ self.out + self.out_bias)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of each window."""
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for k in range(0, len(windows), 256):
            conv = self._columns(windows[k : k + 256]) @ self.filters
            hidden = np.maximum(conv.max(axis=1) + self.bias, 0)
            out[k : k + 256] = _softmax(hidden @ self.out + self.out_bias)
        return out

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        m = {n: np.zeros_like(getattr(self, n)) for n in names}
        v = {n: np.zeros_like(getattr(self, n)) for n in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                x, at, hidden, p = self.forward(windows[rows])
                g = p.copy()
                g[np.arange(len(rows)), y[rows]] -= 1
                g /= len(rows)
                grad = {"out": hidden.T @ g, "out_bias": g.sum(0)}
                gh = (g @ self.out.T) * (hidden > 0)
                grad["bias"] = gh.sum(0)
                i = np.arange(len(rows))[:, None]
                picked = x[i, at]  # rows, filters, wide * EMBED
                grad["filters"] = np.einsum("rfd,rf->df", picked, gh) * self.mask
                ge = np.zeros_like(self.embed)
                for place in range(max(WIDTHS)):
                    d = slice(place * EMBED, (place + 1) * EMBED)
                    np.add.at(ge, windows[rows][i, at + place].ravel(), (gh[:, :, None] * self.filters[d].T[None]).reshape(-1, EMBED))
                ge[0] = 0
                grad["embed"] = ge
                step += 1
                for n in names:
                    m[n] = 0.9 * m[n] + 0.1 * grad[n]
                    v[n] = 0.999 * v[n] + 0.001 * grad[n] ** 2
                    setattr(self, n, getattr(self, n) - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(c: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a chunk's documents, padded with zeros; the document and the bytes of each."""
    size = np.diff(c.offsets)
    per = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(c)), per)
    at = (np.arange(len(doc)) - (np.cumsum(per) - per)[doc]) * WINDOW
    n = np.minimum(size[doc] - at, WINDOW)
    out = np.zeros((len(doc), WINDOW), dtype=np.uint8)
    row = np.repeat(np.arange(len(doc)), n)
    place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    out[row, place] = c.buf[(c.offsets[:-1][doc] + at)[row] + place]
    return out, doc, n


def fit(labelled: DataFrame) -> Network:
    """A network of all languages from (id, text, lang), on SAMPLE windows or so of each, drawn by hash from all windows of its texts."""
    size = F.octet_length("text")
    counts = labelled.groupBy("lang").agg(F.sum(F.ceil(size / WINDOW)).alias("n")).collect()
    labels = sorted(r["lang"] for r in counts)
    if not labels:
        return Network([UNKNOWN])
    most = max(SAMPLE_LEAST, min(SAMPLE, SAMPLE_ALL // len(labels)))
    share = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, most / max(r["n"], 1)) * 1_000_000) for r in counts], "lang string, share double")
    at = F.filter(F.sequence(F.lit(0), F.ceil(size / WINDOW).cast("int") - 1), lambda k: F.pmod(F.xxhash64("id", k), F.lit(1_000_000)) < F.col("share"))
    cut = F.transform(at, lambda k: F.substring(F.col("text").cast("binary"), k * WINDOW + 1, F.lit(WINDOW)))
    drawn = labelled.where(size > 0).join(F.broadcast(share), "lang").select("lang", F.explode(cut).alias("window"))
    rows = drawn.orderBy(F.xxhash64("window"), "window", "lang").limit(2 * most * len(labels)).collect()
    net = Network(labels)
    if rows:
        place = {x: k for k, x in enumerate(labels)}
        x = np.frombuffer(b"".join(bytes(r["window"]).ljust(WINDOW, b"\0") for r in rows), np.uint8).reshape(-1, WINDOW)
        net.train(x, np.array([place[r["lang"]] for r in rows], dtype=np.int64))
    return net


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1) -> DataFrame:
    """(id_col, held_out, lang_pred, score) of each whole text.

    Learns from texts and non-null languages of rows whose crc32(id as text) mod `folds`
    is not `held_fold`. A null text, and one without a letter, is `und` with score 0;
    so is everything if no row has a language. A null id is never learned from and counts
    as not held out. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.withColumn("held_out", F.coalesce(fold(F.col("id"), folds) == held_fold, F.lit(False)))
    net = fit(own.where(~F.col("held_out") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("id", "text", "lang"))
    shared = own.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        labels = np.array(net.labels, dtype=object)
        for b in batches:
            pred, score = np.full(b.num_rows, UNKNOWN, dtype=object), np.zeros(b.num_rows)
            for c in A.chunks(b.column(1)):
                x, doc, n = windows(c)
                total = np.zeros((len(c), len(labels)))
                np.add.at(total, doc, net.predict(x) * n[:, None])
                size = np.diff(c.offsets)
                mean = total / np.maximum(size, 1)[:, None]
                best = mean.argmax(axis=1)
                ok = _lettered(c)
                pred[c.rows] = np.where(ok, labels[best], UNKNOWN)
                score[c.rows] = np.where(ok & (labels[best] != UNKNOWN), np.clip(mean[np.arange(len(c)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score)], names=["id", "held_out", "lang_pred", "score"])

    return own.select("id", "text", "held_out").mapInArrow(run, "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def _lettered(c: A.Chunk) -> np.ndarray:
    """Which documents have a letter of any script."""
    plain = (c.buf | 0x20) - np.uint8(97) < 26
    seen = np.concatenate([[0], np.cumsum(plain)])
    out = seen[c.offsets[1:]] > seen[c.offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(x.isalpha() for x in c.buf[c.offsets[k] : c.offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out
