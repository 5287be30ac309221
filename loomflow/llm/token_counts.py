"""Token counts of a word-end BPE vocabulary by rank-synchronous array merging.

Texts are cut into words and pre-tokens; those not met lately in the task are held together as
ragged numpy arrays of symbols, and in each round every sequence merges its own
lowest-rank pair, all sequences at once, until none has a mergeable pair. The number
of surviving symbols is kept for each word in a bounded table of the task.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a task remembers, and new ones merged together.
REMEMBERED, TOGETHER = 800_000, 20_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


#: No pair, as a rank; slots of the table of pairs.
NONE, SLOTS = 1 << 40, 1 << 19


def _home(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)


def _hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open table of the keys and of their positions."""
    key, slot = np.full(SLOTS, -1, dtype=np.int64), np.full(SLOTS, NONE, dtype=np.int64)
    for k, (x, at) in enumerate(zip(keys.tolist(), _home(keys).tolist())):
        while key[at] >= 0:
            at = (at + 1) % SLOTS
        key[at], slot[at] = x, k
    return key, slot


class Merges:
    """Symbols and ranked pairs of the vocabulary as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        key = left * (1 << 20) + right
        self.made = made
        self.key, self.slot = _hashed(key)
        letters = byte_letters()
        self.first = np.array([vocab.get(letters[b], -1) for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab.get(letters[b] + self.end, -1) for b in range(256)], dtype=np.int64)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of ordinary text, after the vocabulary's normalisation."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-cased letter by letter, without the final form
        return self.pieces.findall(text.lower())

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE."""
        want = a * (1 << 20) + b
        at = _home(want)
        out = self.slot[at]
        other = np.flatnonzero((self.key[at] != want) & (self.key[at] >= 0))
        out[self.key[at] != want] = NONE
        while len(other):
            at[other] = (at[other] + 1) % SLOTS
            found = self.key[at[other]]
            same = found == want[other]
            out[other[same]] = self.slot[at[other[same]]]
            other = other[~same & (found >= 0)]
        return out

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.last[flat[ends - 1]]
        seq = np.repeat(np.arange(len(words)), sizes)
        sym, seq = sym[sym >= 0], seq[sym >= 0]
        out = np.bincount(seq, minlength=len(words))
        rank = np.full(len(sym), NONE, dtype=np.int64)
        pair = np.flatnonzero(seq[:-1] == seq[1:])
        rank[pair] = self.find(sym[pair], sym[pair + 1])
        while len(sym) > 1:
            heads = np.flatnonzero(np.diff(seq, prepend=-1))
            low = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(seq))))
            live = low < NONE  # sequences without a pair are done
            idx = np.flatnonzero((rank == low) & live)
            if not len(idx):
                break
            # Of overlapping equal pairs (a a a), every second one from the left is merged.
            k = np.arange(len(idx))
            run = np.maximum.accumulate(np.where(np.diff(idx, prepend=-2) != 1, k, 0))
            idx = idx[(k - run) % 2 == 0]
            sym[idx] = self.made[rank[idx]]
            out -= np.bincount(seq[idx], minlength=len(words))
            stale = np.zeros(len(sym), dtype=bool)
            stale[idx] = True
            stale[np.maximum(idx - 1, 0)] = True
            # The symbol before a merged one may itself be merged into its left: its place is then gone, and the left one is stale already.
            live[idx + 1] = False
            sym, seq, rank, stale = sym[live], seq[live], rank[live], stale[live]
            at = np.flatnonzero(stale)
            rank[at] = NONE
            at = at[at + 1 < len(sym)]
            at = at[seq[at] == seq[at + 1]]
            rank[at] = self.find(sym[at], sym[at + 1])
        return out


class Counter:
    """Token counts of whole texts, by words between spaces and line ends; new pre-tokens are merged many at a time."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.merges, self.known, self.remembered = Merges(path), {}, remembered

    def counts(self, texts: list[str]) -> list[int]:
        out, waiting, size = [], [], 0
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            waiting.append(words)
            size += len(words)
            if size >= 200_000:
                out += self._settle(waiting)
                waiting, size = [], 0
        return out + self._settle(waiting)

    def _settle(self, waiting: list[list[str]]) -> list[int]:
        known = self.known
        new = set().union(*waiting).difference(known)
        if len(known) + len(new) > self.remembered:
            known.clear()
            new = set().union(*waiting)
        if new:
            self._learn(list(new))
        return [sum(map(known.__getitem__, words)) for words in waiting]

    def _learn(self, words: list[str]) -> None:
        m, flat, at = self.merges, [], []
        counts = [0] * len(words)
        for k, w in enumerate(words):
            if m.special and m.special.search(w):
                parts = m.special.split(w)
                counts[k] = len(parts) - 1
                pieces = [x for p in parts for x in m.pretokens(p)]
            else:
                pieces = m.pretokens(w)
            flat += pieces
            at += [k] * len(pieces)
        index = {p: k for k, p in enumerate(dict.fromkeys(flat))}
        pieces = list(index)
        each = np.zeros(len(pieces), dtype=np.int64)
        for k in range(0, len(pieces), TOGETHER):
            each[k : k + TOGETHER] = m.count([p.encode() for p in pieces[k : k + TOGETHER]])
        total = np.array(counts, dtype=np.int64)
        if flat:
            total += np.bincount(at, weights=each[np.fromiter((index[p] for p in flat), dtype=np.int64, count=len(flat))], minlength=len(words)).astype(np.int64)
        self.known.update(zip(words, total.tolist()))


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of each whole text, by the vocabulary file at `vocabulary`.

    Null counts as empty: no bytes, no tokens. Special strings inside a text count as one
    token each; none are added. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            _COUNTERS[vocabulary] = Counter(vocabulary)
        counter = _COUNTERS[vocabulary]
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            n = counter.counts(texts)
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
