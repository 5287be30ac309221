"""Quality rules as a short-circuit cascade.

Each rule's cost and the share it rejects are measured on a sample, inside tasks; the
rules then run in the order of rejections per cost, each on the documents that all
before it kept, with the features that are known of them by then. The verdict (no rule
rejects) does not depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomflow.llm import arrays as A

#: Documents of the sample on which costs and selectivities are estimated.
SAMPLE = 2000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
#: Bytes of letters, of any script.
_LETTERED = _LETTER.copy()
_LETTERED[0x80:] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b".,;:!?")] = True


class Texts:
    """A chunk whose features are worked out when first asked for."""

    def __init__(self, c: A.Chunk, got: dict[str, np.ndarray] | None = None):
        self.c, self._got = c, got or {}

    def subset(self, keep: np.ndarray) -> Texts:
        """Some of the documents, with what is known of each."""
        size = np.diff(self.c.offsets)
        c = A.Chunk(self.c.rows[keep], self.c.buf[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]))
        return Texts(c, {k: v[keep] for k, v in self._got.items() if isinstance(v, np.ndarray)})

    def __getattr__(self, name: str):
        got = self.__dict__["_got"]
        if name not in got:
            got[name] = getattr(Texts, f"find_{name}")(self)
        return got[name]

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[self.c.offsets])

    def find_words(self):
        return A.word_bounds(~A.SPACE[self.c.buf], self.c.offsets)

    def find_n_words(self):
        return np.diff(self.words[2])

    def find_word_chars(self):
        return self.per_doc(~A.SPACE[self.c.buf] & ((self.c.buf & 0xC0) != 0x80))

    def find_n_symbols(self):
        return self.per_doc(_SYMBOL[self.c.buf])

    def find_n_letters(self):
        return self.per_doc(_LETTER[self.c.buf])

    def find_n_upper(self):
        return self.per_doc(_UPPER[self.c.buf])

    def find_n_points(self):
        return self.per_doc(_POINT[self.c.buf])

    def find_n_lettered(self):
        """Words with a letter."""
        s, e, first = self.words
        seen = np.concatenate([[0], np.cumsum(_LETTERED[self.c.buf])])
        return np.diff(np.concatenate([[0], np.cumsum(seen[e] > seen[s])])[first])

    def find_lines(self):
        """(n_lines, n_dup_lines) of each document: lines with a word, and those of them equal to an earlier line."""
        c = self.c
        s, e, first = A.word_bounds(c.buf != 0x0A, c.offsets)
        inked = np.concatenate([[0], np.cumsum(~A.SPACE[c.buf])])
        full = inked[e] > inked[s]
        doc = A.doc_of(first)[full]
        h = A.word_hash(c.buf, s[full], e[full])
        o = np.lexsort((h, doc))
        same = np.zeros(len(o), dtype=bool)
        same[1:] = (h[o][1:] == h[o][:-1]) & (doc[o][1:] == doc[o][:-1])
        return np.bincount(doc, minlength=len(c)), np.bincount(doc[o][same], minlength=len(c))

    def find_n_lines(self):
        return self.lines[0]

    def find_n_dup_lines(self):
        return self.lines[1]

    def find_n_repeat_words(self, length: int = 5):
        """Words in 5-word windows found twice or more in their document."""
        s, e, first = self.words
        n = len(s)
        ok = np.flatnonzero(A.window_starts(first, length))
        if not len(ok):
            return np.zeros(len(self.c), dtype=np.int64)
        doc = A.doc_of(first)
        h = A.mix(A.window_hash(A.word_hash(self.c.buf, s, e), length)[ok] + A.mix(doc[ok].astype(np.uint64) + np.uint64(1)))
        o = np.argsort(h)
        same = h[o][1:] == h[o][:-1]
        twice = np.zeros(len(o), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        return np.bincount(doc[A.covered(ok[o[twice]], length, n)], minlength=len(self.c))


#: Each rule: which documents it rejects. Thresholds are parameters of the rules, not of the data.
RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    "few_words": lambda t: t.n_words < 10,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "word_length": lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words),
    "unlettered": lambda t: 5 * t.n_lettered < 4 * t.n_words,
    "punctuation": lambda t: t.n_points > t.n_words,
    "repeated_lines": lambda t: (t.n_dup_lines > 3) & (2 * t.n_dup_lines > t.n_lines),
    "shouting": lambda t: (t.n_letters > 20) & (10 * t.n_upper > 3 * t.n_letters),
}
#: The rules whose rejection is the contract's base_failed.
BASE = ("few_words", "repeated_words")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(docs: DataFrame, text_col: str, rules: dict[str, Callable], sample: int = SAMPLE) -> list[str]:
    """The rules by rejections per second on a sample of about `sample` documents, most first."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in A.chunks(b.column(0)):
                for name, rule in rules.items():
                    began = time.process_time()
                    rejected = int(np.sum(rule(Texts(c))))
                    yield pa.RecordBatch.from_pydict({"rule": [name], "cost": [time.process_time() - began], "rejected": [rejected]})

    n = docs.count()
    part = docs.select(F.col(text_col).alias("text")).sample(fraction=min(1.0, sample / max(1, n)), seed=5)
    got = part.mapInArrow(A.freed(measure), "rule string, cost double, rejected long").groupBy("rule").agg(F.sum("cost"), F.sum("rejected")).collect()
    rate = {r[0]: (r[2] + 1e-9) / (r[1] + 1e-6) for r in got}
    return sorted(rules, key=lambda name: (-rate.get(name, 0.0), name))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Callable] | None = None, features: bool = True, kept_col: str = "kept") -> DataFrame:
    """The columns of `docs` with `kept_col`, and with the features and base_failed if `features`.

    Null and empty texts have no words and fail few_words. A document is kept if no rule
    rejects it; repeated rows get the same verdict each. An empty table gives an empty
    result. Columns of `docs` that clash with an added one are replaced.
    """
    rules = RULES if rules is None else rules
    order = estimate(docs, text_col, rules)
    if features:  # these are known of every document by then
        order = sorted(order, key=lambda name: name not in BASE)
    added = [*FEATURES, "base_failed"] * features + [kept_col]
    own = docs.drop(*(x for x in added if x != text_col))
    at = own.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in A.chunks(b.column(at), A.CHUNK_BYTES // 2):
                n, first, now = len(c), int(c.rows[0]), Texts(c)
                kept, out = np.zeros(n, dtype=bool), {f: np.zeros(n, dtype=np.int64) for f in FEATURES}
                base = np.zeros(n, dtype=bool)
                if features:
                    for f in FEATURES:
                        out[f] = getattr(now, f)
                    base = np.any([rules[x](now) for x in BASE if x in rules] or [base], axis=0)
                for name in order:
                    keep = ~rules[name](now)
                    if not keep.all():
                        now = now.subset(keep)
                    if not len(now.c):
                        break
                kept[now.c.rows - first] = True
                cols = {**{f: pa.array(v) for f, v in out.items()}, "base_failed": pa.array(base), kept_col: pa.array(kept)}
                yield pa.RecordBatch.from_arrays([*b.slice(first, n).columns, *(cols[x] for x in added)], names=[*b.schema.names, *added])

    schema = StructType(list(own.schema))
    for x in added:
        schema = schema.add(x, "boolean" if x in ("base_failed", kept_col) else "long")
    return own.mapInArrow(A.freed(run), schema)
