"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut where no piece of the vocabulary can reach across: before a run of the
space mark that follows other characters, and around characters that only occur as
pieces of their own. Each segment is encoded by an agenda of adjacent symbol pairs,
best score first and leftmost among equals. Segments met lately in the task are kept
in a bounded table. In each Arrow batch some documents are encoded and decoded by the
sentencepiece library too; a difference stops the job.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm import arrays as A

SPACE = "▁"
#: Segments that a worker remembers (some 150 bytes each), and of how many documents of a batch one is checked against the library.
REMEMBERED, CHECK_EVERY = 262_144, 200
#: Bytes of text of an outgoing batch.
PART_BYTES = 1 << 20
#: Segments longer than this are not remembered.
LONG = 48
#: The order of a pair that is no piece.
NEVER = 1 << 40


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.order = {self.pieces[i]: -lib.get_score(i) for i in plain}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        long = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in long):
            raise ValueError("a piece of this vocabulary reaches across words")
        ranked = sorted(self.ids, key=lambda p: (self.order[p], self.ids[p]))
        self.number = {p: k for k, p in enumerate(ranked)}
        self.id_of = [self.ids[p] for p in ranked]
        number = self.number
        self.made = {number[p[:k]] << 20 | number[p[k:]]: number[p] for p in long for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        scores = [self.order[p] for p in long if SPACE * 2 not in p]
        if len(set(scores)) < len(scores):
            raise ValueError("pieces of equal score: their leftmost pair is not decided by a number")
        joined = "".join(sorted({c for p in long for c in p} - {SPACE}))
        word = f"[{re.escape(joined)}]"
        self.segments = re.compile(f"{SPACE}*{word}+|{SPACE}+|[^{SPACE}]")
        self.line_ends_alone = "\n" not in joined
        self.begin, self.end = array("I", (self.bos,)).tobytes(), array("I", (self.eos,)).tobytes()
        self.known: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        own = [b"" if lib.is_control(i) else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.sizes = np.array(list(map(len, own)), dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(own), dtype=np.uint8)
        self.marked = np.array([p.startswith(SPACE) for p in self.pieces])

    def agenda(self, segment: str) -> list[int]:
        """Ids of a segment by its agenda of symbol pairs; a short agenda is a list, a long one a heap."""
        if len(segment) <= 64 and SPACE * 2 not in segment:
            try:
                return self._short(list(map(self.number.__getitem__, segment)))
            except KeyError:
                pass  # a character without a piece
        sym = list(segment)
        self._merge_long(sym)
        out, ids = [], self.ids
        for p in sym:
            if p is not None:
                i = ids.get(p)
                if i is not None:
                    out.append(i)
                else:
                    out += [self.byte_ids[b] for b in p.encode()]
        return out

    def _short(self, sym: list[int]) -> list[int]:
        """As the heap does, with the agenda as a list over the pairs: the entry of a pair is the piece that it makes, numbered by score."""
        made = self.made.get
        agenda = [made(a << 20 | b, NEVER) for a, b in zip(sym, sym[1:])]
        while agenda and (p := min(agenda)) != NEVER:
            i = agenda.index(p)
            sym[i] = p
            del sym[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = made(p << 20 | sym[i + 1], NEVER)
            if i:
                agenda[i - 1] = made(sym[i - 1] << 20 | p, NEVER)
        id_of = self.id_of
        return [id_of[p] for p in sym]

    def _merge_long(self, sym: list[str | None]) -> None:
        order = self.order
        n = len(sym)
        if n > 1:
            follow, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [(s, i, p) for i in range(n - 1) if (s := order.get(p := sym[i] + sym[i + 1])) is not None]
            heapq.heapify(heap)
            while heap:
                s, i, p = heapq.heappop(heap)
                a = sym[i]
                if a is None:
                    continue
                j = follow[i]
                if j >= n or len(a) >= len(p) or a + sym[j] != p:
                    continue
                sym[i], sym[j] = p, None
                k = follow[i] = follow[j]
                if k < n:
                    before[k] = i
                    s = order.get(q := p + sym[k])
                    if s is not None:
                        heapq.heappush(heap, (s, i, q))
                k = before[i]
                if k >= 0:
                    s = order.get(q := sym[k] + p)
                    if s is not None:
                        heapq.heappush(heap, (s, k, q))

    def encode(self, text: str) -> bytes:
        """All ids of a text with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        known = self.known
        # A word stands for its mark and itself; one that begins with a line end has no mark.
        words = (text.replace("\n", " \n") if self.line_ends_alone else text).split(" ")
        if "" in words or SPACE in text or (not self.line_ends_alone and "\n" in text):
            body = self._segments(SPACE + text.replace(" ", SPACE))
        else:
            try:
                body = b"".join(map(known.__getitem__, words))
            except KeyError:
                body = b"".join([known.get(w) or self._segment(w) for w in words])
        return self.begin + body + self.end

    def _segment(self, word: str) -> bytes:
        """Ids of a word after a space mark, which is one segment or a few; remembered."""
        got = b"".join([array("I", self.agenda(s)).tobytes() for s in self.segments.findall(word if word[0] == "\n" else SPACE + word)])
        if len(word) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def _segments(self, text: str) -> bytes:
        """Ids of marked text; segments that are a mark and a word are looked up."""
        out, known = [], self.known
        for s in self.segments.findall(text):
            if s[0] == SPACE and len(s) > 1 and s[1] != SPACE:
                got = known.get(s[1:])
                out.append(self._segment(s[1:]) if got is None else got)
            else:
                got = self.inner.get(s)
                if got is None:
                    got = array("I", self.agenda(s)).tobytes()
                    if len(s) <= LONG:
                        if len(self.inner) >= REMEMBERED // 8:
                            self.inner.clear()
                        self.inner[s] = got
                out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: control ids give nothing, byte ids their bytes, and the mark put before the text goes."""
        own = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        sizes = self.sizes[own]
        ends = np.cumsum(sizes)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[own] - (ends - sizes), sizes)
        text = self.bytes[take].tobytes().decode("utf-8", errors="replace")
        inked = np.flatnonzero(sizes)
        return text[1:] if len(inked) and self.marked[own[inked[0]]] else text

    def check(self, text: str, ids: bytes, decoded: str) -> None:
        want = self.library.encode(text, add_bos=True, add_eos=True)
        if array("I", want).tobytes() != ids or self.library.decode(want) != decoded:
            raise ValueError(f"the library encodes or decodes otherwise: {text[:200]!r}")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encoded(vocabulary: str, check_every: int, payload: bool, text_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for b in batches:
            k = 0
            for part in A.slices(b, 1, PART_BYTES):
                n, ids_hash, text_hash, ids, texts = [], [], [], [], []
                for text in part.column(1).fill_null("").to_pylist():
                    got = own.encode(text)
                    back = own.decode(got)
                    if k % check_every == 0:
                        own.check(text, got, back)
                    k += 1
                    n.append(len(got) // 4)
                    ids_hash.append(hashlib.sha256(got).hexdigest())
                    text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                    if payload:
                        ids.append(got)
                        if text_out:
                            texts.append(back)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if payload:
                    ends = np.cumsum([0, *n]).astype(np.int32)
                    cols += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))] + [pa.array(texts, pa.string())] * text_out
                    names += ["ids"] + ["decoded"] * text_out
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", check_every: int = CHECK_EVERY, payload: bool = True, text_out: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each whole text, with begin and end ids.

    Null counts as empty: begin and end only. With `payload`, ids (array of int)
    and, with `text_out`, decoded (string) follow. One document of every `check_every` in an Arrow batch, the
    first always, is held against the library. Other columns are ignored.
    """

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" + ", decoded string" * text_out) * payload
    return own.mapInArrow(A.freed(_encoded(vocabulary, check_every, payload, text_out)), schema).withColumnRenamed("id", id_col)
