"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of letters and digits; a chain is all tokens of a line, tagged outside,
begin or inside (a secret with marks in it has several tokens). Features are a token's
shape, the marks and words on both sides of it, and its file (what share of its tokens
mixes letters and digits). Weights are trained by gradient ascent on the likelihood of
windows from a bounded sample of texts with and without matches of the fixed patterns,
and of copies of these windows with other values in the place of the secrets and with
their neighbours masked, so that the field does not only learn the patterns.

Decoding is by Viterbi. A token whose outside score exceeds the others by more than all
transitions can make good is outside on the best path, so what is decoded is the short
runs between such tokens, exactly as the whole chain would be.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm import arrays as A

#: Texts of each kind (with and without a match) on which the field is trained, about, the characters of a longer one that stand for it, and tokens of a window.
SAMPLE, LONGEST, WINDOW = 400, 20_000, 17
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TAGS = 3
KINDS = ("assign", "access", "hex", "field")

# The contract's patterns; fixed values.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

_HEXRUN = np.zeros(256, dtype=bool)
_HEXRUN[list(b"0123456789abcdef")] = True


def base_spans(text: str, hex_run: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if hex_run:
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _class(*members: bytes) -> np.ndarray:
    """The number of the group that each byte is in, one more for all others."""
    out = np.full(256, len(members), dtype=np.int64)
    for k, own in enumerate(members):
        out[list(own)] = k
    return out


_DIGITS, _LOWERS, _UPPERS = bytes(range(48, 58)), bytes(range(97, 123)), bytes(range(65, 91))
#: Digit, lower-case letter, upper-case letter, other letter, no letter.
_KIND = _class(_DIGITS, _LOWERS, _UPPERS, bytes(range(128, 256)))
_MARK = _class(b" \t", b"=", b":", b"\"'`", b"+/_-", b".", b"\n\r", b"@")
_VOWEL = np.zeros(256, dtype=bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True
_SIZES = np.array([2, 4, 8, 12, 16, 24, 40])
#: Numbers of words told apart by hash; 0 is a word that is masked, 1 the end of the line.
WORDS = 512

#: Values that each feature takes, and where its weights begin.
TAKES = np.array([8 * 4 * 8, 5 * 4, 9, 9, WORDS, WORDS, WORDS, 3])
AT = np.concatenate([[0], np.cumsum(TAKES)])
FEATURES = int(AT[-1])


class Tokens:
    """The tokens of a chunk with their features; `head` are those that begin a line."""

    def __init__(self, c: A.Chunk):
        buf = c.buf
        kind = _KIND[buf]
        self.s, self.e, self.first = A.word_bounds(kind < 4, c.offsets)
        s, e = self.s, self.e
        self.doc = A.doc_of(self.first)
        n = len(s)
        self.head = np.zeros(n, dtype=bool)
        self.feats = np.zeros((n, len(TAKES)), dtype=np.int64)
        if not n:
            return
        self.head[self.first[:-1][self.first[:-1] < self.first[1:]]] = True
        lines = np.cumsum(buf == 0x0A)[s]
        self.head[1:] |= lines[1:] != lines[:-1]
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([s, e])], axis=0)[0]
        size, digits, lowers, uppers, vowels = e - s, count(kind == 0), count(kind == 1), count(kind == 2), count(_VOWEL[buf])
        change = np.zeros(len(buf), dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        change[s] = False
        changes = count(change)
        rate = np.where(digits == 0, 0, np.where(3 * digits < size, 1, np.where(digits < size, 2, 3)))
        cases = (lowers > 0) + 2 * (uppers > 0) + 4 * (digits + lowers + uppers < size)
        self.feats[:, 0] = (np.searchsorted(_SIZES, size, side="right") * 4 + rate) * 8 + cases
        letters = lowers + uppers
        self.feats[:, 1] = np.searchsorted([1, 2, 4, 8], changes, side="right") * 4 + np.where(letters < 6, 0, np.where(6 * vowels < letters, 1, np.where(4 * vowels < letters, 2, 3)))
        ends = np.append(c.offsets[1:], len(buf))[self.doc]
        begins = c.offsets[self.doc]
        self.feats[:, 2] = np.where(s > begins, _MARK[buf[np.maximum(s - 1, 0)]], 6)
        self.feats[:, 3] = np.where(e < ends, _MARK[buf[np.minimum(e, len(buf) - 1)]], 6)
        word = 2 + (A.word_hash(A.LOWER[buf], s, e) % np.uint64(WORDS - 2)).astype(np.int64)
        last = np.append(self.head[1:], True)
        before = np.where(self.head, 1, np.concatenate([[1], word[:-1]]))
        self.feats[:, 4] = before
        self.feats[:, 5] = np.where(self.head, 1, np.concatenate([[1], before[:-1]]))
        self.feats[:, 6] = np.where(last, 1, np.append(word[1:], 1))
        mixed = np.bincount(self.doc, weights=(digits > 0) & (letters > 0), minlength=len(c))
        share = np.searchsorted([0.02, 0.2], mixed / np.maximum(np.diff(self.first), 1), side="right")
        self.feats[:, 7] = share[self.doc]


class Field:
    """Weights of the field; a token cannot be inside unless the one before, of its line, is begin or inside."""

    def __init__(self):
        self.emit = np.zeros((FEATURES, TAGS))
        self.move = np.zeros((TAGS, TAGS))
        self.allowed = np.array([[0.0, 0.0, -1e9], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])

    def scores(self, feats: np.ndarray) -> np.ndarray:
        """Scores of all tags of each token (of any number of leading axes)."""
        total = self.emit[feats[..., 0]]
        for k in range(1, feats.shape[-1]):
            total = total + self.emit[feats[..., k] + AT[k]]
        return total

    def margin(self) -> float:
        """By how much a token's outside score must exceed the others so that no path through begin or inside is better.

        Outside in place of the tag changes two transitions, and makes a begin of an inside after it.
        """
        own = self.emit[:, INSIDE] - self.emit[:, BEGIN]
        turned = sum(max(0.0, own[a:b].max()) for a, b in zip(AT[:-1], AT[1:]))
        return 3 * float(self.move.max() - self.move.min()) + turned + 1e-6

    def viterbi(self, s: np.ndarray, head: bool = True) -> list[int]:
        """The best tags of a chain, given the scores of its tokens; `head`: it begins a line."""
        move = self.move + self.allowed
        best, back = s[0] + (np.array([0.0, 0.0, -1e9]) if head else move[OUTSIDE]), []
        for k in range(1, len(s)):
            total = best[:, None] + move
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + s[k]
        tag = int(best.argmax())
        tags = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            tags.append(tag)
        return tags[::-1]

    def tags(self, t: Tokens) -> np.ndarray:
        """The best tag of each token."""
        out = np.zeros(len(t.s), dtype=np.int8)
        if not len(out):
            return out
        s = self.scores(t.feats)
        open_ = s[:, OUTSIDE] - np.maximum(s[:, BEGIN], s[:, INSIDE]) <= self.margin()
        starts = np.flatnonzero(open_ & (t.head | ~np.concatenate([[False], open_[:-1]])))
        stops = np.flatnonzero(open_ & ~np.concatenate([open_[1:] & ~t.head[1:], [False]])) + 1
        s = s.copy()
        ends = stops[stops < len(out)]
        s[ends[~t.head[ends]] - 1] += (self.move + self.allowed)[:, OUTSIDE]  # the token after the run is outside
        order = np.argsort(starts - stops, kind="stable")
        self._decode(s, t.head, starts[order], (stops - starts)[order], out)
        return out

    def _decode(self, s: np.ndarray, head: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
        """As viterbi, for many runs of tokens at a time, longest first; what is kept is bounded by the tokens."""
        move = self.move + self.allowed
        first = np.where(head[starts, None], np.array([0.0, 0.0, -1e9]), move[OUTSIDE])
        best, back = s[starts] + first, []
        for k in range(1, int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k, side="left"))
            total = best[:n, :, None] + move
            back.append(total.argmax(axis=1).astype(np.int8))
            best[:n] = total.max(axis=1) + s[starts[:n] + k]
        tag = best.argmax(axis=1)
        for k in range(len(back), 0, -1):
            n = len(back[k - 1])
            out[starts[:n] + k] = tag[:n]
            tag[:n] = back[k - 1][np.arange(n), tag[:n]]
        out[starts] = tag

    def learn(self, feats: np.ndarray, tags: np.ndarray, length: np.ndarray, epochs: int = 40, rate: float = 0.25, decay: float = 2e-5) -> None:
        """Gradient ascent (with running moments) on the log likelihood of chains (rows of `length` tokens), by forward and backward sums."""
        if not len(feats):
            return
        n, wide = tags.shape
        live = np.arange(wide)[None, :] < length[:, None]
        total = int(live.sum())
        move_seen = np.zeros((TAGS, TAGS))
        np.add.at(move_seen, (tags[:, :-1][live[:, 1:]], tags[:, 1:][live[:, 1:]]), 1)
        flat = (feats + AT[:-1])[live]
        own = np.eye(TAGS)[tags[live]]
        m = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        v = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, epochs + 1):
            s, move = self.scores(feats), self.move + self.allowed
            fwd = np.empty_like(s)
            fwd[:, 0] = s[:, 0] + np.array([0.0, 0.0, -1e9])
            for k in range(1, wide):
                fwd[:, k] = np.where(live[:, k, None], _logsum(fwd[:, k - 1, :, None] + move, 1) + s[:, k], fwd[:, k - 1])
            z = _logsum(fwd[:, -1], 1)
            bwd = np.zeros_like(s)
            move_got = np.zeros((TAGS, TAGS))
            for k in range(wide - 1, 0, -1):
                ahead = move + (s[:, k] + bwd[:, k])[:, None, :]
                both = np.exp(np.minimum(fwd[:, k - 1, :, None] + ahead - z[:, None, None], 0)) * live[:, k, None, None]
                move_got += both.sum(axis=0)
                bwd[:, k - 1] = np.where(live[:, k, None], _logsum(ahead, 2), 0)
            p = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0))[live]
            emit = np.zeros_like(self.emit)
            for tag in range(TAGS):
                emit[:, tag] = np.bincount(flat.ravel(), weights=np.repeat(own[:, tag] - p[:, tag], flat.shape[1]), minlength=FEATURES)
            for k, (x, g) in enumerate(((self.emit, emit / total), (self.move, (move_seen - move_got) / total))):
                g = g - decay * x
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                x += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def _value(m: re.Match) -> tuple[int, int]:
    """Where a match's secret is: behind the assignment, or all of it."""
    return m.span(2) if m.re is _ASSIGN else m.span()


def values(text: str) -> list[tuple[int, int]]:
    """The secrets that the fixed patterns find, without what they are assigned to, overlapping ones as one."""
    got = sorted(_value(m) for kind, p in zip(KINDS, (_ASSIGN, _ACCESS, _HEX)) for m in p.finditer(text) if m.end(m.lastindex and 2 or 0) - m.start(m.lastindex and 2 or 0) >= LEAST[kind])
    out: list[tuple[int, int]] = []
    for a, b in got:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _invented(rng: np.random.Generator) -> str:
    """A random value of 14 to 48 characters, one in three with marks in it."""
    own = "".join(rng.choice(list(_ALPHABETS[rng.integers(len(_ALPHABETS))]), int(rng.integers(14, 49))))
    if rng.random() < 0.33:
        for at in sorted(rng.integers(4, len(own) - 3, int(rng.integers(1, 4))), reverse=True):
            own = own[:at] + "-_/+."[rng.integers(5)] + own[at:]
    return own


def _windows(texts: list[str], rng: np.random.Generator, each: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and tags of windows: one around each secret, `each` of each text elsewhere. No window reaches over a line's end."""
    feats, tags = [], []
    for text in texts:
        raw = text.encode()
        t = Tokens(A.Chunk(np.zeros(1, np.int64), np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        if not len(t.s):
            continue
        tag = np.zeros(len(t.s), dtype=np.int64)
        at = []
        for a, b in values(text):
            a, b = len(text[:a].encode()), len(text[:b].encode())
            own = np.flatnonzero((t.s < b) & (t.e > a))
            if len(own):
                tag[own[0]], tag[own[1:]] = BEGIN, INSIDE
                at.append(int(own[0]))
        line = np.cumsum(t.head)
        for k in [*at, *rng.integers(0, len(t.s), each).tolist()]:
            own = np.arange(max(0, k - WINDOW // 2), min(len(t.s), k + WINDOW // 2 + 1))
            own = own[line[own] == line[k]]
            while len(own) > 1 and tag[own[0]] == INSIDE:  # whole secrets only
                own = own[1:]
            feats.append(t.feats[own]), tags.append(tag[own])
    return feats, tags


def fit(texts: list[str], seed: int = 5) -> Field:
    """A field from texts with and without secrets that the fixed patterns find."""
    rng, field = np.random.default_rng(seed), Field()
    full = [t for t in texts if values(t)]
    other = []
    for text in [*full, *full]:
        out, end = [], 0
        for a, b in values(text):
            out += [text[end:a], _invented(rng)]
            end = b
        other.append(("".join(out) + text[end:], [len("".join(out[: 2 * k + 1])) for k in range(len(out) // 2)], [len(x) for x in out[1::2]]))
    feats, tags = _windows(texts, rng, 3)
    for text, starts, sizes in other:
        f, t = _tagged(text, starts, sizes)
        feats += f
        tags += t
    seen = np.concatenate([f[:, 4] for f in feats]) if feats else np.zeros(0, np.int64)
    for k in range(len(feats)):  # the same with no neighbours and with any others, so that shapes tell too
        begin, secret = tags[k] == BEGIN, tags[k] > 0
        last = secret & ~np.append(tags[k][1:] == INSIDE, False)
        for others in (np.zeros(1, np.int64), seen):
            own = feats[k].copy()
            own[:, 4:7] = rng.choice(others, (len(own), 3))
            own[begin, 2] = rng.integers(0, 4, int(begin.sum()))
            own[last, 3] = rng.choice([0, 0, 3, 6, 8], int(last.sum()))
            feats.append(own), tags.append(tags[k])
    if not feats:
        return field
    length = np.array([len(t) for t in tags])
    x, y = np.zeros((len(feats), WINDOW, len(TAKES)), dtype=np.int64), np.zeros((len(feats), WINDOW), dtype=np.int64)
    for k, (f, t) in enumerate(zip(feats, tags)):
        x[k, : len(t)], y[k, : len(t)] = f, t
    field.learn(x, y, length)
    return field


def _tagged(text: str, starts: list[int], sizes: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Windows around secrets that are where we put them."""
    raw = text.encode()
    t = Tokens(A.Chunk(np.zeros(1, np.int64), np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    tag, at = np.zeros(len(t.s), dtype=np.int64), []
    for a, n in zip(starts, sizes):
        lo, hi = len(text[:a].encode()), len(text[: a + n].encode())
        own = np.flatnonzero((t.s < hi) & (t.e > lo))
        if len(own):
            tag[own[0]], tag[own[1:]] = BEGIN, INSIDE
            at.append(int(own[0]))
    line, feats, tags = np.cumsum(t.head), [], []
    for k in at:
        own = np.arange(max(0, k - WINDOW // 2), min(len(t.s), k + WINDOW // 2 + 1))
        own = own[line[own] == line[k]]
        while len(own) > 1 and tag[own[0]] == INSIDE:
            own = own[1:]
        feats.append(t.feats[own]), tags.append(tag[own])
    return feats, tags


def field_spans(c: A.Chunk, field: Field) -> list[tuple[int, int, int]]:
    """(document, start, end) of the secrets that the field finds in a chunk, in code points."""
    t = Tokens(c)
    tag = field.tags(t)
    begin = np.flatnonzero(tag == BEGIN)
    if not len(begin):
        return []
    inside = np.append(tag[1:] == INSIDE, False)
    stop = np.flatnonzero((tag > 0) & ~inside)
    last = stop[np.searchsorted(stop, begin)]
    points = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])
    base = points[c.offsets[:-1]][t.doc[begin]]
    return list(zip(t.doc[begin].tolist(), (points[t.s[begin]] - base).tolist(), (points[t.e[last]] - base).tolist()))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def _hex_flags(c: A.Chunk) -> np.ndarray:
    """Which documents have a run long enough for the hex pattern."""
    s, e, first = A.word_bounds(_HEXRUN[c.buf], c.offsets)
    return np.bincount(A.doc_of(first)[e - s >= LEAST["hex"]], minlength=len(c)) > 0


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) of each whole text.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Null and
    empty texts have none. An empty table gives an empty result. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    field = trained(own)
    shared = own.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = {k: [] for k in KINDS[:3]}
            digest, spans = [], []
            for _, base, all_spans in scanned(b.column(1), shared.value):
                for k in counts:
                    counts[k].append(sum(x[2] == k for x in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_spans))
            cols = [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = own.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return own.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with each span of `text_col`, overlapping ones as one, replaced by [secret]; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs.select(F.col(text_col).alias("text"))))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in A.slices(b, at, A.CHUNK_BYTES // 2):
                texts = [redacted(text, spans) for text, _, spans in scanned(part.column(at), shared.value)]
                yield part.set_column(at, b.schema.field(at).name, pa.array(texts, pa.string()))

    return docs.mapInArrow(A.freed(run), docs.schema)


def trained(own: DataFrame) -> Field:
    """The field, from about SAMPLE texts with a match of the fixed patterns and as many without, drawn by hash; no more reach the driver as the table grows.

    A text of more than LONGEST characters is there by one piece of so many, which its hash chooses of all its pieces.
    """
    pieces = F.ceil(F.length("text") / F.lit(LONGEST))
    piece = F.when(pieces > 1, F.substr("text", (F.pmod(F.xxhash64("text", F.lit(19)), pieces) * LONGEST + 1).cast("int"), F.lit(LONGEST))).otherwise(F.col("text"))
    found = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]") | F.col("text").rlike("AKIA[A-Z0-9]{14}|[0-9a-f]{16}")
    looks = own.where(F.col("text").isNotNull()).select(piece.alias("text")).select("text", found.alias("found"))
    counts = {r["found"]: r["count"] for r in looks.groupBy("found").count().collect()}
    share = lambda kind: min(1_000_000, 1 + 1_000_000 * SAMPLE // max(1, counts.get(kind, 0)))
    drawn = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1_000_000)) < F.when(F.col("found"), share(True)).otherwise(share(False))
    return fit(sorted(r[0] for r in looks.where(drawn).dropDuplicates(["text"]).orderBy(F.xxhash64("text")).limit(4 * SAMPLE).select("text").collect()))


def scanned(column: pa.Array, field: Field) -> Iterator[tuple[str | None, list, list]]:
    """(text, base spans, all spans) of each row; a span of the field that overlaps a base span is left out."""
    for c in A.chunks(column, A.CHUNK_BYTES // 2):
        hexes = _hex_flags(c)
        more: dict[int, list] = {}
        for doc, a, b in field_spans(c, field):
            more.setdefault(doc, []).append((a, b, "field"))
        for k, text in enumerate(column.slice(int(c.rows[0]), len(c)).to_pylist()):
            if not text:
                yield text, [], []
                continue
            base = base_spans(text, bool(hexes[k]))
            yield text, base, base + [x for x in more.get(k, ()) if not any(x[0] < e and s < x[1] for s, e, _ in base)]


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span, overlapping ones as one, replaced by [secret]."""
    if not spans or text is None:
        return text
    out, end = [], 0
    for a, b, _ in sorted(spans):
        if a >= end:
            out += [text[end:a], "[secret]"]
        end = max(end, b)
    return "".join(out) + text[end:]
