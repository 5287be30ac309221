"""Toxicity scores of texts restored by a noisy channel.

Words that show signs of disguise (digits or marks among letters, long repetitions,
two letters or more set apart) are character lattices: each character may stand for
itself, for the letters it resembles, for nothing, or, if it is a mark or a space, for
the end of a word. Viterbi decoding under a character trigram model and a list of known
words restores the likeliest words; a lexicon of words learned from labelled texts
scores what is restored, and a table gives the probability for so many of them. Texts
of any length are decoded. A word of digits alone is a number. Words, trigrams and hits
are counted over all labelled texts, by tasks and shuffles; what goes to the driver is
bounded by frequencies, whatever the number of texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm import arrays as A
from loomflow.llm.tables import fold, written

#: Share of toxic texts that a lexicon word is in at least, the least log odds that its counts leave, and standard
#: errors below the estimate at which they are judged.
SHARE, ODDS, ERRORS = 0.02, 2.0, 1.28
#: Words for which counts of words and trigrams are stated, where there are more of them: so the costs are the same for
#: any number of texts, and the words and trigrams that are frequent enough for them are so many at most.
PER = 1 << 22
#: Distinct words or trigrams that a task holds before it sends their counts on.
HELD = 200_000
#: Texts whose decoding a task remembers, and the longest of them in characters; longer ones are decoded each time.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: Bytes of text that are looked at together.
PART = 1 << 18
#: Hits told apart by the table of probabilities.
HITS = 4

#: What a character may stand for besides itself; fixed values.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = "._-*~^'`,/\\ "
#: Costs in nats: a look-alike, a dropped separator or repetition.
SWAP, DROP = 0.7, 0.2
#: Times that a known word occurs at least (in PER words, if there are more), the cost of a word that isn't known, and of each of its letters.
KNOWN, UNKNOWN, SPELLED = 3, 5.0, 0.7

_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[0x80:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _ALPHA[_c] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in SEPARATORS if c != " "]] = True
_ALIKE = np.zeros(256, dtype=bool)
_ALIKE[[ord(c) for c in LOOKALIKES if ord(c) < 128]] = True
#: First bytes of characters by their number of bytes.
_LEAD = (0x00, 0xC0, 0xE0, 0xF0, 0xF8)


class Letters:
    """A smoothed character trigram model, and the words it was made of."""

    def __init__(self, words: Counter):
        three, two = Counter(), Counter()
        for w, n in words.items():
            for t in _trigrams(w):
                three[t] += n
                two[t[:2]] += n
        self._set(three, two, len({c for w in words for c in w}), (w for w, n in words.items() if n >= KNOWN))

    @classmethod
    def of_counts(cls, three: dict[str, float], two: dict[str, float], letters: int, known: list[str]) -> Letters:
        """The model of counts of trigrams and of their first two characters, the number of letters, and the known words."""
        out = cls.__new__(cls)
        out._set(Counter(three), Counter(two), letters, known)
        return out

    def _set(self, three: Counter, two: Counter, letters: int, known) -> None:
        self.three, self.two, self.size, self.words = three, two, letters + 1, set(known)
        self.prefixes = {w[:k] for w in self.words for k in range(1, len(w) + 1)}

    def cost(self, two: str, c: str) -> float:
        return -math.log((self.three[two + c] + 0.1) / (self.two[two] + 0.1 * self.size))


def _trigrams(word: str) -> Iterator[str]:
    padded = "  " + word + " "
    return (padded[k : k + 3] for k in range(len(padded) - 2))


class Decoder:
    """The likeliest words behind disguised text."""

    def __init__(self, letters: Letters):
        self.letters = letters

    def decode(self, text: str) -> str:
        return " ".join(word for word, _ in self.restore(text))

    def restore(self, text: str) -> list[tuple[str, str]]:
        """(word, what stood for it) of the likeliest path; a mark or space may end a word, or be dropped within one.

        A path's state is the beginning of a known word, or else a null and the last two letters.
        """
        prefixes = self.letters.prefixes
        paths: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
        for at, c in enumerate(text):
            new: dict[str, tuple[float, tuple | None]] = {}
            letter, alike = c.isalpha(), LOOKALIKES.get(c, "")
            for state, (total, path) in paths.items():
                two = state[1:] if state[:1] == "\0" else ("  " + state)[-2:]
                options = [(c, 0.0)] if letter else [(x, SWAP) for x in alike]
                if two[1] == c and letter or two[1] in alike or c in SEPARATORS and two[1] != " " or c in "!|+(" and two[1] != " ":
                    options.append(("", DROP))
                if not letter and not c.isdigit():
                    options.append((" ", 0.0))
                for x, extra in options or [(c, 2 * SWAP)]:
                    if x == " ":
                        t, s = total + self._end(state, two), ""
                    elif x:
                        known = state[:1] != "\0" and state + x in prefixes
                        t, s = total + extra + self.letters.cost(two, x) + (0.0 if known else SPELLED if state[:1] == "\0" else SPELLED * (len(state) + 1)), state + x if known else "\0" + two[1] + x
                    else:
                        t, s = total + extra, state
                    if s not in new or t < new[s][0]:
                        new[s] = (t, (path, at, x))
            paths = new
        path = min((t + self._end(s, s[1:] if s[:1] == "\0" else ("  " + s)[-2:]), k, path) for k, (s, (t, path)) in enumerate(paths.items()))[2]
        steps = []
        while path is not None:
            path, at, x = path
            steps.append((at, x))
        out, word, first, last = [], "", 0, 0
        for at, x in [*reversed(steps), (len(text), " ")]:
            if x == " ":
                if word:
                    out.append((word, text[first : last + 1]))
                word = ""
                continue
            if not word:
                first = at
            word, last = word + x, at
        return out

    def _end(self, state: str, two: str) -> float:
        if two[1] == " ":
            return 0.0
        return self.letters.cost(two, " ") + (0.0 if state in self.letters.words else UNKNOWN)


def suspicious(c: A.Chunk, low: np.ndarray) -> Iterator[tuple[int, str]]:
    """(document, text) for each word that shows signs of disguise, and each row of single characters with the words beside it."""
    s, e, first = A.word_bounds(~A.SPACE[low], c.offsets)
    if not len(s):
        return
    doc = A.doc_of(first)
    digit = (low >= 48) & (low <= 57)
    alike = _ALIKE[low] & ~digit
    for sign in (x.encode() for x in LOOKALIKES if ord(x) >= 128):
        here = np.ones(max(0, len(low) - len(sign) + 1), dtype=bool)
        for k, byte in enumerate(sign):
            here &= low[k : k + len(here)] == byte
        alike[np.flatnonzero(here)] = True
    # Marks around a word belong to it only if they resemble letters.
    place, body = np.arange(len(low)), _ALPHA[low] | digit | alike
    begin = np.minimum.accumulate(np.where(body, place, len(low))[::-1])[::-1][s]
    last = np.maximum.accumulate(np.where(body, place, -1))[e - 1]
    ok = (begin < e) & (last >= s)
    b, l = np.where(ok, begin, s), np.where(ok, last, s) + 1
    letters, digits, marks, chars = (np.concatenate([[0], np.cumsum(x)]) for x in (_ALPHA[low], digit, alike | _MARK[low], (low & 0xC0) != 0x80))
    mixed = ((letters[l] > letters[b]) & (digits[l] > digits[b])) | (marks[l] > marks[b])
    runs = _repeats(low, b, l)
    single = ok & (chars[l] - chars[b] == 1)
    same = doc[1:] == doc[:-1]
    pair = single[1:] & single[:-1] & same
    row = np.concatenate([[False], pair]) | np.concatenate([pair, [False]])
    beside = np.concatenate([row[1:] & same, [False]]) | np.concatenate([[False], row[:-1] & same])
    row |= beside
    for k in np.flatnonzero(ok & ~row & (l - b >= 3) & (mixed | runs)):
        yield int(doc[k]), low[b[k] : l[k]].tobytes().decode("utf-8", "replace")
    joined = row[1:] & row[:-1] & same
    start = np.flatnonzero(row & ~np.concatenate([[False], joined]))
    stop = np.flatnonzero(row & ~np.concatenate([joined, [False]])) + 1
    for a, z in zip(start, stop):
        yield int(doc[a]), " ".join(low[b[k] : l[k]].tobytes().decode("utf-8", "replace") for k in range(a, z))


def _repeats(low: np.ndarray, b: np.ndarray, l: np.ndarray) -> np.ndarray:
    """Which words have a letter, of any number of bytes, three times in a row."""
    out = np.zeros(len(b), dtype=bool)
    high = bool((low >= 0x80).any())
    for width in (1, 2, 3, 4) if high else (1,):
        if len(low) < 3 * width:
            break
        same = np.concatenate([[0], np.cumsum(low[width:] == low[:-width])])
        lead = _ALPHA[low] & ((low >= _LEAD[width - 1]) & (low < _LEAD[width]) if width > 1 else low < 0x80)
        n = len(low) - 3 * width + 1
        hit = lead[:n] & (same[2 * width : 2 * width + n] - same[:n] == 2 * width)
        seen = np.concatenate([[0], np.cumsum(hit), np.full(3 * width - 1, hit.sum())])
        out |= (l - b >= 3 * width) & (seen[np.maximum(l - 3 * width + 1, b)] > seen[b])
    return out


class Scorer:
    """Lexicon and decoder, and probabilities by number of hits if they are known."""

    def __init__(self, decoder: Decoder, lexicon: dict[str, float], table: list[float] | None = None):
        self.decoder, self.lexicon, self.table, self.known = decoder, lexicon, table, {}
        words = [w.encode() for w in sorted(lexicon)]
        self.odds = np.array([lexicon[w] for w in sorted(lexicon)])
        buf, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(size)
        self.hashes = A.word_hash(buf, ends - size, ends) if words else np.zeros(0, np.uint64)

    def hits(self, c: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Lexicon words of each document, plain and restored, and the sum of their log odds."""
        low = A.LOWER[c.buf]
        n, odds = np.zeros(len(c)), np.zeros(len(c))
        s, e, first = A.word_bounds(_ALPHA[low], c.offsets)
        if len(s) and len(self.hashes):
            h = A.word_hash(low, s, e)
            found = np.flatnonzero(np.isin(h, self.hashes))
            order = np.argsort(self.hashes)
            which = order[np.searchsorted(self.hashes[order], h[found])]
            doc = A.doc_of(first)[found]
            np.add.at(n, doc, 1)
            np.add.at(odds, doc, self.odds[which])
        if self.lexicon:
            for doc, text in suspicious(c, low):
                for word in self.restored(text):
                    n[doc] += 1
                    odds[doc] += self.lexicon[word]
        return n, odds

    def restored(self, text: str) -> tuple[str, ...]:
        """Lexicon words behind a text, without those that stand in it plainly; a number stands for itself."""
        got = self.known.get(text)
        if got is None:
            got = tuple(w for w, own in self.decoder.restore(text) if w in self.lexicon and not own.isdigit() and w not in _WORD.findall(own))
            if len(text) <= REMEMBERED_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[text] = got
        return got


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, toxic) rows: how often each word stands plainly, and how many toxic and other texts have it. The null word is in all texts."""
    plain, bad, good = Counter(), Counter(), Counter()

    def sent() -> pa.RecordBatch:
        words = list(plain.keys() | bad.keys() | good.keys())
        columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (plain, bad, good))]
        for c in (plain, bad, good):
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "n", "bad", "good"])

    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist()):
            text = (text.as_py() or "").translate(_FOLD)
            plain.update(_PLAIN.findall(_ROW.sub(" ", text)))
            (bad if label else good).update({None, *_WORD.findall(text)})
            if len(plain) + len(bad) + len(good) > HELD:
                yield sent()
    yield sent()


def _drawn_out(word: str) -> bool:
    return any(word[k] == word[k + 1] == word[k + 2] for k in range(len(word) - 2))


def _counted_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (word, n) rows: how often each trigram occurs."""
    three = Counter()

    def sent() -> pa.RecordBatch:
        columns = [pa.array([t[:2] for t in three], pa.string()), pa.array([t[2] for t in three], pa.string()), pa.array(list(three.values()), pa.int64())]
        three.clear()
        return pa.RecordBatch.from_arrays(columns, names=["two", "next", "n"])

    for b in batches:
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not _drawn_out(word):
                for t in _trigrams(word):
                    three[t] += n
            if len(three) > HELD:
                yield sent()
    yield sent()


def fit(labelled: DataFrame) -> Scorer:
    """A scorer from all rows of (text, toxic), without its probabilities; words in few toxic texts are no lexicon words."""
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    words = written(labelled.select("text", "toxic").mapInArrow(_counted, "word string, n long, bad long, good long").groupBy("word").agg(*sums), "words")
    _, n_bad, n_good = words.where("word is null").select("n", "bad", "good").first() or (0, 0, 0)
    words = words.where("word is not null")
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    enough = (F.col("bad") >= max(3, SHARE * n_bad)) & (odds - ERRORS * error >= ODDS) & (F.length("word") > 2)
    lexicon = {r[0]: r[1] for r in words.where(enough).select("word", odds).collect()}
    total = words.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, PER / max(1, total))
    plain = words.where("n > 0").select("word", "n")
    known = [w for (w,) in plain.where(F.col("n") * share >= KNOWN).select("word").collect() if not _drawn_out(w)]
    trigrams = written(plain.mapInArrow(_counted_trigrams, "two string, next string, n long").groupBy("two", "next").agg(sums[0]), "trigrams")
    stated = F.col("n") * share
    three = {r[0] + r[1]: r[2] for r in trigrams.where(stated >= 1).select("two", "next", stated).collect()}
    two = dict(tuple(r) for r in trigrams.groupBy("two").agg(sums[0]).where(stated >= 1).select("two", stated).collect())
    letters = trigrams.where(F.col("next") != " ").select("next").distinct().count()
    return Scorer(Decoder(Letters.of_counts(three, two, letters, known)), lexicon)


def probabilities(level: dict[int, tuple[int, int]]) -> list[float]:
    """The probability that a text is toxic by its hits, from (texts, toxic texts) of each number of hits."""
    n, bad = (sum(x) for x in zip((0, 0), *level.values()))
    prior = (bad + 1) / (n + 2)
    table = [0.0] * (HITS + 1)
    for k in range(HITS + 1):
        own, own_bad = level.get(k, (0, 0))
        table[k] = (own_bad + 2 * prior) / (own + 2) if own else table[max(0, k - 1)]
    for k in range(1, HITS + 1):  # more hits are never less toxic
        table[k] = max(table[k], table[k - 1])
    return table


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[a-z\u0080-\U0010ffff]+")
#: Words with nothing but punctuation around them, and rows of single characters: pieces of disguised words are no words.
_PLAIN = re.compile(r"(?<![^\s(\"'])[a-z\u0080-\U0010ffff]+(?=[.,;:!?)\"']*(?:\s|$))")
_ROW = re.compile(r"(?<!\S)\S(?:\s+\S)+(?!\S)")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_fold: int = 2, threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted) of each whole text.

    Learns from all labelled rows whose crc32(id as text) mod `folds` is not `held_fold`.
    Null and empty texts are scored as texts without hits. A null id is never learned from
    and counts as not held out; repeated labels of an id count once each. Without labels
    every score is the prior. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held = F.coalesce(fold(F.col("id"), folds) == held_fold, F.lit(False))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(label_col).cast("int") != 0).alias("toxic"))
    known = known.where(~held).hint("shuffle_hash")  # labels are small beside texts, which so need no sort
    shared = own.sparkSession.sparkContext.broadcast(fit(own.where(~held).join(known, "id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.hits(c) for c in A.chunks(b.column(1), PART)]
            n, odds = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n.astype(np.int64)), pa.array(odds)], names=["id", "held_out", "n", "odds"])

    hits = written(own.withColumn("held_out", held).mapInArrow(run, "id long, held_out boolean, n long, odds double"), "hits")
    level = F.least("n", F.lit(HITS)).cast("int")
    counts = hits.where("not held_out").select("id", level.alias("level")).join(known, "id").groupBy("level").agg(F.count("*"), F.count_if("toxic")).collect()
    table = F.array(*[F.lit(p) for p in probabilities({k: (n, bad) for k, n, bad in counts})])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), table[level] + F.when(F.col("n") > 0, 0.01 * (1 - F.exp(-F.col("odds") / 10))).otherwise(0.0)))
    return hits.select(F.col("id").alias(id_col), "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
