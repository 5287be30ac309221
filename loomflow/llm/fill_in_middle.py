"""Fill-in-middle: texts cut at ends of lines and put in another order, so that a model learns to fill gaps.

The Split pre-tokenizer of the tokenizers library, which needs no training, isolates
each match of the line pattern and gives its code-point offsets. Their number is n;
two hashed ranks among them are the cuts, and the slices between are prefix, middle
and suffix. A text goes to the library in blocks, so that one of any length needs
little memory; a line that a block's end cuts is put together again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
#: Code points that the library gets at once.
BLOCK = 1 << 12
#: Bytes of output, in code points, after which an Arrow batch is sent.
SEND = 1 << 22


def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(LINES), "isolated")


def bounds(text: str, split, block: int = BLOCK) -> np.ndarray:
    """Zero and the end of each line of `text`, in code points."""
    ends = [0]
    for at in range(0, len(text), block):
        piece = text[at : at + block]
        ends += [at + end for _, (_, end) in split.pre_tokenize_str(piece)]
        if at + block < len(text) and piece[-1] != "\n":
            ends.pop()
    return np.array(ends, dtype=np.int64)


def hashes(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a row; a null id has those of an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Refuses sentinels that could be found anywhere but where they were put."""
    for a in sentinels:
        for b in sentinels:
            if not a or (a is not b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of each whole text; null counts as empty.

    `form` is plain (the text as it is) for empty texts, those that contain a sentinel,
    and all but `rate` percent of the rest; of these spm for `spm_rate` percent and psm
    for the others. Choices depend on `seed` and the id alone, so rows of one id, and
    those of null id, are cut alike. Other columns are ignored.
    """
    _checked(sentinels)
    pre, suf, mid = sentinels

    def rows(ids: list, texts: list, split) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts):
            text = text or ""
            at = bounds(text, split)
            n = len(at) - 1
            h = hashes(seed, doc_id)
            if not n or any(s in text for s in sentinels) or h[2] % 100 >= rate:
                yield doc_id, n, "plain", None, None, text
                continue
            a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            a, b = int(at[a]), int(at[b])
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            if h[3] % 100 < spm_rate:
                yield doc_id, n, "spm", a, b - a, "".join((suf, suffix, pre, prefix, mid, middle))
            else:
                yield doc_id, n, "psm", a, b - a, "".join((pre, prefix, suf, suffix, mid, middle))

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def batch(own: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for b in batches:
            own, size = [], 0
            for row in rows(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), split):
                own.append(row)
                size += len(row[-1])
                if size >= SEND:
                    yield batch(own)
                    own, size = [], 0
            if own:
                yield batch(own)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output and its form were made of: each sentinel's first place parts the output."""
    pre, suf, mid = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, 2**31 - 1)
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, mid, 1)
        return one, two, F.substr(rest, F.length(two) + len(mid) + 1)

    prefix, suffix, middle = parts(pre, suf)
    suffix2, prefix2, middle2 = parts(suf, pre)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
