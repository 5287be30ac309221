"""A permutation null: delays dealt anew to blocks of the same sizes, in every replicate, with no row for each replicate.

A replicate orders the rows of a transition by a digest of replicate and row, and blocks
take rows in turn. A row keeps the first byte of its digest in each replicate. Counts of
those bytes tell in which one each block ends; only rows with such a byte are ordered in
full, to find the row at which it ends. Then a row's block in every replicate is known
where the row is, and distances are worked out within slices of the delays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.functions import scalars as S
from loomflow.functions import sliced as L

#: Rows of one slice that are worked on together, about; a slice of more, all of one value or few, is several parts.
PART = 4 * L.ROWS
#: Transitions whose counts a task holds at once.
HELD = 64
KEYS = ["transition", "slice", "part"]


def _binary(x: np.ndarray) -> pa.Array:
    """A row's bytes for each row of a two-dimensional array."""
    flat = np.ascontiguousarray(x)
    width = flat.shape[1] * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer((np.arange(len(flat) + 1) * width).astype(np.int32)), pa.py_buffer(flat)])


def _table(column: pa.ChunkedArray | pa.Array, dtype: str, width: int) -> np.ndarray:
    """Rows of `width` numbers of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _kept(df: DataFrame) -> DataFrame:
    """`df` made once, now, as later steps read it more than once."""
    out = df.persist()
    out.count()
    return out


class Dealt:
    """Delays of the transitions of `metrics`, with their blocks in each replicate; blocks are counted from 0 in the order in which they are dealt."""

    def __init__(self, hist: DataFrame, metrics: DataFrame, cfg: Config, replicates: int):
        self.replicates, self.cfg = replicates, cfg
        self.heads = [f"{cfg.seed + 23}:{rep}:".encode() for rep in range(replicates)]
        own = hist.join(_kept(metrics.select("transition")), "transition", "left_semi").select("transition", "case_id", "origin", S.block(F.col("origin"), cfg.start, cfg.block_days).alias("block"), S.capped(F.col("delay"), cfg.cap).alias("y"))
        sizes = own.groupBy("transition", "block").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("transition").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
        blocks = sizes.select("transition", F.struct("block", "n", upto.alias("hi")).alias("b")).groupBy("transition").agg(F.array_sort(F.collect_list("b")).alias("blocks"))  # an entry for each calendar block
        self.blocks = _kept(blocks)
        self.width = cfg.blocks  # blocks of a transition at most
        self.dtype = "u1" if self.width <= 256 else "<u4"
        text = F.concat_ws(":", "transition", F.coalesce(F.col("case_id").cast("string"), F.lit("")), F.unix_micros(F.col("origin").cast("timestamp")))
        # Rows of one case, origin and delay are alike but for their number.
        same = own.groupBy("transition", text.alias("text"), "y").agg(F.count("*").cast("int").alias("c"))
        rows = same.select("transition", "text", "y", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("k"))
        rows = L.sliced(rows, ["transition"], "y", cfg.cap, parts=PART, salt="text")
        self.wide = _kept(rows.select(*KEYS, "text", "y", "k").mapInArrow(self._bytes(), "transition string, slice int, part int, text string, y double, k int, first binary"))
        self.rows = self._placed()

    def _bytes(self):
        heads = self.heads

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            md5 = hashlib.md5
            for b in batches:
                if not b.num_rows:
                    continue
                tails = [t.encode() for t in b.column("text").to_pylist()]
                first = np.frombuffer(b"".join([md5(h + t).digest() for t in tails for h in heads]), np.uint8)[::16]
                yield pa.RecordBatch.from_arrays([*b.columns, _binary(first.reshape(len(tails), -1))], names=[*b.schema.names, "first"])

        return run

    def _cuts(self) -> DataFrame:
        """(transition, rep, at, byte, within): the first byte of the row at which each block but the first begins, and its place among rows with that byte."""
        reps = self.replicates

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}

            def out() -> pa.RecordBatch:
                got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), _binary(np.array([x.ravel() for x in held.values()]).reshape(len(held), -1))], names=["transition", "counts"])
                held.clear()
                return got

            for b in batches:
                names, at = np.unique(np.array(b.column("transition").to_pylist(), dtype=object), return_inverse=True)
                first = _table(b.column("first"), "u1", reps)
                for k, name in enumerate(names):
                    own = first[at == k].astype(np.int64) + 256 * np.arange(reps)
                    if name not in held:
                        if len(held) == HELD:
                            yield out()
                        held[name] = np.zeros(256 * reps, np.int64)
                    held[name] += np.bincount(own.ravel(), minlength=256 * reps)
            if held:
                yield out()

        def cut(key: tuple, counts: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            ends = np.array([b["hi"] for b in blocks["blocks"].iloc[0]][:-1], dtype=np.int64)
            each = sum(np.frombuffer(x, np.int64) for x in counts["counts"]).reshape(reps, 256)
            upto = np.cumsum(each, axis=1)
            byte = np.array([np.searchsorted(row, ends, side="right") for row in upto]).reshape(reps, len(ends))
            within = ends - np.take_along_axis(upto - each, byte, axis=1)
            rep, at = np.indices(byte.shape)
            return pd.DataFrame({"transition": key[0], "rep": rep.ravel(), "at": at.ravel(), "byte": byte.ravel(), "within": within.ravel()})

        counts = self.wide.select("transition", "first").mapInArrow(count, "transition string, counts binary")
        return counts.groupBy("transition").cogroup(self.blocks.groupBy("transition")).applyInPandas(cut, "transition string, rep int, at int, byte int, within long")

    def _beside(self, cuts: DataFrame, *columns: str):
        """The rows of each slice beside the cuts of its transition, and what is made of both."""
        each = cuts.groupBy("transition").agg(F.sort_array(F.collect_list(F.struct("rep", "at", *columns))).alias("cuts"))  # replicates x blocks
        places = self.wide.select(*KEYS).distinct()  # a row for each slice
        right = places.join(F.broadcast(each), "transition", "left").select(*[F.col(k).alias(k) for k in KEYS], "cuts")  # columns of its own
        return self.wide.groupBy(*KEYS).cogroup(right.groupBy(*KEYS))

    def _placed(self) -> DataFrame:
        """(transition, slice, y, rows, blocks): the block of a row in each replicate; or for many rows of one value how many each block has, with `rows` over 0."""
        reps, width, dtype, heads = self.replicates, self.width, self.dtype, self.heads
        cuts = _kept(self._cuts())  # replicates x transitions x blocks

        def bytes_of(cut: list[dict]) -> np.ndarray:
            return np.array([c["byte"] for c in cut], dtype=np.int64).reshape(reps, -1)

        def close(left: pa.Table, right: pa.Table) -> pa.Table:
            first, cut = _table(left.column("first"), "u1", reps), right.column("cuts")[0].as_py() or []
            byte = bytes_of(cut)
            near = np.zeros(first.shape, dtype=bool)
            for j in range(byte.shape[1]):
                near |= first == byte[:, j]
            row, rep = np.nonzero(near)
            texts = [t.encode() for t in left.column("text").to_pylist()]
            digests = [hashlib.md5(heads[r] + texts[i]).digest() for i, r in zip(row.tolist(), rep.tolist())]
            return pa.table({"transition": left.column("transition").take(row), "rep": pa.array(rep.astype(np.int32)), "byte": pa.array(first[row, rep].astype(np.int32)), "digest": pa.array(digests, pa.binary()), "y": left.column("y").take(row), "k": left.column("k").take(row)})

        some = self._beside(cuts, "byte").applyInArrow(close, "transition string, rep int, byte int, digest binary, y double, k int")
        within = F.row_number().over(Window.partitionBy("transition", "rep", "byte").orderBy("digest", "y", "k")) - 1
        found = _kept(some.withColumn("within", within.cast("long")).join(cuts, ["transition", "rep", "byte", "within"]).select("transition", "rep", "at", "byte", "digest", "y", "k"))

        def place(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("y")
            first, cut = _table(left.column("first"), "u1", reps), right.column("cuts")[0].as_py() or []
            byte = bytes_of(cut)
            block = np.zeros(first.shape, dtype=np.int64)
            near = np.zeros(first.shape, dtype=bool)
            for j in range(byte.shape[1]):
                block += byte[:, j] < first
                near |= byte[:, j] == first
            begins = [[] for _ in range(reps)]
            for c in cut:
                begins[c["rep"]].append((c["byte"], (bytes(c["digest"]), c["y"], c["k"])))
            texts, ys, ks = [t.encode() for t in left.column("text").to_pylist()], left.column("y").to_pylist(), left.column("k").to_pylist()
            row, rep = np.nonzero(near)
            for i, r, own in zip(row.tolist(), rep.tolist(), first[row, rep].tolist()):
                key = (hashlib.md5(heads[r] + texts[i]).digest(), ys[i], ks[i])
                block[i, r] += sum(b == own and begin <= key for b, begin in begins[r])
            y = np.array(ys)
            start = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
            size = np.diff(np.append(start, len(y)))
            many = size > 8 * width  # their counts are shorter than their blocks
            alone = ~np.repeat(many, size)
            counts = [np.bincount((block[s : s + n] + width * np.arange(reps)).ravel(), minlength=width * reps) for s, n in zip(start[many], size[many])]
            held = [*block[alone].astype(dtype), *[x.astype(np.int64) for x in counts]]
            one = left.slice(0, 1)
            n = len(held)
            return pa.table({
                "transition": pa.array([one.column("transition")[0].as_py()] * n, pa.string()), "slice": pa.array([one.column("slice")[0].as_py()] * n, pa.int32()),
                "y": pa.array(np.append(y[alone], y[start[many]])), "rows": pa.array(np.append(np.zeros(int(alone.sum()), np.int64), size[many])), "blocks": pa.array([x.tobytes() for x in held], pa.binary()),
            })

        return self._beside(found, "byte", "digest", "y", "k").applyInArrow(place, "transition string, slice int, y double, rows long, blocks binary")

    def _counts(self):
        """What gives the rows of a table in ascending order of y: (y, counts), a value and a row of counts (replicates, blocks) each, some at a time."""
        reps, width, dtype = self.replicates, self.width, self.dtype

        def run(y: np.ndarray, rows: np.ndarray, blocks: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            values, at = np.unique(y, return_inverse=True)
            order = np.argsort(at, kind="stable")
            step = max(1, L.CELLS // (reps * width))
            edges = np.searchsorted(at[order], np.arange(0, len(values) + step, step))
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if a == b:
                    continue
                own = values[k * step : (k + 1) * step]
                counts = np.zeros((len(own), reps * width), dtype=np.int64)
                here = order[a:b]
                single = here[rows[here] == 0]
                if len(single):
                    block = np.frombuffer(b"".join([blocks[i] for i in single]), dtype).reshape(len(single), reps).astype(np.int64)
                    flat = (at[single] - k * step)[:, None] * (reps * width) + width * np.arange(reps) + block
                    counts += np.bincount(flat.ravel(), minlength=counts.size).reshape(counts.shape)
                for i in here[rows[here] > 0]:
                    counts[at[i] - k * step] += np.frombuffer(blocks[i], np.int64)
                yield own, counts

        return run

    def table(self) -> DataFrame:
        """(rep, transition, block, y): a row for each delay and replicate."""
        counted, reps, width = self._counts(), self.replicates, self.width

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name in set(b.column("transition").to_pylist()):
                    own = b.filter(pa.compute.equal(b.column("transition"), name))
                    for y, counts in counted(own.column("y").to_numpy(), own.column("rows").to_numpy(), own.column("blocks").to_pylist()):
                        i, cell = np.nonzero(counts)
                        times = counts[i, cell]
                        i, cell = np.repeat(i, times), np.repeat(cell, times)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array((cell // width).astype(np.int32)), pa.array((cell % width).astype(np.int32)), pa.array(y[i])], names=["transition", "rep", "at", "y"])

        each = self.rows.mapInArrow(expand, "transition string, rep int, at int, y double")
        return each.join(F.broadcast(self.blocks), "transition").select("rep", "transition", F.col("blocks")[F.col("at")]["block"].alias("block"), "y")

    def sums(self) -> DataFrame:
        """(rep, transition, block, n, burden): how many delays each block has in each replicate, and their sum; summed by each task first."""
        counted, reps, width = self._counts(), self.replicates, self.width

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name in set(b.column("transition").to_pylist()):
                    own = b.filter(pa.compute.equal(b.column("transition"), name))
                    n, s = np.zeros(reps * width, np.int64), np.zeros(reps * width)
                    for y, counts in counted(own.column("y").to_numpy(), own.column("rows").to_numpy(), own.column("blocks").to_pylist()):
                        n += counts.sum(axis=0)
                        s += y @ counts
                    cell = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array((cell // width).astype(np.int32)), pa.array((cell % width).astype(np.int32)), pa.array(n[cell]), pa.array(s[cell])], names=["transition", "rep", "at", "n", "burden"])

        each = self.rows.mapInArrow(total, "transition string, rep int, at int, n long, burden double").groupBy("transition", "rep", "at").agg(F.sum("n").alias("n"), F.sum("burden").alias("burden"))
        return each.join(F.broadcast(self.blocks), "transition").select("rep", "transition", F.col("blocks")[F.col("at")]["block"].alias("block"), "n", "burden")

    def distances(self) -> DataFrame:
        """(transition, rep, at, d): the distance of each block of `min_block` rows from all rows, or from all others."""
        counted, reps, width, cfg = self._counts(), self.replicates, self.width, self.cfg
        rows = _kept(self.rows)  # counted, then measured

        def count(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            total = sum(c.sum(axis=0) for _, c in counted(own["y"].to_numpy(), own["rows"].to_numpy(), list(own["blocks"])))
            return pd.DataFrame({"transition": [key[0]], "slice": [key[1]], "first": [own["y"].min()], "counts": [total.tobytes()]})

        def carry(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("slice")
            table = np.array([np.frombuffer(x, np.int64) for x in own["counts"]])
            before = np.cumsum(table, axis=0) - table
            total = table.sum(axis=0).tobytes()
            return pd.DataFrame({"transition": own["transition"], "slice": own["slice"], "next": [*own["first"].iloc[1:], None], "before": [x.tobytes() for x in before], "total": [total] * len(own)})

        def measure(key: tuple, own: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
            before, total = (np.frombuffer(info[x].iloc[0], np.int64).reshape(reps, width) for x in ("before", "total"))
            good, n = np.flatnonzero(total[0] >= cfg.min_block), total[0].sum()
            ends, d = info["next"].iloc[0], np.zeros((reps, len(good)))
            parts = counted(own["y"].to_numpy(), own["rows"].to_numpy(), list(own["blocks"]))
            part = next(parts, None)
            while part is not None:
                (y, counts), part = part, next(parts, None)
                after = part[0][0] if part is not None else y[-1] if pd.isna(ends) else ends
                gaps = np.diff(y, append=after)
                upto = before + np.cumsum(counts.reshape(len(y), reps, width), axis=0)
                pool = upto[:, 0].sum(axis=1) / n  # every replicate has the same values
                d += np.einsum("yrb,y->rb", np.abs(upto[:, :, good] / total[0, good] - pool[:, None, None]), gaps)
                before = upto[-1]
            if cfg.reference == "leave_one_block_out":
                rest = n - total[0, good]
                d = np.where(rest > 0, d * n / np.maximum(rest, 1), np.nan)[:, :]
            rep, at = np.indices(d.shape)
            out = pd.DataFrame({"transition": key[0], "rep": rep.ravel(), "at": good[at.ravel()], "d": d.ravel()})
            return out[out["d"].notna()]

        slices = rows.groupBy("transition", "slice").applyInPandas(count, "transition string, slice int, first double, counts binary")
        carried = slices.groupBy("transition").applyInPandas(carry, "transition string, slice int, next double, before binary, total binary")
        done = rows.groupBy("transition", "slice").cogroup(carried.groupBy("transition", "slice")).applyInPandas(measure, "transition string, rep int, at int, d double")
        return done.groupBy("transition", "rep", "at").agg(F.sum("d").alias("d"))
