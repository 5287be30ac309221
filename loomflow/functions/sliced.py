"""Work on each key's values in order, split into slices of bounded size.

A slice holds a range of one key's values, so a key with a third of all rows is many
tasks. What a slice must know of those before it is a row of counts, carried over by
summing the slices' own counts. All replicates of a resampling are worked out from one
histogram, within the slice: rows are never multiplied by the replicates.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomflow.functions.stats import place

#: Rows of a slice, about; ranges that slices are made of.
ROWS, RANGES = 4096, 1 << 14
#: Weights of rows by replicates that are held at once.
CELLS = 1 << 22
#: Roots of the number of clusters that are drawn one by one; clusters up to which the driver sums a drawing.
SPARE, DRIVEN = 4.0, 1 << 14
_ODD = np.uint64(0x9E3779B97F4A7C15)


def sliced(df: DataFrame, keys: list[str], value: str, top: float, rows: int = ROWS, parts: int | None = None, salt: str | None = None) -> DataFrame:
    """`df` with `slice`: ranges of a key's values, in order, of about `rows` rows each.

    A value that many rows share makes a slice larger; with `parts` it has `part`, by the hash of `salt`, each of about so many rows.
    """
    ranged = df.withColumn("__range", place(F.col(value), top, RANGES))
    counts = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    slices = counts.select(*keys, "__range", F.floor(before / rows).cast("int").alias("slice"))
    if parts is None:
        return ranged.join(slices, [*keys, "__range"]).drop("__range")
    slices = slices.join(counts, [*keys, "__range"]).withColumn("__parts", F.ceil(F.sum("__n").over(Window.partitionBy(*keys, "slice")) / parts)).drop("__n")
    return ranged.join(slices, [*keys, "__range"]).withColumn("part", F.pmod(F.xxhash64(salt), F.col("__parts")).cast("int")).drop("__range", "__parts")


def carried(slices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slice, blocks, before, total, next): counts of each block below a slice, in all, and the first value of the next slice."""
    types = {f.name: f.dataType.simpleString() for f in slices.schema}
    own = slices.groupBy(*keys, "slice", "block").agg(F.sum("c").alias("c"), F.min("y").alias("y"))

    def prefix(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        blocks, at = np.unique(frame["block"], return_inverse=True)
        order, row = np.unique(frame["slice"], return_inverse=True)
        table = np.zeros((len(order), len(blocks)))
        table[row, at] = frame["c"]
        first = np.full(len(order), np.inf)
        np.minimum.at(first, row, frame["y"].to_numpy())
        total = table.sum(axis=0)
        before = np.cumsum(table, axis=0) - table
        out = pd.DataFrame({k: [frame[k].iloc[0]] * len(order) for k in keys})
        out["slice"], out["blocks"], out["before"], out["total"] = order, [blocks] * len(order), list(before), [total] * len(order)
        out["next"] = [*first[1:], None]
        return out

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", slice int, blocks array<int>, before array<double>, total array<double>, next double"
    return own.groupBy(*keys).applyInPandas(prefix, schema)


@dataclass(frozen=True)
class Spec:
    """What a fit needs of a histogram; `rep` numbers it."""

    rep: int
    cap: float
    tail: float
    min_block: int
    leave_out: bool = False


@dataclass(frozen=True)
class Way:
    """A way to count a histogram of fine blocks: the first `last` of them (all, if none), `width` to a block (one block, if none), and values capped and snapped to a grid."""

    last: float | None
    width: float | None
    cap: float
    grid: float | None = None

    def values(self, y: np.ndarray) -> np.ndarray:
        y = np.minimum(y, self.cap)
        return np.clip(np.rint(y / self.grid) * self.grid, 0.0, self.cap) if self.grid else y

    def blocks(self, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the fine blocks that count, the blocks, and which of these each belongs to."""
        own = np.flatnonzero(fine < self.last) if self.last is not None else np.arange(len(fine))
        block, at = np.unique(np.floor(fine[own] / self.width) if self.width is not None else np.zeros(len(own)), return_inverse=True)
        return own, block.astype(np.int64), at


def calibrations(hist: DataFrame, keys: list[str], specs: list[Spec] | dict[str, dict[Way, list[Spec]]], weights: np.ndarray | None = None, rows: int = ROWS) -> DataFrame:
    """(keys, rep, block, weight, d, n, s, worst, top): what each fit is made of.

    `hist` is (keys, block, y, c); `specs` are the fits of every key, or for each value of
    the first key those of each way to count it. All ways are worked out within a slice, as
    they keep the order of the values: rows are not multiplied by them. `weights` has a row for each replicate (numbered from a fit's rep on)
    and a column for each block, and is all ones if not given. Rows of block -1 have the
    total weight n, sum s, sum of the worst tail and weight at the cap; the others the
    distance d of each block of `min_block` rows from all rows, or from all others if
    `leave_out`, null where there are no others.
    """
    every = [x for v in specs.values() for xs in v.values() for x in xs] if isinstance(specs, dict) else specs
    slices = sliced(hist.select(*keys, F.col("block").cast("int").alias("block"), "y", "c"), keys, "y", max(x.cap for x in every), rows)
    types = {f.name: f.dataType.simpleString() for f in slices.schema}

    def pieces(_: tuple, own: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        info = carry.iloc[0]
        blocks, before, total = (np.asarray(info[x]) for x in ("blocks", "before", "total"))
        ys, at = np.unique(own["y"], return_inverse=True)
        counts = np.zeros((len(blocks), len(ys)))
        np.add.at(counts, (np.searchsorted(blocks, own["block"]), at), own["c"])
        ends = np.append(ys, ys[-1] if pd.isna(info["next"]) else info["next"])
        sums, gone = [np.zeros((0, 5))], [np.zeros((0, 4))]
        if not isinstance(specs, dict):
            fits(specs, blocks, before, total, counts, ends, sums, gone)
        else:
            for way, some in specs[own[keys[0]].iloc[0]].items():
                rows, block, group = way.blocks(blocks)
                if len(rows):
                    joined = [np.zeros((len(block), *x.shape[1:])) for x in (before, total, counts)]
                    for out, x in zip(joined, (before, total, counts)):
                        np.add.at(out, group, x[rows])
                    fits(some, block, *joined, way.values(ends), sums, gone)
        all_sums, far = np.vstack(sums), np.vstack(gone)
        k, zero = len(all_sums), np.zeros(len(far))
        out = pd.DataFrame({"rep": np.append(all_sums[:, 0], far[:, 0]).astype(int), "block": np.append(np.full(k, -1), far[:, 1]).astype(int), "weight": np.append(np.zeros(k), far[:, 2]).astype(int), "d": np.append(np.zeros(k), far[:, 3])})
        for place_of, name in enumerate(("n", "s", "worst", "top"), start=1):
            out[name] = np.append(all_sums[:, place_of], zero)
        for key in keys:
            out[key] = own[key].iloc[0]
        if np.isnan(far[:, 3]).any():
            out["d"] = out["d"].astype(object).where(out["d"].notna(), None)
        return out

    def fits(some: list[Spec], blocks: np.ndarray, before: np.ndarray, total: np.ndarray, counts: np.ndarray, ends: np.ndarray, sums: list, gone: list) -> None:
        """Adds what the fits have of a slice: counts of each block by value, and the values with the one that follows."""
        ys, gaps = ends[:-1], np.diff(ends)
        upto = before[:, None] + np.cumsum(counts, axis=1)
        all_w = np.ones((1, len(blocks))) if weights is None else weights[:, blocks]
        step = max(1, CELLS // max(1, len(ys)))
        for spec in some:
            good = np.flatnonzero(total >= spec.min_block)
            shares = upto[good] / total[good, None]
            for first in range(0, len(all_w), step):
                w = all_w[first : first + step]
                n = w @ total
                reps = spec.rep + first + np.arange(len(w))
                weight, below = w @ counts, w @ upto
                take = np.clip((n * spec.tail)[:, None] - (n[:, None] - below), 0.0, weight)
                sums.append(np.column_stack([reps, weight.sum(axis=1), weight @ ys, take @ ys, weight[:, ys >= spec.cap].sum(axis=1)])[n > 0])
                pooled = below / np.maximum(n, 1)[:, None]
                if len(w) < len(good):
                    d = np.array([np.abs(shares - row) @ gaps for row in pooled]).reshape(len(w), len(good))
                else:
                    d = np.array([np.abs(row - pooled) @ gaps for row in shares]).reshape(len(good), len(w)).T
                if spec.leave_out:  # what is left of the pool without the block is as far from it, by the share that is left
                    rest = n[:, None] - w[:, good] * total[good]
                    d = np.where(rest > 0, d * n[:, None] / np.maximum(rest, 1), np.nan)
                r, b = np.nonzero(w[:, good] > 0)
                gone.append(np.column_stack([reps[r], blocks[good][b], w[:, good][r, b], d[r, b]]))

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", rep int, block int, weight int, d double, n double, s double, worst double, top double"
    by = [*keys, "slice"]
    done = slices.groupBy(*by).cogroup(carried(slices, keys).groupBy(*by)).applyInPandas(pieces, schema)
    return done.groupBy(*keys, "rep", "block").agg(F.first("weight").alias("weight"), *[F.sum(x).alias(x) for x in ("d", "n", "s", "worst", "top")])


def resampled(pmf: DataFrame, keys: list[str], cap: float, tail: float, replicates: int, weigh: Callable[[np.ndarray], np.ndarray], rows: int = ROWS) -> DataFrame:
    """(keys, rep, s, worst): sums of all values and of the worst `tail` of each replicate.

    `pmf` is (keys, cluster, y, c); `weigh` gives the weights of an array of clusters, a row
    for each and a column for each replicate. Slices are summed first. A replicate's tail
    ends within one slice of a key; only such slices are looked into.
    """
    slices = sliced(pmf.select(*keys, "cluster", "y", "c"), keys, "y", cap, rows)
    types = {f.name: f.dataType.simpleString() for f in slices.schema}
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    by = [*keys, "slice"]

    def blocks_of(own: pd.DataFrame):
        """Rows of a slice with their weights in whole numbers of each replicate, a part at a time."""
        own = own.sort_values(["y", "cluster"], ascending=False)
        step = max(1, CELLS // max(1, replicates))
        for first in range(0, len(own), step):
            part = own.iloc[first : first + step]
            clusters, at = np.unique(part["cluster"], return_inverse=True)
            yield part["y"].to_numpy(), weigh(clusters)[at] * part["c"].to_numpy()[:, None]

    def sums(_: tuple, own: pd.DataFrame) -> pd.DataFrame:
        w, s = np.zeros(replicates), np.zeros(replicates)
        for y, weight in blocks_of(own):
            w += weight.sum(axis=0)
            s += y @ weight
        out = pd.DataFrame({"rep": np.arange(replicates), "w": w, "s": s})
        for k in by:
            out[k] = own[k].iloc[0]
        return out

    each = slices.groupBy(*by).applyInPandas(sums, f"{head}, slice int, rep int, w double, s double")
    whole = Window.partitionBy(*keys, "rep")
    above = F.sum("w").over(whole.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    each = each.select("*", above.alias("above"), (F.sum("w").over(whole) * F.lit(tail)).alias("mass"))
    room = F.col("mass") - F.col("above")
    each = each.withColumn("room", F.when((room > 0) & (room < F.col("w")), room))
    ends = each.where("room is not null").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rep", "room"))).alias("ends"))

    def looked(_: tuple, own: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        reps = np.array([x["rep"] for x in ends["ends"].iloc[0]], dtype=np.int64) if len(ends) else np.zeros(0, np.int64)
        left = np.array([x["room"] for x in ends["ends"].iloc[0]]) if len(ends) else np.zeros(0)
        got = np.zeros(len(reps))
        if len(own):
            for y, weight in blocks_of(own):
                weight = weight[:, reps]
                before = np.cumsum(weight, axis=0) - weight
                got += y @ np.clip(left - before, 0, weight)
                left = np.maximum(left - weight.sum(axis=0), 0)
        out = pd.DataFrame({"rep": reps, "part": got})
        for k in keys:
            out[k] = ends[k].iloc[0] if len(ends) else None
        return out

    some = slices.join(ends.select(*by), by, "left_semi")
    parts = some.groupBy(*by).cogroup(ends.groupBy(*by)).applyInPandas(looked, f"{head}, rep int, part double")
    full = each.groupBy(*keys, "rep").agg(F.sum("s").alias("s"), F.sum(F.when(F.col("room").isNull() & (F.col("above") < F.col("mass")), F.col("s")).otherwise(0.0)).alias("full"))
    return full.join(parts, [*keys, "rep"], "left").select(*keys, "rep", "s", (F.col("full") + F.coalesce("part", F.lit(0.0))).alias("worst"))


class Calendar:
    """Draws with replacement of a few calendar clusters: a row of weights for each replicate, that sum to the number of clusters."""

    def __init__(self, clusters: int, replicates: int, seed: int):
        rng = np.random.default_rng(seed)
        self.weights = np.array([np.bincount(rng.integers(0, clusters, clusters), minlength=clusters) for _ in range(replicates)])

    def __call__(self, clusters: np.ndarray) -> np.ndarray:
        return self.weights[:, clusters].T.astype(np.float64)


class Splitting:
    """Draws with replacement of any number of clusters 0 .. size - 1, which no table holds.

    A cluster's weight in a replicate is a Poisson number, by a hash of both alone, and
    what further draws add to it. Poisson numbers of a given sum are that many draws; they
    are made a little too small, and the few draws that a replicate lacks of `size` are
    made one by one. So any task has the same weights for a cluster, each costs one hash,
    and all weights of a replicate sum to `size`. `total` gives the sums of a drawing's
    Poisson numbers; a replicate that exceeds `size` is drawn by another hash.
    """

    def __init__(self, size: int, replicates: int, seed: int, total: Callable[[Splitting], np.ndarray] | None = None):
        self.size, self.replicates, self.seed = size, replicates, seed
        self.turn = np.zeros(replicates, dtype=np.int64)
        mean = max(0.0, 1 - SPARE / math.sqrt(max(1, size)))
        below = np.cumsum([math.exp(-mean) * mean**k / math.factorial(k) for k in range(20)])
        self.least = [int(x * 2**32) for x in below if x < 1 - 2**-32]  # from which a uniform number of 32 bits counts one more
        while True:
            sums = self._whole() if total is None else total(self)
            over = sums > size
            if not over.any():
                break
            self.turn[over] += 1
        self.left = tuple(int(x) for x in size - sums)

    def _whole(self) -> np.ndarray:
        return sum((self.poisson(np.arange(k, min(self.size, k + 4096))).sum(axis=0, dtype=np.int64) for k in range(0, self.size, 4096)), np.zeros(self.replicates, dtype=np.int64))

    def poisson(self, clusters: np.ndarray) -> np.ndarray:
        """Poisson numbers of the clusters, a column for each replicate."""
        out = self._poisson(clusters, 0, -(-self.replicates // 2))[:, : self.replicates]
        for rep in np.flatnonzero(self.turn):
            out[:, rep] = self._poisson(clusters, 1 + int(self.turn[rep]) * self.replicates + int(rep), 1)[:, 0]
        return out

    def _poisson(self, clusters: np.ndarray, first: int, pairs: int) -> np.ndarray:
        own = _hashed(np.asarray(clusters).astype(np.uint64) + np.uint64(self.seed * int(_ODD) % (1 << 64)))
        lane = _hashed((np.arange(pairs, dtype=np.uint64) + np.uint64(first << 20)) * _ODD + np.uint64(1))
        u = _hashed(own[:, None] ^ lane).view(np.uint32)
        out = np.zeros(u.shape, dtype=np.uint8)
        for least in self.least[:3]:
            out += u >= np.uint32(least)
        if len(self.least) > 3:
            many = np.nonzero(u >= np.uint32(self.least[3]))
            out[many] += np.searchsorted(np.array(self.least[3:]), u[many].astype(np.int64), side="right").astype(np.uint8)
        return out

    def __call__(self, clusters: np.ndarray) -> np.ndarray:
        clusters = np.asarray(clusters, dtype=np.int64)
        out = self.poisson(clusters).astype(np.float64)
        drawn, rep = _draws(self.size, self.left, self.seed)
        low, high = np.searchsorted(drawn, clusters, "left"), np.searchsorted(drawn, clusters, "right")
        per = high - low
        row = np.repeat(np.arange(len(clusters)), per)
        np.add.at(out, (row, rep[np.arange(len(row)) + np.repeat(low - (np.cumsum(per) - per), per)]), 1)
        return out


@lru_cache(maxsize=4)
def _draws(size: int, left: tuple[int, ...], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, replicate) of the draws that replicates lack, in order of clusters: some SPARE roots of `size` each."""
    drawn = np.random.default_rng([seed, size]).integers(0, max(1, size), sum(left))
    order = np.argsort(drawn, kind="stable")
    return drawn[order], np.repeat(np.arange(len(left), dtype=np.int32), left)[order]


def _hashed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def splitting(spark: SparkSession, size: int, replicates: int, seed: int) -> Splitting:
    """Splitting(), of many clusters with sums from tasks; the driver gets a row for each replicate."""

    def total(drawing: Splitting) -> np.ndarray:
        def sums(frames):
            out = np.zeros(replicates, dtype=np.int64)
            for frame in frames:
                for k in frame["id"]:
                    out += drawing.poisson(np.arange(k * 4096, min(size, (k + 1) * 4096))).sum(axis=0, dtype=np.int64)
            yield pd.DataFrame({"rep": np.arange(replicates), "w": out})

        got = spark.range(-(-size // 4096)).mapInPandas(sums, "rep int, w long").groupBy("rep").agg(F.sum("w").alias("w")).toPandas()
        return got.sort_values("rep")["w"].to_numpy(np.int64)

    return Splitting(size, replicates, seed, total if size > DRIVEN else None)


def numbered(df: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """`df` with its distinct values of `column` numbered from 0 in order of a hash, and how many there are; null is a value.

    Places are found within ranges of the hash, and after the ranges before.
    """
    values = df.select(F.col(column).alias("__v")).distinct().withColumn("__h", F.xxhash64("__v")).withColumn("__range", F.shiftright("__h", 56))
    ends = values.groupBy("__range").agg(F.count("*").alias("n"))  # 256 rows
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    within = F.row_number().over(Window.partitionBy("__range").orderBy("__h", "__v")) - 1
    places = values.withColumn("__k", within).join(ends.select("__range", before.alias("__before")), "__range").select("__v", (F.col("__k") + F.col("__before")).cast("long").alias(name))
    out = df.join(places, F.col(column).eqNullSafe(F.col("__v"))).drop("__v")
    return out, values.count()  # one number for the driver
