"""Whitening of embeddings by hierarchical merging of singular value decompositions.

A state is what a set of vectors comes down to: their number, their exact sums, and
singular values and vectors of the centred vectors, at full rank. Two states merge by
another decomposition of their scaled vectors and one row for the difference of their
means, so no covariance is ever squared up and nothing is lost. Each task merges its
Arrow batches into one state, and states merge in groups until one is left; its size
is that of the dimensions squared, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.llm.tables import written

#: Whole numbers are floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: States that one task merges; vectors that are decomposed together.
GROUP, ROWS = 8, 4096
#: Components of smaller eigenvalues, as a part of the largest, are not scaled: no direction is left in them.
RANK = 1e-12
LARGEST = float(2**40)
_LIMIT = 2**62

STATE = "part int, n long, sums array<bigint>, values array<double>, vectors binary"


@dataclass
class State:
    """`sums` are of whole numbers less SHIFT; the rows of `vectors` belong to the singular values."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors, as many as there are dimensions."""
    d = rows.shape[1]
    if len(rows) < d:
        rows = np.vstack([rows, np.zeros((d - len(rows), d))])
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def state_of(z: np.ndarray) -> State:
    sums = z.sum(axis=0)
    return State(len(z), sums, *_decomposed(z - sums / len(z)))


def merged(a: State, b: State) -> State:
    between = np.sqrt(a.n / (a.n + b.n) * b.n) * (a.mean - b.mean)
    rows = np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, between[None, :]])
    return State(a.n + b.n, a.sums + b.sums, *_decomposed(rows))


def _packed(part: int, s: State) -> pd.DataFrame:
    return pd.DataFrame([(part, s.n, s.sums.tolist(), s.values.tolist(), s.vectors.tobytes())], columns=["part", "n", "sums", "values", "vectors"])


def _unpacked(r) -> State:
    values = np.asarray(r["values"], dtype=np.float64)
    return State(int(r["n"]), np.asarray(r["sums"], dtype=np.int64), values, np.frombuffer(r["vectors"], dtype=np.float64).reshape(len(values), -1))


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * entry) of a list column without nulls, within LARGEST, so that sums of them stay longs."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    return np.clip(flat, -LARGEST, LARGEST).astype(np.int64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Not null, and neither null nor non-finite entries."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _joined(states: DataFrame, merge, schema: str, key: str = "part") -> DataFrame:
    """One row, by merging groups of neighbours again and again; a group's size does not grow with the data."""
    while True:
        states = written(states, "states")
        most = states.agg(F.max(key)).first()[0]
        if not most:
            return states
        # `written` above ends the lineage of each level
        states = states.groupBy(F.expr(f"{key} div {GROUP}").cast("int").alias("g")).applyInPandas(merge, schema)


def fitted(vectors: DataFrame, dim: int) -> State | None:
    """The state of all `vectors` (vector), of `dim` entries each; None if there are none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = None, None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            z = _whole(b.column(1), dim)
            for k in range(0, len(z), ROWS):
                s = state_of(z[k : k + ROWS])
                own = s if own is None else merged(own, s)
        if own is not None:
            yield pa.RecordBatch.from_pandas(_packed(part, own), schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("vectors", pa.binary())]), preserve_index=False)

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = None
        for _, r in frame.sort_values("part").iterrows():
            s = _unpacked(r)
            own = s if own is None else merged(own, s)
        return _packed(int(key[0]), own)

    states = vectors.select(F.spark_partition_id().alias("part"), "vector").mapInArrow(each, STATE)
    row = _joined(states, join, STATE).first()
    return None if row is None else _unpacked(row)


def _scatter(white: DataFrame, k: int) -> np.ndarray | None:
    """Covariance of the arrays `white` (null entries count as zero), centred task by task, with the means' differences added in merging."""
    schema = "part int, n long, mean array<double>, scatter binary"

    def pack(part: int, n: int, mean: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([(part, n, mean.tolist(), scatter.tobytes())], columns=["part", "n", "mean", "scatter"])

    def both(a, b):
        if a is None:
            return b
        (n, m, s), (n2, m2, s2) = a, b
        d = m2 - m
        return n + n2, m + d * (n2 / (n + n2)), s + s2 + np.outer(d, d) * (n / (n + n2) * n2)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = None, None
        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
                w = np.nan_to_num(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, k)
                m = w.mean(axis=0)
                own = both(own, (len(w), m, (w - m).T @ (w - m)))
        if own is not None:
            yield pa.RecordBatch.from_pandas(pack(part, *own), schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.binary())]), preserve_index=False)

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = None
        for _, r in frame.sort_values("part").iterrows():
            own = both(own, (int(r["n"]), np.asarray(r["mean"]), np.frombuffer(r["scatter"]).reshape(k, k)))
        return pack(int(key[0]), *own)

    row = _joined(white.select(F.spark_partition_id().alias("part"), "white").mapInArrow(each, schema), join, schema).first()
    return None if row is None else np.frombuffer(row["scatter"]).reshape(k, k) / row["n"]


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    Vectors that are null or hold null or non-finite entries drop, and so do those of
    another length than the commonest (of two, the larger). Whole numbers beyond 2**40
    count as 2**40. Components are numbered from
    1 by falling eigenvalue, and their largest entry is positive. Where no variance is
    left in a component its `whitened` is null and it takes no part in `identity_error`;
    `explained` is null if there is no variance at all, `deviation` if it exceeds a long.
    An empty table, or one of empty vectors, gives no rows. Repeated rows count each. Other columns are ignored.
    """
    good = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col(vector_col)))
    length = good.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim = length["dim"] if length else 0
    same = good.where(F.size("vector") == dim)
    state = fitted(same.select("vector"), dim) if dim else None
    out_schema = f"{id_col} {table.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if state is None:
        return table.sparkSession.createDataFrame([], out_schema)
    k, n, sums = min(components, dim), state.n, state.sums
    e = state.values**2 / n
    axes = state.vectors[:k]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)
    live = e[:k] > RANK * e[0] if e[0] > 0 else np.zeros(k, dtype=bool)
    scale = np.where(live, 1 / np.sqrt(np.where(live, e[:k], 1.0)), np.nan)
    mean = state.mean

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                own = b.slice(start, ROWS)
                z = _whole(own.column(1), dim)
                white = ((z - mean) @ axes.T) * scale
                # n * x - S is the same for z, which is x less SHIFT; longs hold it unless their bound says otherwise.
                bound = (abs(z.astype(float)).max(initial=0.0) * n + float(np.abs(sums.astype(float)).max())) ** 2 * dim
                if bound < _LIMIT:
                    far = ((n * z - sums) ** 2).sum(axis=1).tolist()
                else:
                    wide = [sum((n * x - s) ** 2 for x, s in zip(row, sums.tolist())) for row in z.tolist()]
                    far = [x if x < 2**63 else None for x in wide]
                flat = pa.array(white.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, k), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(far, pa.int64()), lists], names=["id", "deviation", "white"])

    kind = table.schema[id_col].dataType.simpleString()
    white = written(same.mapInArrow(each, f"id {kind}, deviation long, white array<double>"), "white")
    error = None
    if live.any():
        error = float(np.abs(_scatter(white, k)[np.ix_(live, live)] - np.eye(int(live.sum()))).max())
    explained = F.array(*[F.lit(float(x / e.sum()) if e.sum() > 0 else None).cast("double") for x in e[:k]])
    rows = white.select("id", "deviation", F.posexplode("white").alias("place", "whitened"))
    return rows.select(
        F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
