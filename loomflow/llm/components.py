"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.llm.tables import written

#: Edges of a partition, and edges up to which a round is dealt by us, in so few partitions that their number costs nothing.
TOGETHER, FEW = 250_000, 2_000_000


def _dealt(edges: DataFrame, n: int) -> DataFrame:
    """Edges by u, in few partitions if there are few; else as the session's settings and skew joins have it."""
    return edges.repartition(-(-2 * n // TOGETHER) or 1, "u") if n <= FEW else edges


def _toward_smallest(pairs: DataFrame, small: bool, few: bool) -> DataFrame:
    """One star step: the neighbours of each node are moved to the smallest of them (large: those above the node, small: those below)."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(low.hint("merge") if few else low, "u")
    if small:
        moved = joined.where((F.col("v") < F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("v"), "m")
        return moved.unionByName(low.where("m < u").select(F.col("u").alias("v"), "m"))
    return joined.where(F.col("v") > F.col("u")).select("v", "m")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes of `edges` (u, v).

    Rounds of large and small stars, each written to the shared folder, until no edge
    moves. A hot node costs no list: all steps are aggregates and joins.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = now.count()
    few, mark = n <= FEW, None
    for _ in range(most):
        both = _dealt(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
        large = _toward_smallest(both, False, few).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = _dealt(large, n).distinct()
        now = _toward_smallest(large, True, few).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = written(_dealt(now, n).distinct(), "edges")
        got = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if got == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = got
    raise RuntimeError("components did not settle")
