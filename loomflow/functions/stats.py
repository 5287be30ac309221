"""Weighted distributions as tables: running sums, CVaR, Wasserstein distances, rank correlations.

Running sums over a key's values are split by ranges of the value, so that a key with
a third of all rows is no single task: within a range a window sums, and the ranges'
totals, at most `bins` a key, are summed before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256
#: Ranges of values are even in log(1 + FINE * value / top), so that the many small values do not share one.
FINE = 1e6


def place(value: Column, top: float, bins: int) -> Column:
    """The range, 0 to `bins`, of a value; larger values have no smaller one."""
    return F.least(F.floor(F.log1p(F.greatest(value, F.lit(0.0)) * F.lit(FINE / top)) * F.lit(bins / math.log1p(FINE))), F.lit(bins)).cast("int")


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, str], top: float, descending: bool = False, bins: int = BINS) -> DataFrame:
    """`df` with, for each name: column of `sums`, the sum of the column over the key's values up to the row's (from above if descending)."""
    own = df.withColumn("__bin", place(F.col(value), top, bins))
    order = F.col(value).desc() if descending else F.col(value).asc()
    inner = Window.partitionBy(*keys, "__bin").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(F.col("__bin").desc() if descending else F.col("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*keys, "__bin").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    totals = totals.select(*keys, "__bin", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    within = own.select("*", *[F.sum(c).over(inner).alias(n) for n, c in sums.items()])
    joined = within.join(totals, [*keys, "__bin"])
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def cvar(pmf: DataFrame, keys: list[str], tail: float, top: float, value: str = "y", weight: str = "w") -> DataFrame:
    """(keys, n, mean, cvar): weighted CVaR with a fractional tail; null without mass."""
    total = pmf.groupBy(*keys).agg(F.sum(weight).alias("n"), (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))
    mass = F.col("n") * F.lit(tail)
    take = F.greatest(F.lit(0.0), F.least(F.col(weight).cast("double"), mass - (F.col("__cum") - F.col(weight))))
    cum = running(pmf, keys, value, {"__cum": weight}, top, descending=True).join(total, keys)
    worst = cum.groupBy(*keys).agg(F.sum(F.col(value) * take).alias("s"))
    return total.join(worst, keys).select(*keys, "n", "mean", F.when(mass > 0, F.col("s") / mass).alias("cvar"))


def number(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def robust(cvar: Column, eps: Column, cap: float | Column, tail: float | Column) -> Column:
    """Closed-form worst-case CVaR within a Wasserstein radius on [0, cap]."""
    return F.least(number(cap), cvar + F.greatest(F.lit(0.0), eps) / number(tail))


def saturation(cvar: Column, cap: float | Column, tail: float | Column) -> Column:
    """The radius at which the worst case reaches the cap."""
    return F.greatest(F.lit(0.0), number(tail) * (number(cap) - cvar))


def transport(pmf: DataFrame, keys: list[str], cap: float, tail: float, value: str = "y", weight: str = "w") -> DataFrame:
    """(keys, threshold): cost of moving the highest values below the cap up to it until the tail is full."""
    total = pmf.groupBy(*keys).agg(F.sum(weight).alias("n"), F.sum(F.when(F.col(value) >= cap, F.col(weight)).otherwise(0)).alias("at_cap"))
    below = pmf.where(F.col(value) < cap)
    cum = running(below, keys, value, {"__cum": weight}, cap, descending=True).join(total, keys)
    missing = F.greatest(F.lit(0.0), F.lit(tail) - F.col("at_cap") / F.col("n"))
    p, prev = F.col(weight) / F.col("n"), (F.col("__cum") - F.col(weight)) / F.col("n")
    cost = cum.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0.0), F.least(p, missing - prev)) * (F.lit(float(cap)) - F.col(value))).alias("threshold"))
    return total.select(*keys).join(cost, keys, "left").select(*keys, F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def wasserstein(pmf: DataFrame, keys: list[str], side: str, top: float, value: str = "y", weight: str = "w") -> DataFrame:
    """(keys, w1): distance between the two sides (0 and 1 in column `side`) of each key, exact, no sampling."""
    total = pmf.groupBy(*keys).agg(*[F.sum(F.when(F.col(side) == s, F.col(weight)).otherwise(0)).alias(f"n{s}") for s in (0, 1)])
    points = pmf.groupBy(*keys, value).agg(*[F.sum(F.when(F.col(side) == s, F.col(weight)).otherwise(0)).alias(f"w{s}") for s in (0, 1)])
    cum = running(points, keys, value, {"c0": "w0", "c1": "w1"}, top)
    step = spaced(cum, keys, value, top).join(total, keys)
    gap = F.abs(F.col("c0") / F.col("n0") - F.col("c1") / F.col("n1")) * F.col("dx")
    return step.where("n0 > 0 and n1 > 0").groupBy(*keys).agg(F.sum(gap).alias("w1"))


def spaced(df: DataFrame, keys: list[str], value: str, top: float, bins: int = BINS) -> DataFrame:
    """`df` with dx, the gap to the key's next value (null at its last), by ranges as in running()."""
    own = df.withColumn("__bin", place(F.col(value), top, bins))
    firsts = own.groupBy(*keys, "__bin").agg(F.min(value).alias("__first"))
    after = Window.partitionBy(*keys).orderBy("__bin")
    firsts = firsts.select(*keys, "__bin", F.lead("__first").over(after).alias("__next"))
    inner = Window.partitionBy(*keys, "__bin").orderBy(value)
    out = own.withColumn("__lead", F.lead(value).over(inner)).join(firsts, [*keys, "__bin"])
    return out.select(*df.columns, (F.coalesce("__lead", "__next") - F.col(value)).alias("dx"))


def kendall(df: DataFrame, keys: list[str], item: str, x: str, y: str) -> DataFrame:
    """(keys, tau): tau-b over pairs of a key's items; for score tables, which have as many rows as transitions. Null under three rows or if constant."""
    a = df.select(*keys, F.col(item).alias("ia"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = df.select(*keys, F.col(item).alias("ib"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    pairs = a.join(b, keys).where("ia < ib")
    sx, sy = F.signum(F.col("xa") - F.col("xb")), F.signum(F.col("ya") - F.col("yb"))
    agg = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), F.sum(sx * sy).alias("s"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"))
    return agg.select(*keys, F.when(F.col("pairs") >= 3, F.col("s") / F.nullif(F.sqrt(F.col("nx") * F.col("ny")), F.lit(0.0))).alias("tau"))  # three rows make three pairs


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, rho): correlation of average ranks; null under three rows or if constant."""
    def rank(c: str) -> Column:
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    ranked = df.select(*keys, rank(x).alias("rx"), rank(y).alias("ry"))
    agg = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"), F.min("rx").alias("a"), F.max("rx").alias("b"), F.min("ry").alias("c"), F.max("ry").alias("d"))
    return agg.select(*keys, F.when((F.col("n") >= 3) & (F.col("a") < F.col("b")) & (F.col("c") < F.col("d")), F.col("rho")).alias("rho"))


def summary(value: str) -> list[Column]:
    """Nine numbers of a column; exact linear quantiles."""
    q = lambda p, n: F.percentile(F.col(value), F.lit(p)).alias(n)
    return [F.count(value).alias("count"), F.avg(value).alias("mean"), q(0.5, "median"), q(0.75, "p75"), q(0.9, "p90"), q(0.95, "p95"), q(0.99, "p99"), F.max(value).alias("max"), F.sum(value).alias("total")]


#: Ranges of values within which those of a whole table are put in order.
RANGES = 1 << 12
QUANTILES = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def nine(df: DataFrame, value: str, top: float) -> DataFrame:
    """The nine numbers of summary() over a whole table, one row: values are put in order within ranges up to `top`, so no task holds all of them."""
    total = df.agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.sum(value).alias("total"))
    pmf = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__w"))
    cum = running(pmf, [], value, {"__upto": "__w"}, top, bins=RANGES).crossJoin(F.broadcast(total.select("count")))  # one row
    at = {n: (F.col("count") - 1) * F.lit(p) for n, p in QUANTILES.items()}
    ranked = lambda r: F.max(F.when((F.col("__upto") > r) & (F.col("__upto") - F.col("__w") <= r), F.col(value)))
    ends = cum.agg(*[ranked(f(x)).alias(f"__{n}_{k}") for n, x in at.items() for k, f in (("lo", F.floor), ("hi", F.ceil))])
    linear = {n: F.when(F.floor(x) == F.ceil(x), F.col(f"__{n}_lo")).otherwise((F.ceil(x) - x) * F.col(f"__{n}_lo") + (x - F.floor(x)) * F.col(f"__{n}_hi")).alias(n) for n, x in at.items()}
    return total.crossJoin(F.broadcast(ends)).select("count", "mean", *linear.values(), "max", "total")
