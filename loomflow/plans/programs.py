"""Worst-case CVaR within a Wasserstein ball as programs over a bounded grid, beside the closed form.

The primal program moves mass along the grid: u of gap k is the mass that crosses it,
up or down, each unit at the gap's width; no point may lose more than it has. It is
solved for each transition and radius in a task, and the best threshold is found by
halving, since the value is convex in it. The greedy one takes moves to the cap in
order of gain per cost, by a running budget over windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.functions import stats as T
from loomflow.plans.checks import dual_risk

#: What counts as zero in a program's tableau; pivots after which the first, not the best, gain is taken, so that none repeats.
ZERO, PATIENCE = 1e-11, 500


def maximum(gains: np.ndarray, limits: np.ndarray, most: np.ndarray) -> float:
    """Largest gains @ v with limits @ v <= most and v >= 0; `most` is not negative, so that v = 0 is a start."""
    m, n = limits.shape
    table = np.zeros((m + 1, n + m + 1))
    table[:m, :n], table[:m, n : n + m], table[:m, -1] = limits, np.eye(m), most
    table[m, :n] = -gains
    for turn in range(100 * PATIENCE):
        price = table[m, :-1]
        entering = int(price.argmin()) if turn < PATIENCE else int((price < -ZERO).argmax())
        if price[entering] >= -ZERO:
            return float(table[m, -1])
        column = table[:m, entering]
        ratios = np.full(m, np.inf)
        np.divide(table[:m, -1], column, out=ratios, where=column > ZERO)
        leaving = int(ratios.argmin())
        if not np.isfinite(ratios[leaving]):
            raise ValueError("the program has no bound")
        table[leaving] /= table[leaving, entering]
        others = np.arange(m + 1) != leaving
        table[others] -= np.outer(table[others, entering], table[leaving])
    raise ValueError("the program did not end")


def worst_hinge(x: np.ndarray, p: np.ndarray, threshold: float, eps: float) -> float:
    """Largest mean of (value - threshold)+ over distributions on the points `x` within `eps` of `p`."""
    payoff = np.maximum(x - threshold, 0.0)
    if len(x) == 1:
        return float(payoff @ p)
    gaps = np.diff(x)
    flow = np.zeros((len(x), len(gaps)))  # what crosses gap k leaves point k and reaches point k + 1
    flow[np.arange(len(gaps)), np.arange(len(gaps))] = 1.0
    flow[np.arange(1, len(x)), np.arange(len(gaps))] = -1.0
    gain = np.diff(payoff)
    limits = np.vstack([np.hstack([flow, -flow]), np.hstack([gaps, gaps])])
    return float(payoff @ p) + maximum(np.hstack([gain, -gain]), limits, np.append(p, max(eps, 0.0)))


def worst_cvar(x: np.ndarray, p: np.ndarray, eps: float, tail: float) -> tuple[float, float]:
    """Least threshold + worst hinge / tail over thresholds on the grid, and that threshold."""
    known: dict[int, float] = {}

    def value(k: int) -> float:
        if k not in known:
            known[k] = float(x[k]) + worst_hinge(x, p, float(x[k]), eps) / tail
        return known[k]

    lo, hi = 0, len(x) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if value(mid) <= value(mid + 1) + 1e-12:
            hi = mid
        else:
            lo = mid + 1
    return value(lo), float(x[lo])


def primal_risk(pmf: DataFrame, eps: DataFrame, cap: float, tail: float, grid: float) -> DataFrame:
    """(transition, label, primal, threshold): the primal program. `pmf` (transition, y, w) lies on multiples of `grid` up to the cap; `eps` is (transition, label, eps)."""
    points = np.append(np.arange(0, cap, grid), cap)

    def solve(_: tuple, own: pd.DataFrame, radii: pd.DataFrame) -> pd.DataFrame:
        p = np.zeros(len(points))
        if len(own):
            np.add.at(p, np.searchsorted(points, own["y"] - 1e-9), own["w"])
        rows = [(r.transition, r.label, *worst_cvar(points, p / p.sum(), r.eps, tail)) for r in radii.itertuples()] if p.sum() > 0 else []
        return pd.DataFrame(rows, columns=["transition", "label", "primal", "threshold"])

    return pmf.groupBy("transition").cogroup(eps.groupBy("transition")).applyInPandas(solve, "transition string, label string, primal double, threshold double")


def greedy_risk(pmf: DataFrame, eps: DataFrame, cap: float, tail: float, grid: float) -> DataFrame:
    """(transition, label, greedy): moves of mass to the cap by falling gain per cost while the radius lasts, least over thresholds of the grid."""
    p = pmf.join(pmf.groupBy("transition").agg(F.sum("w").alias("n")), "transition").select("transition", "y", (F.col("w") / F.col("n")).alias("p"))
    top = F.lit(float(cap))
    t = F.explode(F.expr(f"array_distinct(array_append(transform(sequence(0, {int(cap // grid)}), k -> k * {float(grid)!r}D), {float(cap)!r}D))"))
    moves = p.join(eps, "transition").select("*", t.alias("t"))
    payoff = F.greatest(F.lit(0.0), F.col("y") - F.col("t"))
    gain, cost = F.greatest(F.lit(0.0), top - F.col("t")) - payoff, top - F.col("y")
    moves = moves.select("transition", "label", "t", "y", "eps", (F.col("p") * payoff).alias("base"), F.when(cost > 0, gain / cost).otherwise(0.0).alias("rate"), (F.col("p") * cost).alias("spend"))
    w = Window.partitionBy("transition", "label", "t").orderBy(F.desc("rate"), "y").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("spend").over(w) - F.col("spend")
    moved = moves.withColumn("got", F.col("rate") * F.greatest(F.lit(0.0), F.least(F.col("spend"), F.greatest("eps", F.lit(0.0)) - before)))
    hinge = moved.groupBy("transition", "label", "t").agg((F.sum("base") + F.sum("got")).alias("hinge"))
    return hinge.groupBy("transition", "label").agg(F.min(F.col("t") + F.col("hinge") / F.lit(tail)).alias("greedy"))


def radii(metrics: DataFrame, parts: dict[str, float]) -> DataFrame:
    """(transition, label, eps, cvar, epsilon_sat): radii that are parts of each transition's own threshold."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), (F.col("epsilon_sat") * v).alias("eps")) for k, v in parts.items()])).alias("x")
    return metrics.select("transition", "cvar", "epsilon_sat", each).select("transition", "x.label", "x.eps", "cvar", "epsilon_sat")


def worst_cases(pmf: DataFrame, metrics: DataFrame, cfg: Config) -> DataFrame:
    """(transition, label, primal, greedy, dual, closed) at no radius, half, all and twice the threshold; `cfg.grid` is the grid."""
    own = radii(metrics, {"zero": 0.0, "half": 0.5, "threshold": 1.0, "double": 2.0})
    eps = own.select("transition", "label", "eps")
    kept = pmf.join(metrics.select("transition"), "transition", "left_semi")
    closed = T.robust(F.col("cvar"), F.col("eps"), cfg.cap, cfg.tail)
    by = ["transition", "label"]
    out = own.join(primal_risk(kept, eps, cfg.cap, cfg.tail, cfg.grid), by).join(greedy_risk(kept, eps, cfg.cap, cfg.tail, cfg.grid), by)
    return out.join(dual_risk(kept, eps, cfg.cap, cfg.tail).withColumnRenamed("risk", "dual"), by).select(*by, "primal", "greedy", "dual", closed.alias("closed"))


def threshold_checks(pmf: DataFrame, metrics: DataFrame, cfg: Config, tolerance: float = 1e-6) -> DataFrame:
    """(transition, label, eps, worst, reached, passed): the worst case at no radius is the tail's mean, at the threshold the cap, just under it less."""
    own = radii(metrics, {"zero": 0.0, "below": 0.99, "threshold": 1.0})
    kept = pmf.join(metrics.select("transition"), "transition", "left_semi")
    got = greedy_risk(kept, own.select("transition", "label", "eps"), cfg.cap, cfg.tail, cfg.grid)
    reached = F.col("greedy") >= cfg.cap - tolerance
    full = F.col("epsilon_sat") <= tolerance  # the tail is at the cap at any radius
    passed = F.when(F.col("label") == "zero", F.abs(F.col("greedy") - F.col("cvar")) <= tolerance).when(F.col("label") == "threshold", reached).otherwise(full | ~reached)
    return own.join(got, ["transition", "label"]).select("transition", "label", "eps", F.col("greedy").alias("worst"), reached.alias("reached"), passed.alias("passed"))
