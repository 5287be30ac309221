"""From histories to metrics and portfolios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomflow.config import SCORES, Config
from loomflow.functions import scalars as S
from loomflow.functions import sliced as L
from loomflow.functions import stats as T

SATURATED, REACHED = 1e-8, 1e-7


def histogram(hist: DataFrame, cfg: Config, extra: list[str] | None = None) -> DataFrame:
    """(transition, block, y, c): counts of capped delays; what all calibrations start from."""
    y = S.capped(F.col("delay"), cfg.cap)
    if cfg.grid:
        y = S.snapped(y, cfg.grid, cfg.cap)
    keyed = hist.select(*(extra or []), "transition", S.block(F.col("origin"), cfg.start, cfg.block_days).alias("block"), y.alias("y"))
    return keyed.groupBy(*(extra or []), "transition", "block", "y").agg(F.count("*").alias("c"))


def pooled(hist: DataFrame, keys: list[str]) -> DataFrame:
    return hist.groupBy(*keys, "y").agg(F.sum("c").alias("w"))


def spec(cfg: Config, rep: int = 0) -> L.Spec:
    return L.Spec(rep, float(cfg.cap), cfg.tail, cfg.min_block, cfg.reference == "leave_one_block_out")


def distances(hist: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """(keys, block, d): Wasserstein distance of each valid block from the pooled or the left-out reference; `hist` is (keys, block, y, c)."""
    return L.calibrations(hist, keys, [spec(cfg)]).where("block >= 0 and d is not null").select(*keys, "block", "d")


def fitted(parts: DataFrame, keys: list[str], group: list[str], tail: float | Column, radius_q: float, multiplier: float | Column) -> DataFrame:
    """(keys, rep, n, mean, cvar, valid_blocks, epsilon, m_cap, frequency) of calibrations; frequencies are within each `group`."""
    own = F.col("block") < 0
    total = lambda x: F.sum(F.when(own, F.col(x)))
    n, w = total("n"), F.when(~own & F.col("d").isNotNull(), F.col("weight")).otherwise(0)
    extra = [] if not isinstance(tail, Column) else ["tail", "multiplier"]
    out = parts.groupBy(*keys, "rep", *extra).agg(
        n.cast("long").alias("n"), (total("s") / n).alias("mean"), total("worst").alias("worst"), F.sum(F.when(~own, F.col("weight")).otherwise(0)).alias("valid_blocks"),
        F.percentile(F.when(~own, F.col("d")), F.lit(radius_q), w).alias("radius"), (total("top") / n).alias("m_cap"),
    )
    out = out.withColumn("cvar", F.col("worst") / (F.col("n") * tail)).withColumn("epsilon", F.col("radius") * multiplier).drop("worst", "radius", *extra)
    all_n = out.groupBy(*group).agg(F.sum("n").alias("all_n"))
    return out.join(all_n, group).withColumn("frequency", F.col("n") / F.col("all_n"))


def calibrated(hist: DataFrame, keys: list[str], cfg: Config, weights: np.ndarray | None = None) -> DataFrame:
    """(keys, n, mean, cvar, valid_blocks, required, epsilon, frequency, m_cap) of each transition, eligible or not.

    With `weights` (replicates by blocks), of each replicate, `rep`, all from one histogram.
    """
    group = ["rep"] + [k for k in keys if k != "transition"]
    out = fitted(L.calibrations(hist, keys, [spec(cfg)], weights), keys, group, cfg.tail, cfg.radius_q, cfg.multiplier)
    out = out.withColumn("required", F.lit(required(cfg)))
    return out if weights is not None else out.drop("rep")


def required(cfg: Config) -> int:
    """Valid blocks that a transition must have."""
    return int(-(-cfg.coverage * cfg.blocks // 1))


def scored(cal: DataFrame, cfg) -> DataFrame:
    """Risk, saturation and the five scores, from calibrated statistics; `cfg` has numbers or columns as cap, tail, kappa and min_obs."""
    threshold = T.saturation(F.col("cvar"), cfg.cap, cfg.tail)
    full = F.col("epsilon_sat") <= SATURATED
    out = cal.withColumn("strict_eligibility", (F.col("n") >= cfg.min_obs) & (F.col("valid_blocks") >= F.col("required"))).withColumn("epsilon_sat", threshold)
    out = out.withColumn("empirically_saturated", full).withColumn("rho", F.when(~full, F.col("epsilon") / F.col("epsilon_sat")))
    out = out.withColumn("risk", T.robust(F.col("cvar"), F.col("epsilon"), cfg.cap, cfg.tail)).withColumn("sa_epsilon", F.when(full, F.lit(0.0)).otherwise(F.least("epsilon", F.col("epsilon_sat") * cfg.kappa)))
    out = out.withColumn("sa_risk", T.robust(F.col("cvar"), F.col("sa_epsilon"), cfg.cap, cfg.tail))
    reached = T.number(cfg.cap) - REACHED
    out = out.withColumn("saturated", F.col("risk") >= reached).withColumn("sa_saturated", F.col("sa_risk") >= reached)
    f = F.col("frequency")
    return out.withColumns({"mean_score": f * F.col("mean"), "tail_score": f * F.col("cvar"), "dro_score": f * F.col("risk"), "sa_score": f * F.col("sa_risk")})


METRICS = ("transition", "n", "valid_blocks", "required", "strict_eligibility", "frequency", "mean", "cvar", "epsilon", "epsilon_sat", "rho", "m_cap", "empirically_saturated", "saturated", "sa_saturated", "risk", "sa_epsilon", "sa_risk", "mean_score", "tail_score", "dro_score", "sa_score")


def fit(hist: DataFrame, cfg: Config, candidates: DataFrame | None = None) -> DataFrame:
    """Metrics of the eligible transitions of a history, or of given `candidates` (transition)."""
    out = scored(calibrated(histogram(hist, cfg), ["transition"], cfg), cfg)
    out = out.join(candidates.select("transition"), "transition", "left_semi") if candidates is not None else out.where("strict_eligibility")
    return out.select(*METRICS)


def by_method(metrics: DataFrame, cfg: Config, keep: list[str] | None = None) -> DataFrame:
    """(keep, transition, method, score): one row for each method."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(SCORES[m]).alias("score")) for m in cfg.methods])).alias("x")
    return metrics.select(*(keep or []), "transition", stack).select(*(keep or []), "transition", "x.method", "x.score")


def portfolios(metrics: DataFrame, cfg: Config, keep: list[str] | None = None) -> DataFrame:
    """(keep, method, K, rank, transition): the top K of each method; scores that agree to ten places are ties, by name."""
    w = Window.partitionBy(*(keep or []), "method").orderBy(F.desc(F.round("score", 10)), "transition")
    ranked = by_method(metrics, cfg, keep).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(cfg.sizes))
    sizes = F.explode(F.array(*[F.lit(k) for k in cfg.sizes])).alias("K")
    return ranked.select(*(keep or []), "method", sizes, "rank", "transition").where(F.col("rank") <= F.col("K"))


def diagnostic(metrics: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts of saturated candidates and medians of rho and radius."""
    return metrics.groupBy(*(keep or [])).agg(
        F.count("*").alias("candidates"), F.count_if("empirically_saturated").alias("empirical"), F.count_if(F.col("saturated") & ~F.col("empirically_saturated")).alias("induced"),
        F.count_if("saturated").alias("total"), F.percentile("rho", F.lit(0.5)).alias("median_rho"), F.percentile("epsilon", F.lit(0.5)).alias("median_epsilon"),
    )
