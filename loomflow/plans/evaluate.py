"""Portfolios on the holdout: burdens, oracles, regret, overlap and rank agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.functions import scalars as S
from loomflow.functions import stats as T
from loomflow.plans import model as M

TARGETS = ("mean", "tail")


def outcomes(held: DataFrame, cfg: Config) -> DataFrame:
    """(transition, n, mean, cvar, mean_burden, tail_burden) of capped delays."""
    pmf = held.select("transition", S.capped(F.col("delay"), cfg.cap).alias("y")).groupBy("transition", "y").agg(F.count("*").alias("w"))
    out = T.cvar(pmf, ["transition"], cfg.tail, cfg.cap)
    return out.withColumn("mean_burden", F.col("n") * F.col("mean")).withColumn("tail_burden", F.col("n") * F.col("cvar"))


def oracle(out: DataFrame, cfg: Config, candidates: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keep, target, K, rank, transition, burden): the best K by what happened, of all transitions or of the candidates."""
    keep = keep or []
    own = out if candidates is None else out.join(candidates.select(*keep, "transition"), [*keep, "transition"], "left_semi")
    stack = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}_burden").alias("burden")) for t in TARGETS])).alias("x")
    long = own.select(*keep, "transition", stack).select(*keep, "transition", "x.target", "x.burden")
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy(*keep, "target").orderBy(F.desc("burden"), "transition"))).where(F.col("rank") <= max(cfg.sizes))
    return ranked.select(*keep, "target", F.explode(F.array(*[F.lit(k) for k in cfg.sizes])).alias("K"), "rank", "transition", "burden").where(F.col("rank") <= F.col("K"))


def rank_agreement(metrics: DataFrame, out: DataFrame, cfg: Config) -> DataFrame:
    """(method, n, kendall_mean, kendall_tail) between scores and holdout burdens of common transitions."""
    both = M.by_method(metrics, cfg).join(out, "transition")
    tm = T.kendall(both, ["method"], "transition", "score", "mean_burden").withColumnRenamed("tau", "kendall_mean")
    tt = T.kendall(both, ["method"], "transition", "score", "tail_burden").withColumnRenamed("tau", "kendall_tail")
    return both.groupBy("method").agg(F.count("*").alias("common")).join(tm, "method", "left").join(tt, "method", "left")


def evaluate(metrics: DataFrame, ports: DataFrame, held: DataFrame, cfg: Config, clamp: bool = True) -> DataFrame:
    """Shares captured, both oracles' shares, regret, Jaccard with the oracle and candidate coverage, by method and K."""
    return evaluated(metrics, ports, outcomes(held, cfg), cfg, clamp)


def evaluated(metrics: DataFrame, ports: DataFrame, out: DataFrame, cfg: Config, clamp: bool = True, keep: list[str] | None = None) -> DataFrame:
    """evaluate() of given outcomes; all three tables may have columns `keep`, of which each value is evaluated by itself.

    A chosen transition that the holdout lacks counts as zero. Regret is against the
    candidates' oracle if `clamp` (never below zero), else against the global one.
    """
    keep = keep or []
    totals = out.groupBy(*keep).agg(F.sum("mean_burden").alias("all_mean"), F.sum("tail_burden").alias("all_tail"), F.sum("n").alias("observations"), F.count("*").alias("transitions"))
    chosen = ports.join(out, [*keep, "transition"], "left").groupBy(*keep, "method", "K").agg(
        *[F.coalesce(F.sum(f"{t}_burden"), F.lit(0.0)).alias(f"{t}_sum") for t in TARGETS], F.collect_set("transition").alias("members")
    )
    x = chosen
    for scope, cand in (("eligible", metrics), ("global", None)):
        best = oracle(out, cfg, cand, keep).groupBy(*keep, "K").agg(
            *[F.sum(F.when(F.col("target") == t, F.col("burden"))).alias(f"{t}_{scope}") for t in TARGETS],
            *[F.collect_set(F.when(F.col("target") == t, F.col("transition"))).alias(f"{t}_{scope}_set") for t in TARGETS],
        )
        x = x.join(F.broadcast(best), [*keep, "K"], "left")  # a row for each K
    covered = out.join(metrics.select(*keep, "transition"), [*keep, "transition"], "left_semi").groupBy(*keep).agg(*[F.sum(f"{t}_burden").alias(f"{t}_cand") for t in TARGETS])
    x = x.join(totals, keep).join(covered, keep) if keep else x.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(covered))
    cols = [*keep, "method", "K"]
    scope = "eligible" if clamp else "global"
    for t in TARGETS:
        all_t = F.col(f"all_{t}")
        regret = 100 * (F.col(f"{t}_{scope}") - F.col(f"{t}_sum")) / all_t
        cols += [
            (100 * F.col(f"{t}_sum") / all_t).alias(f"{t}_share_pct"), (100 * F.col(f"{t}_eligible") / all_t).alias(f"{t}_oracle_eligible_pct"), (100 * F.col(f"{t}_global") / all_t).alias(f"{t}_oracle_global_pct"),
            (F.greatest(F.lit(0.0), regret) if clamp else regret).alias(f"{t}_regret_pp"), S.jaccard(F.col("members"), F.col(f"{t}_{scope}_set")).alias(f"jaccard_{t}_oracle"),
            (100 * F.col(f"{t}_cand") / all_t).alias(f"candidate_{t}_coverage_pct"),
        ]
    return x.select(*cols, F.col("transitions").alias("holdout_transitions"), F.col("observations").cast("long").alias("holdout_observations"))


def overlap(ports: DataFrame, cfg: Config) -> DataFrame:
    """(K, left_method, right_method, jaccard, same_membership) of all pairs of methods, in the order of the methods."""
    order = F.create_map(*[F.lit(x) for k, m in enumerate(cfg.methods) for x in (m, k)])
    sets = ports.groupBy("method", "K").agg(F.array_sort(F.collect_set("transition")).alias("members")).withColumn("place", F.element_at(order, F.col("method")))
    a = sets.select("K", F.col("method").alias("left_method"), F.col("members").alias("x"), F.col("place").alias("ka"))
    b = sets.select("K", F.col("method").alias("right_method"), F.col("members").alias("y"), F.col("place").alias("kb"))
    return a.join(b, "K").where("ka < kb").select("K", "left_method", "right_method", S.jaccard(F.col("x"), F.col("y")).alias("jaccard"), (F.col("x") == F.col("y")).alias("same_membership"))


def availability(obs: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Origins of each window (lo, hi, cutoff): with a destination before the cutoff, later, or none. A few windows: a range join."""
    x = obs.join(F.broadcast(windows), (F.col("origin") >= F.col("lo")) & (F.col("origin") < F.col("hi")))
    d = F.col("destination")
    return x.groupBy(*keys).agg(
        F.count("*").alias("origin_events"), F.count_if(d < F.col("cutoff")).alias("available_pairs"), F.count_if(d >= F.col("cutoff")).alias("later_recorded"), F.count_if(d.isNull()).alias("no_successor"),
        (100.0 * F.count_if(d.isNull() | (d >= F.col("cutoff"))) / F.count("*")).alias("pending_pct"),
    )
