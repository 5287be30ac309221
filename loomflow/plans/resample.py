"""Resampling: paired bootstraps, refits of the selection, and a permutation null."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.functions import scalars as S
from loomflow.functions import sliced as L
from loomflow.plans import evaluate as V
from loomflow.plans import model as M
from loomflow.plans.permuted import Dealt


def calendar(held: DataFrame, cfg: Config, days: float) -> DataFrame:
    """`held` with the calendar cluster of each origin, counted from the decision."""
    return held.withColumn("cluster", S.block(F.col("origin"), cfg.decision, days).cast("long"))


def schemes(held: DataFrame, cfg: Config, days: tuple[float, ...], replicates: int) -> dict[str, tuple[DataFrame, int, object]]:
    """Of each calendar scheme, and of cases: the holdout with its clusters, their number, and what draws their weights.

    Calendar clusters are few; those without rows can be drawn too. Cases are drawn by hashes.
    """
    out = {}
    for d in days:
        own = calendar(held, cfg, d)
        last = own.agg(F.max("cluster")).first()[0]
        n = 1 if last is None else last + 1
        out[f"calendar_{d:g}d"] = (own, n, L.Calendar(n, replicates, cfg.seed))
    own, n = L.numbered(held, "case_id", "cluster")
    out["case_cluster"] = (own, n, L.splitting(held.sparkSession, n, replicates, cfg.seed))
    return out


def burdens(clustered: DataFrame, weigh, cfg: Config, replicates: int) -> DataFrame:
    """(rep, transition, mean_burden, tail_burden): outcomes of each replicate, by the weights of the clusters."""
    y = S.capped(F.col("delay"), cfg.cap).alias("y")
    counts = clustered.select("transition", "cluster", y).groupBy("transition", "cluster", "y").agg(F.count("*").alias("c"))
    out = L.resampled(counts, ["transition"], cfg.cap, cfg.tail, replicates, weigh)
    return out.select("rep", "transition", F.col("s").alias("mean_burden"), (F.col("worst") / F.lit(cfg.tail)).alias("tail_burden"))


def long_burdens(reps: DataFrame) -> DataFrame:
    """(rep, target, transition, burden)."""
    stack = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}_burden").alias("burden")) for t in V.TARGETS])).alias("x")
    return reps.select("rep", "transition", stack).select("rep", "x.target", "transition", "x.burden")


def shares(reps: DataFrame, ports: DataFrame) -> DataFrame:
    """(rep, target, method, K, share): percent of all burden that each portfolio captures in each replicate."""
    long = long_burdens(reps)
    total = long.groupBy("rep", "target").agg(F.sum("burden").alias("all"))
    members = F.broadcast(ports.select("method", "K", "transition"))  # methods x sizes x K rows at most
    # K burdens, summed in order of size, so that equal memberships have equal sums.
    in_order = F.aggregate(F.array_sort(F.collect_list("burden")), F.lit(0.0), lambda a, x: a + x)
    got = long.join(members, "transition").groupBy("rep", "target", "method", "K").agg(in_order.alias("burden"))
    grid = total.crossJoin(F.broadcast(ports.select("method", "K").distinct()))
    return grid.join(got, ["rep", "target", "method", "K"], "left").select("rep", "target", "method", "K", (100 * F.coalesce("burden", F.lit(0.0)) / F.col("all")).alias("share"))


def oracle_shares(reps: DataFrame, candidates: DataFrame, cfg: Config) -> DataFrame:
    """(rep, target, K, share): percent of all burden that the best K candidates of each replicate carry.

    Each task keeps the largest of its rows before those of a replicate meet.
    """
    long = long_burdens(reps)
    total = long.groupBy("rep", "target").agg(F.sum("burden").alias("all"))
    ranked = long.join(candidates.select("transition"), "transition", "left_semi")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("rep", "target").orderBy(F.desc("burden"), "transition"))).where(F.col("rank") <= max(cfg.sizes))
    best = ranked.groupBy("rep", "target").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("burden")).otherwise(0.0)).alias(f"best_{k}") for k in cfg.sizes])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("K"), F.coalesce(f"best_{k}", F.lit(0.0)).alias("burden")) for k in cfg.sizes])).alias("x")
    return total.join(best, ["rep", "target"], "left").select("rep", "target", "all", each).select("rep", "target", "x.K", (100 * F.col("x.burden") / F.col("all")).alias("share"))


ORACLE = "Eligible oracle"


def paired_bootstrap(clustered: DataFrame, ports: DataFrame, candidates: DataFrame, cfg: Config, weigh, replicates: int) -> DataFrame:
    """(K, left_method, right_method, target, difference, lower, upper, identical): differences of captured shares under shared weights.

    The oracle, chosen anew in each replicate of the candidates, stands against each
    method. Equal memberships differ by exactly zero, since both read one replicate's burdens.
    """
    reps = burdens(clustered, weigh, cfg, replicates).persist()  # replicates x transitions rows, read by each share
    order = F.create_map(*[F.lit(x) for k, m in enumerate(cfg.methods) for x in (m, k)])
    own = shares(reps, ports).withColumn("place", F.element_at(order, F.col("method")))
    best = oracle_shares(reps, candidates, cfg).select("rep", "target", F.lit(ORACLE).alias("method"), "K", "share", F.lit(-1).alias("place"))
    left = own.unionByName(best).select("rep", "K", "target", F.col("method").alias("left_method"), F.col("place").alias("pa"), F.col("share").alias("sa"))
    right = own.select("rep", "K", "target", F.col("method").alias("right_method"), F.col("place").alias("pb"), F.col("share").alias("sb"))
    d = left.join(right, ["rep", "K", "target"]).where("pa < pb").withColumn("d", F.col("sa") - F.col("sb"))
    q = lambda p: F.percentile("d", F.lit(p))
    out = d.groupBy("K", "left_method", "right_method", "target").agg(F.avg("d").alias("difference"), q(0.025).alias("lower"), q(0.975).alias("upper"))
    same = V.overlap(ports, cfg).select("K", "left_method", "right_method", F.col("same_membership"))
    return out.join(F.broadcast(same), ["K", "left_method", "right_method"], "left").withColumn("identical", F.coalesce("same_membership", F.lit(False))).drop("same_membership")


def bootstrapped(held: DataFrame, ports: DataFrame, candidates: DataFrame, cfg: Config, days: tuple[float, ...], replicates: int) -> DataFrame:
    """paired_bootstrap() of every scheme, with `scheme` and the number of its `clusters`."""
    parts = [paired_bootstrap(own, ports, candidates, cfg, weigh, replicates).select(F.lit(name).alias("scheme"), F.lit(n).cast("long").alias("clusters"), "*") for name, (own, n, weigh) in schemes(held, cfg, days, replicates).items()]
    return reduce(DataFrame.unionByName, parts)


def superior(differences: DataFrame) -> DataFrame:
    """(superior): whether every interval lies above zero."""
    return differences.agg(F.coalesce(F.bool_and((F.col("lower") > 0) & (F.col("difference") > 0)), F.lit(False)).alias("superior"))


def refits(hist: DataFrame, weights: np.ndarray, cfg: Config) -> DataFrame:
    """Metrics of each replicate of resampled history blocks (rep), radius, risk and eligibility fitted again.

    The histogram is counted once; a replicate only weighs its blocks anew (`weights`: replicates by blocks).
    """
    return M.scored(M.calibrated(M.histogram(hist, cfg), ["transition"], cfg, weights), cfg)


def stability(refitted: DataFrame, primary: DataFrame, cfg: Config) -> DataFrame:
    """(method, K, replicates, mean_jaccard, p05_jaccard, p95_jaccard, at_least_80) of refitted against primary portfolios, and the candidates' numbers."""
    ports = M.portfolios(refitted.where("strict_eligibility"), cfg, ["rep"]).groupBy("rep", "method", "K").agg(F.collect_set("transition").alias("x"))
    base = primary.groupBy("method", "K").agg(F.collect_set("transition").alias("y"))
    j = ports.join(F.broadcast(base), ["method", "K"]).select("method", "K", S.jaccard(F.col("x"), F.col("y")).alias("j"))
    q = lambda p: F.percentile("j", F.lit(p))
    able = refitted.groupBy("rep").agg(F.count_if("strict_eligibility").alias("n")).agg(F.percentile("n", F.lit(0.5)).alias("median_candidates"), F.min("n").alias("min_candidates"), F.max("n").alias("max_candidates"))
    out = j.groupBy("method", "K").agg(F.count("*").alias("replicates"), F.avg("j").alias("mean_jaccard"), q(0.05).alias("p05_jaccard"), q(0.95).alias("p95_jaccard"), F.count_if(F.col("j") >= 0.8).alias("at_least_80"))
    return out.crossJoin(F.broadcast(able))  # one row


def probabilities(refitted: DataFrame, primary: DataFrame, cfg: Config, replicates: int) -> DataFrame:
    """(method, K, transition, selection_probability, eligibility_probability, in_primary)."""
    chosen = M.portfolios(refitted.where("strict_eligibility"), cfg, ["rep"]).groupBy("method", "K", "transition").agg((F.count("*") / replicates).alias("selection_probability"))
    able = refitted.groupBy("transition").agg((F.count_if("strict_eligibility") / replicates).alias("eligibility_probability"))
    base = primary.select("method", "K", "transition", F.lit(True).alias("p"))
    return chosen.join(able, "transition").join(base, ["method", "K", "transition"], "left").select("method", "K", "transition", "selection_probability", "eligibility_probability", F.coalesce("p", F.lit(False)).alias("in_primary"))


def frozen(refitted: DataFrame, metrics: DataFrame) -> DataFrame:
    """Refits with the robust risk held at its primary value, as the exploratory stability check has it."""
    risk = metrics.select("transition", F.col("risk").alias("fixed_risk"), F.col("sa_risk").alias("fixed_sa"))
    x = refitted.join(F.broadcast(risk), "transition")
    return x.withColumns({"dro_score": F.col("frequency") * F.col("fixed_risk"), "sa_score": F.col("frequency") * F.col("fixed_sa")}).drop("fixed_risk", "fixed_sa")


def dealt_anew(hist: DataFrame, metrics: DataFrame, cfg: Config, replicates: int) -> DataFrame:
    """(rep, transition, block, y): each transition's delays over its own places in blocks, in another order in each replicate.

    A delay's place is its rank by a digest of the replicate and its row; the blocks take
    places in turn, as many as they have rows, so that every block keeps its size. Rows of
    one case, origin and delay are alike, so that their order does not matter.
    """
    return Dealt(hist, metrics, cfg, replicates).table()


def noise(hist: DataFrame, metrics: DataFrame, cfg: Config, replicates: int) -> DataFrame:
    """(transition, observed, null_median, null_p95, above): the radius against those of delays dealt anew to blocks of the same sizes."""
    metrics = metrics.persist()  # a row for each transition, read twice
    d = Dealt(hist, metrics, cfg, replicates).distances()
    radius = d.groupBy("transition", "rep").agg(F.percentile("d", F.lit(cfg.radius_q)).alias("e"))
    null = radius.groupBy("transition").agg(F.percentile("e", F.lit(0.5)).alias("null_median"), F.percentile("e", F.lit(0.95)).alias("null_p95"))
    return metrics.select("transition", F.col("epsilon").alias("observed")).join(null, "transition").withColumn("above", F.col("observed") > F.col("null_p95"))


def noise_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("transitions"), F.count_if("above").alias("above_p95"), F.percentile(S.ratio(F.col("observed"), F.col("null_median")), F.lit(0.5)).alias("median_ratio"))


