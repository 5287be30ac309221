"""Operators of the exploratory phases: radius tables, grid thresholds, diagnostics of portfolios and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.config import SCORES, Config
from loomflow.functions import scalars as S
from loomflow.functions import stats as T
from loomflow.plans import model as M

BAR = " || "


def universe(outcomes: DataFrame) -> DataFrame:
    """Outcomes with the frequency of each transition, and its burdens by frequency."""
    total = outcomes.agg(F.sum("n").alias("all_n"))  # one row
    f = F.col("n") / F.col("all_n")
    return outcomes.crossJoin(total).select("transition", "n", f.alias("frequency"), (f * F.col("mean")).alias("mean_score"), (f * F.col("cvar")).alias("tail_score"))


def floor_cvar(pmf: DataFrame, keys: list[str], tail: float, top: float, least: float = 1e-12) -> DataFrame:
    """(keys, cvar): the mean of the largest whole observations and the fraction of the next; a fraction of `least` or less drops, no mass gives the maximum."""
    total = pmf.groupBy(*keys).agg(F.sum("w").alias("n"), F.max("y").alias("most"))
    cum = T.running(pmf, keys, "y", {"cum": "w"}, top, descending=True).join(total, keys)
    mass, before = F.col("n") * F.lit(tail), F.col("cum") - F.col("w")
    whole = F.floor(mass)
    rest = F.when(mass - whole > least, mass - whole).otherwise(0.0)
    own = F.greatest(F.lit(0), F.least(F.col("w"), whole - before))
    part = F.when((before <= whole) & (F.col("cum") > whole), rest).otherwise(0.0)
    summed = cum.groupBy(*keys).agg(F.sum(F.col("y") * (own + part)).alias("s"), F.sum(own + part).alias("taken"), F.first("most").alias("most"))
    return summed.select(*keys, F.when(F.col("taken") > 0, F.col("s") / F.col("taken")).otherwise(F.col("most")).alias("cvar"))


def grid_threshold(pmf: DataFrame, keys: list[str], cap: float, tail: float, tolerance: float = 1e-12) -> DataFrame:
    """(keys, m_cap, delta, cost): the mass at the cap, what the tail lacks of it, and the cost of moving that up to the cap."""
    at_cap = pmf.groupBy(*keys).agg((F.sum(F.when(F.col("y") >= cap - tolerance, F.col("w")).otherwise(0)) / F.sum("w")).alias("m_cap"))
    cost = T.transport(pmf, keys, cap, tail)
    return at_cap.join(cost, keys).select(*keys, "m_cap", F.greatest(F.lit(0.0), F.lit(tail) - F.col("m_cap")).alias("delta"), F.col("threshold").alias("cost"))


def radius_table(hist: DataFrame, cfg: Config) -> DataFrame:
    """Distances of each transition's valid blocks from its history: quantiles, and the sizes of the blocks."""
    h = M.histogram(hist, cfg)
    d = M.distances(h, ["transition"], cfg)
    sizes = h.groupBy("transition", "block").agg(F.sum("c").alias("n_b"))
    quantiles = [F.percentile("d", F.lit(q)).alias(name) for q, name in ((0.5, "median"), (0.75, "q75"), (0.9, "q90"))]
    return d.join(sizes, ["transition", "block"]).groupBy("transition").agg(F.count("*").alias("blocks"), F.min("n_b").alias("least_n"), F.max("n_b").alias("most_n"), *quantiles, F.max("d").alias("most"))


def explorable(hist: DataFrame, cfg: Config, blocks: int) -> DataFrame:
    """Transitions with enough observations and `blocks` blocks of min_block at least."""
    h = M.histogram(hist, cfg).groupBy("transition", "block").agg(F.sum("c").alias("n_b"))
    return h.groupBy("transition").agg(F.sum("n_b").alias("n"), F.count_if(F.col("n_b") >= cfg.min_block).alias("full_blocks")).where((F.col("n") >= cfg.min_obs) & (F.col("full_blocks") >= blocks))


def representatives(metrics: DataFrame) -> DataFrame:
    """Three transitions to show: of the top score, nearest to the median ratio, and of the largest ratio; ties by name."""
    middle = metrics.agg(F.percentile("rho", F.lit(0.5)).alias("middle"))  # one row
    some = metrics.where("rho is not null").crossJoin(middle)
    picks = [("top_score", metrics, -F.col("dro_score")), ("median_ratio", some, F.abs(F.col("rho") - F.col("middle"))), ("largest_ratio", some, -F.col("rho"))]
    rows = [df.agg(F.min_by("transition", F.struct(key, "transition")).alias("transition")).select(F.lit(name).alias("pick"), "transition") for name, df, key in picks]
    return reduce(DataFrame.unionByName, rows)


def overlaps(portfolios: DataFrame) -> DataFrame:
    """Transitions that two methods' portfolios share: their number, and their share of K."""
    sets = portfolios.groupBy("method", "K").agg(F.collect_set("transition").alias("members"))  # K names each
    left, right = (sets.select(F.col("method").alias(x), "K", F.col("members").alias(f"{x}_members")) for x in ("left", "right"))
    n = F.size(F.array_intersect("left_members", "right_members"))
    return left.join(right, "K").where("left < right").select("K", "left", "right", n.alias("shared"), (n / F.col("K")).alias("share"))


def portfolio_saturation(portfolios: DataFrame, metrics: DataFrame) -> DataFrame:
    """Of each portfolio's members: how many are saturated, by their own tail and by the radius, and the median and largest ratio."""
    own = portfolios.join(metrics.select("transition", "saturated", "empirically_saturated", "rho"), "transition")
    return own.groupBy("method", "K").agg(
        F.count("*").alias("members"), F.count_if("saturated").alias("saturated"), F.count_if("empirically_saturated").alias("empirical"), (F.count_if("saturated") / F.count("*")).alias("share"),
        F.percentile("rho", F.lit(0.5)).alias("median_rho"), F.max("rho").alias("max_rho"),
    )


def mismatch(metrics: DataFrame) -> DataFrame:
    """Whether saturation by the risk and by the ratio agree, and why not."""
    by_ratio = F.coalesce(F.col("rho") >= 1, F.lit(False))
    reason = F.when(F.col("empirically_saturated"), "empirical tail at the cap").when(F.col("saturated") & ~by_ratio, "risk within tolerance of the cap").when(~F.col("saturated") & by_ratio, "ratio reached, risk below the cap").otherwise("agree")
    return metrics.select("transition", "saturated", by_ratio.alias("by_ratio"), reason.alias("reason"))


def selections(portfolios: DataFrame, label: str) -> DataFrame:
    """(key, selection): portfolios as a manifest names them, label|method|K=n, and their members in order of rank, joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "transition"))), lambda x: x["transition"])
    return portfolios.groupBy("method", "K").agg(F.array_join(ordered, BAR).alias("selection")).select(F.concat(F.lit(f"{label}|"), "method", F.lit("|K="), F.col("K")).alias("key"), "selection")


def parsed(manifest: DataFrame) -> DataFrame:
    """(label, method, K, rank, transition) of a manifest's keys and selections; keys of another form are left out."""
    key = r"^([^|]*)\|([^|]*)\|K=([0-9]+)$"
    part = lambda k: F.regexp_extract("key", key, k)
    rows = manifest.where(F.col("key").rlike(key)).select(part(1).alias("label"), part(2).alias("method"), part(3).cast("int").alias("K"), F.posexplode(F.split("selection", r" \|\| ")).alias("at", "transition"))
    return rows.select("label", "method", "K", (F.col("at") + 1).alias("rank"), "transition")


def agreement(manifest: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(rows, missing, added, changed) of two tables by key: keys of one side only, and keys whose values differ, null being equal to null."""
    a = manifest.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    b = table.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys])
    same = reduce(Column.__and__, [F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}")) for v in values])
    x = a.join(b, on, "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return x.agg(F.count("in_a").alias("rows"), F.count_if(F.col("in_b").isNull()).alias("missing"), F.count_if(F.col("in_a").isNull()).alias("added"), F.count_if(both & ~same).alias("changed"))


COMPARED = ("n", "m_cap", "epsilon_sat", "rho")


def before_and_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics of the transitions that two fits share, side by side, with differences and whether the class of saturation changed."""
    flags = ("empirically_saturated", "saturated")
    b = before.select("transition", *[F.col(c).alias(f"before_{c}") for c in (*COMPARED, *flags)])
    a = after.select("transition", *[F.col(c).alias(f"after_{c}") for c in (*COMPARED, *flags)])
    cols = [x for c in COMPARED for x in (F.col(f"before_{c}"), F.col(f"after_{c}"), (F.col(f"after_{c}") - F.col(f"before_{c}")).alias(f"{c}_difference"))]
    return b.join(a, "transition").select("transition", *cols, *[F.col(f"{side}_{c}") for c in flags for side in ("before", "after")], (F.col("before_saturated") != F.col("after_saturated")).alias("classification_changed"))


#: Pairs of scores whose likeness is reported.
SCORE_PAIRS = (("tail_score", "dro_score"), ("tail_score", "sa_score"), ("mean_score", "dro_score"), ("mean_score", "sa_score"))


def correlations(metrics: DataFrame, outcomes: DataFrame, cfg: Config) -> DataFrame:
    """(scope, method, left, right, kind, value, n): score against score in the history, and each method's score against what happened, by Spearman and Kendall; null under three rows or where one side is constant."""
    scores = [F.struct(F.lit("scores").alias("scope"), F.lit("").alias("method"), F.lit(x).alias("left"), F.lit(y).alias("right"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in SCORE_PAIRS]
    own = metrics.select("transition", F.explode(F.array(*scores)).alias("p")).select("transition", "p.*")
    held = [F.struct(F.lit("holdout").alias("scope"), F.lit(m).alias("method"), F.lit(SCORES[m]).alias("left"), F.lit(f"{t}_burden").alias("right"), F.col(SCORES[m]).alias("x"), F.col(f"{t}_burden").alias("y")) for m in cfg.methods for t in ("mean", "tail")]
    both = metrics.join(outcomes.select("transition", "mean_burden", "tail_burden"), "transition").select("transition", F.explode(F.array(*held)).alias("p")).select("transition", "p.*")
    every, keys = own.unionByName(both), ["scope", "method", "left", "right"]
    n = every.groupBy(*keys).agg(F.count("*").alias("n"))
    rho = T.spearman(every, keys, "x", "y").select(*keys, F.lit("Spearman").alias("kind"), F.col("rho").alias("value"))
    tau = T.kendall(every, keys, "transition", "x", "y").select(*keys, F.lit("Kendall").alias("kind"), F.col("tau").alias("value"))
    return rho.unionByName(tau).join(n, keys).select(*keys, "kind", F.when(F.col("n") >= 3, F.col("value")).alias("value"), "n")


def weekly_shares(held: DataFrame, portfolios: DataFrame, weights: DataFrame, cfg: Config, k: int, method: str, days: int = 7) -> DataFrame:
    """(baseline, method_share, baseline_share, difference, median, lower, upper, includes_zero): the share of burden that `method`'s portfolio of k captures, less each other method's.

    Ratios of sums over drawn weeks, the same draw for both sides; `weights` is (rep, week, weight), rows for each week that is drawn.
    """
    y = S.clipped(F.col("delay"), cfg.cap)
    weeks = held.select("transition", S.block(F.col("origin"), cfg.decision, days).alias("week"), y.alias("y")).groupBy("week", "transition").agg(F.sum("y").alias("burden"))
    totals = weeks.groupBy("week").agg(F.sum("burden").alias("total"))
    chosen = weeks.join(F.broadcast(portfolios.where(F.col("K") == k).select("method", "transition")), "transition").groupBy("week", "method").agg(F.sum("burden").alias("burden"))
    grid = totals.crossJoin(F.broadcast(portfolios.select("method").distinct())).join(chosen, ["week", "method"], "left")  # weeks x methods
    reps = grid.join(F.broadcast(weights), "week").groupBy("rep", "method").agg((F.sum(F.coalesce("burden", F.lit(0.0)) * F.col("weight")) / F.nullif(F.sum(F.col("total") * F.col("weight")), F.lit(0.0))).alias("share"))
    left = reps.where(F.col("method") == method).select("rep", F.col("share").alias("own"))
    d = reps.where(F.col("method") != method).join(left, "rep").select(F.col("method").alias("baseline"), (100 * F.col("own")).alias("own"), (100 * F.col("share")).alias("other"), (100 * (F.col("own") - F.col("share"))).alias("d"))
    q = lambda p: F.percentile("d", F.lit(p))
    return d.groupBy("baseline").agg(F.avg("own").alias("method_share"), F.avg("other").alias("baseline_share"), F.avg("d").alias("difference"), q(0.5).alias("median"), q(0.025).alias("lower"), q(0.975).alias("upper"), ((F.round(q(0.025), 9) <= 0) & (F.round(q(0.975), 9) >= 0)).alias("includes_zero"))


def labelled(name: Column, nominal: tuple[str, ...]) -> Column:
    """nominal for the windows named, holdout for all others."""
    return F.when(name.isin(*nominal), "nominal").otherwise("holdout")
