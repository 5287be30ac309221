"""Sensitivity of portfolios: every setting from one histogram of the finest blocks, in one pass.

Settings differ in what they count (length of blocks, cap, grid, window of origins) and
in what they make of it (tail, radius, clip, least sizes). The log is scanned and counted
once, by the finest blocks and uncapped but for the largest cap. Each way to count is a
roll-up of that within a slice of values (functions.sliced), so there is no job for each,
and no row of the histogram for each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import timedelta
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomflow.config import Config, common_followup_end
from loomflow.functions import scalars as S
from loomflow.functions import sliced as L
from loomflow.plans import evaluate as V
from loomflow.plans import model as M


@dataclass(frozen=True)
class Setting:
    """`lag` days before the decision end the history's origins, which then choose their own candidates; `followup` days must lie after the holdout's."""

    name: str
    cfg: Config
    lag: int = 0
    followup: int | None = None

    @property
    def end(self):
        return self.cfg.decision - timedelta(days=self.lag)

    @property
    def holdout_end(self):
        return self.cfg.holdout_end if self.followup is None else common_followup_end(self.cfg.holdout_end, self.cfg.observation_end or self.cfg.holdout_end, self.followup)


def settings(cfg: Config, blocks: tuple[int, int], least: tuple[int, int], grids: tuple[float, float], alpha: float, cap: float, followup: int, lags: tuple[int, int]) -> list[Setting]:
    """The 21 settings of an analysis: blocks, least sizes, reference, grids, tail, radii, clips, two caps on one window, and two lags."""
    out = [Setting("primary", cfg)]
    out += [Setting(f"block_{d}d", cfg.but(block_days=d)) for d in blocks] + [Setting(f"block_min_{n}", cfg.but(min_block=n)) for n in least]
    out += [Setting("leave_one_block_out", cfg.but(reference="leave_one_block_out"))] + [Setting(f"grid_{g:g}h", cfg.but(grid=g)) for g in grids] + [Setting(f"alpha_{alpha:.2f}", cfg.but(alpha=alpha))]
    out += [Setting(f"radius_{m:g}", cfg.but(multiplier=m)) for m in (0.0, 0.5, 1.5, 2.0)] + [Setting(f"kappa_{k:.2f}", cfg.but(kappa=k)) for k in (0.5, 0.75, 0.95, 0.99)]
    out += [Setting(f"cap_{c:g}h_common_followup", cfg.but(cap=c), followup=followup) for c in (cfg.cap, cap)]
    return out + [Setting(f"maturity_{d}d", cfg, lag=d) for d in lags]


def explored(cfg: Config, caps: tuple[float, float], alphas: tuple[float, float], grids: tuple[float, float], multipliers: tuple[float, ...] = (0.0, 0.5, 1.0, 1.5, 2.0)) -> list[Setting]:
    """The 14 exploratory settings: caps, tails and grids together, two of them with every radius; the first is the one that others are held against."""
    (c, c2), (a, a2), (g, g2) = caps, alphas, grids
    some = [(c, a, g, multipliers), (c2, a2, g, multipliers), (c, a2, g, (1.0,)), (c2, a, g, (1.0,)), (c, a, g2, (1.0,)), (c2, a2, g2, (1.0,))]
    every = [Setting(f"cap{cap:g}_alpha{round(100 * alpha)}_step{grid:g}_radius{m:g}", cfg.but(cap=cap, alpha=alpha, grid=grid, multiplier=m)) for cap, alpha, grid, ms in some for m in ms]
    return sorted(every, key=lambda s: s.cfg != cfg.but(cap=c, alpha=a, grid=g))


def _day(every: list[Setting]) -> int:
    """Days of the finest blocks."""
    return math.gcd(*[int(s.cfg.block_days) for s in every], *[s.lag for s in every if s.lag])


def _ends(every: list[Setting]) -> list:
    """Where the holdout's windows end; its finest blocks end there."""
    return sorted({s.holdout_end for s in every})


def _past(s: Setting, day: int) -> L.Way:
    return L.Way((s.cfg.decision - timedelta(days=s.lag) - s.cfg.start) / timedelta(days=day), s.cfg.block_days / day, float(s.cfg.cap), s.cfg.grid)


def _later(s: Setting, ends: list) -> L.Way:
    return L.Way(ends.index(s.holdout_end) + 1, None, float(s.cfg.cap))


def counted(obs: DataFrame, every: list[Setting]) -> DataFrame:
    """(side, transition, block, y, c): the history (h) and the holdout (o) by their finest blocks, from one scan and one count of the observations."""
    base, day = every[0].cfg, _day(every)
    o, d = F.col("origin"), F.col("destination")
    known = d.isNotNull() if base.observation_end is None else d.isNotNull() & (d <= S.at(base.observation_end))
    before = (o >= S.at(base.start)) & (o < S.at(base.decision)) & d.isNotNull() & (d < S.at(base.decision))
    after = (o >= S.at(base.decision)) & (o < S.at(base.holdout_end)) & known
    side = F.when(before, "h").when(after, "o")
    top = max(s.cfg.cap for s in every)
    window = F.lit(0)
    for e in _ends(every)[:-1]:
        window = window + (o >= S.at(e)).cast("int")
    finest = F.when(side == "h", S.block(o, base.start, day)).otherwise(window)
    fine = obs.select(side.alias("side"), "transition", finest.cast("int").alias("block"), S.capped(F.col("delay"), top).alias("y"))
    return fine.where("side is not null").groupBy("side", "transition", "block", "y").agg(F.count("*").alias("c"))


def swept(obs: DataFrame, every: list[Setting]) -> tuple[DataFrame, DataFrame]:
    """Metrics and outcomes of every setting, each with `configuration`.

    Candidates are those of the first setting, but for settings with a lag. The parts
    that both are made of are kept, since each is read many times; they are as many as
    settings x transitions x blocks.
    """
    day, ends = _day(every), _ends(every)
    specs: dict[str, dict[L.Way, list[L.Spec]]] = {"h": {}, "o": {}}
    for k, s in enumerate(every):
        specs["h"].setdefault(_past(s, day), []).append(M.spec(s.cfg, k))
        specs["o"].setdefault(_later(s, ends), []).append(L.Spec(k, float(s.cfg.cap), s.cfg.tail, 1 << 60))
    parts = L.calibrations(counted(obs, every), ["side", "transition"], specs).persist()
    rows = [(k, s.name, float(s.cfg.cap), s.cfg.tail, float(s.cfg.kappa), s.cfg.min_obs, M.required(s.cfg.but(decision=s.end)), float(s.cfg.multiplier), s.lag == 0) for k, s in enumerate(every)]
    table = F.broadcast(obs.sparkSession.createDataFrame(rows, "rep int, configuration string, cap double, tail double, kappa double, min_obs int, required int, multiplier double, fixed boolean"))  # a row for each setting
    history = parts.where("side = 'h'").drop("side").join(table.select("rep", "tail", "multiplier"), "rep")
    fits = M.fitted(history, ["transition"], ["rep"], F.col("tail"), every[0].cfg.radius_q, F.col("multiplier")).join(table.drop("multiplier"), "rep")
    scored = M.scored(fits, SimpleNamespace(**{c: F.col(c) for c in ("cap", "tail", "kappa", "min_obs")}))
    primary = scored.where("rep = 0 and strict_eligibility").select("transition")
    metrics = scored.where("fixed and epsilon is not null").join(primary, "transition", "left_semi").unionByName(scored.where("not fixed and strict_eligibility"))
    held = parts.where("side = 'o' and block < 0").join(table.select("rep", "configuration", "tail"), "rep")
    outcomes = held.select("configuration", "transition", F.col("n").cast("long").alias("n"), (F.col("s") / F.col("n")).alias("mean"), (F.col("worst") / (F.col("n") * F.col("tail"))).alias("cvar"))
    outcomes = outcomes.withColumn("mean_burden", F.col("n") * F.col("mean")).withColumn("tail_burden", F.col("n") * F.col("cvar"))
    return metrics.select("configuration", *M.METRICS), outcomes


def sensitivity(obs: DataFrame, every: list[Setting]) -> DataFrame:
    """A row for each setting, method and K: diagnostics, what the portfolio captures of the holdout, and its likeness to the first setting's."""
    cfg, keep = every[0].cfg, ["configuration"]
    metrics, outcomes = swept(obs, every)
    ports = M.portfolios(metrics, cfg, keep)
    got = V.evaluated(metrics, ports, outcomes, cfg, keep=keep)
    sets = ports.groupBy("configuration", "method", "K").agg(F.collect_set("transition").alias("members"))
    base = sets.where(F.col("configuration") == every[0].name).select("method", "K", F.col("members").alias("primary"))
    alike = sets.join(F.broadcast(base), ["method", "K"]).select("configuration", "method", "K", S.jaccard(F.col("members"), F.col("primary")).alias("jaccard_primary"))
    strict = metrics.groupBy("configuration").agg(F.count_if("strict_eligibility").alias("strict_eligible_candidates"))
    return got.join(M.diagnostic(metrics, keep), keep).join(strict, keep).join(alike, ["configuration", "method", "K"])


def frozen(ports: DataFrame, outcomes: DataFrame, cfg: Config) -> DataFrame:
    """Portfolios of settings as they were frozen (configuration, method, K, rank, transition), all on the outcomes of one setting: shares, regret against the best of all, likeness to them, and to the first setting's portfolios by members and by order.

    Regret may be negative, as a frozen portfolio is not held against its own candidates.
    """
    totals = outcomes.agg(F.sum("mean_burden").alias("all_mean"), F.sum("tail_burden").alias("all_tail"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "transition"))), lambda x: x["transition"])
    own = ports.join(outcomes, "transition", "left").groupBy("configuration", "method", "K").agg(F.count("n").alias("covered"), *[F.coalesce(F.sum(f"{t}_burden"), F.lit(0.0)).alias(f"{t}_sum") for t in V.TARGETS], ordered.alias("members"))
    best = V.oracle(outcomes, cfg).groupBy("K").agg(*[F.sum(F.when(F.col("target") == t, F.col("burden"))).alias(f"{t}_best") for t in V.TARGETS], *[F.collect_set(F.when(F.col("target") == t, F.col("transition"))).alias(f"{t}_set") for t in V.TARGETS])
    first = own.where("configuration = 'primary'").select("method", "K", F.col("members").alias("primary"))
    x = own.join(F.broadcast(best), "K").join(F.broadcast(first), ["method", "K"]).crossJoin(F.broadcast(totals))
    cols = []
    for t in V.TARGETS:
        cols += [(100 * F.col(f"{t}_sum") / F.col(f"all_{t}")).alias(f"{t}_share_pct"), (100 * (F.col(f"{t}_best") - F.col(f"{t}_sum")) / F.col(f"all_{t}")).alias(f"{t}_regret_pp"), S.jaccard(F.col("members"), F.col(f"{t}_set")).alias(f"jaccard_{t}_oracle")]
    same = F.array_sort("members") == F.array_sort("primary")
    return x.select("configuration", "method", "K", "covered", *cols, S.jaccard(F.col("members"), F.col("primary")).alias("jaccard_primary"), same.alias("same_set"), (F.col("members") == F.col("primary")).alias("same_order"), (same & (F.col("members") != F.col("primary"))).alias("differs_only_in_order"))
