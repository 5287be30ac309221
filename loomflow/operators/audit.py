"""Audits of a log (case_id, ts, ord, activity): maturity, anomalies, samples, feasibility."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.functions import scalars as S


def maturity_by_month(log: DataFrame, end: datetime, mature_days: float) -> DataFrame:
    """By the month that cases start in: their number, cycle times, and the follow-up recorded until `end`."""
    own = log.groupBy("case_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    cycle, follow = S.hours(F.col("first"), F.col("last")), S.hours(F.col("first"), S.at(end)) / 24
    own = own.select(S.month_label(F.col("first")).alias("month"), cycle.alias("cycle"), follow.alias("follow"))
    return own.groupBy("month").agg(
        F.count("*").alias("cases"), F.avg("cycle").alias("mean_cycle_hours"), F.max("cycle").alias("max_cycle_hours"), F.min("follow").alias("min_followup_days"), F.max("follow").alias("max_followup_days"),
        F.count_if(F.col("follow") >= mature_days).alias("mature"), S.ratio(F.count_if(F.col("follow") >= mature_days), F.count("*")).alias("mature_share"),
    )


def anomalies(log: DataFrame, core: tuple[int, int], boundary: tuple[int, ...]) -> DataFrame:
    """Cases with events outside the `core` years: how many in the boundary years, how many beyond."""
    year = F.year("ts")
    out, edge = ~year.between(*core), year.isin(*boundary)
    own = log.groupBy("case_id").agg(F.count("*").alias("events"), F.count_if(out).alias("non_core"), F.count_if(out & edge).alias("boundary"), F.count_if(out & ~edge).alias("extreme"))
    return own.where("non_core > 0")


def first_cases(log: DataFrame, n: int) -> DataFrame:
    """All events of the n cases that start first; ties by case."""
    chosen = log.groupBy("case_id").agg(F.min("ts").alias("first")).orderBy("first", "case_id").limit(n).select("case_id")
    return log.join(chosen, "case_id", "left_semi")


def sampled(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A uniform sample of n rows that depends on the rows alone: those of the least digests of their keys."""
    digest = F.md5(F.concat_ws(":", *(F.col(k).cast("string") for k in keys)))
    return df.orderBy(digest, *keys).limit(n)


def kinds_by_case(log: DataFrame, resource: Column) -> DataFrame:
    """Events of each kind of resource in each case, and distinct resources."""
    kind = S.resource_kind(F.col("resource"))
    own = log.withColumn("resource", resource).withColumn("kind", kind)
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_events") for k in ("human", "batch", "none", "other")]
    return own.groupBy("case_id").agg(*counts, F.countDistinct(F.when(F.col("kind") != "none", F.col("resource"))).alias("resources"))


def feasibility(log: DataFrame, lifecycle: Column, resource: Column, start: str = "start", complete: str = "complete") -> DataFrame:
    """What the log allows: service times (both lifecycle marks), resource analysis, and gaps between events."""
    low = F.lower(F.trim(F.coalesce(lifecycle, F.lit(""))))
    per_case = log.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(low == start).alias("started"), F.count_if(low == complete).alias("completed"), F.count(resource).alias("with_resource"))
    has = lambda c: F.coalesce(F.sum(c), F.lit(0)) > 0
    return per_case.agg((has("started") & has("completed")).alias("service_times"), has("with_resource").alias("resources"), F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("gaps"))


def first_seen(log: DataFrame) -> DataFrame:
    """Distinct activities with the order number at which each is first seen."""
    return log.groupBy("activity").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))


def first_of_group(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each group's first row."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("x")
    return df.groupBy(*keys).agg(first).select(*keys, *(f"x.{c}" for c in columns))


def on_base(base: DataFrame, counts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Counts for every row of the base, zero where there are none."""
    return base.join(counts, keys, "left").select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in columns))


def profiles(log: DataFrame, key: str) -> DataFrame:
    """(key, n, activities, entropy, active_months): of each resource, or other key: events, distinct activities and their entropy in nats, and months with an event."""
    c = log.groupBy(key, "activity").agg(F.count("*").alias("c"))
    per = c.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("activities"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    months = log.groupBy(key).agg(F.countDistinct(F.date_format("ts", "yyyy-MM")).alias("active_months"))
    entropy = F.ln("n") - F.col("s") / F.col("n")
    return per.join(months, per[key].eqNullSafe(months[key])).select(per[key], "n", "activities", entropy.alias("entropy"), "active_months")
