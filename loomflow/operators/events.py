"""Event logs: (case, ts, ord, activity) to directly-follows observations and case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.functions import scalars as S


def log_of(df: DataFrame, case: str, ts: str | None, order: str, activity: str | Column) -> DataFrame:
    """An event log of any table; without a time column, in document order only."""
    act = F.col(activity) if isinstance(activity, str) else activity
    time = F.col(ts) if ts else F.lit(None).cast("timestamp_ntz")
    return df.select(F.col(case).alias("case_id"), time.alias("ts"), F.col(order).alias("ord"), act.alias("activity"))


def by_time() -> Window:
    return Window.partitionBy("case_id").orderBy("ts", "ord")


def by_document() -> Window:
    return Window.partitionBy("case_id").orderBy("ord")


def observations(log: DataFrame) -> DataFrame:
    """One row for each event: its successor, transition and delay in hours; a case's last event has none."""
    w = by_time()
    paired = log.select("case_id", F.col("ts").alias("origin"), F.lead("ts").over(w).alias("destination"), F.col("activity").alias("origin_activity"), F.lead("activity").over(w).alias("next_activity"))
    return paired.select(
        "case_id", "origin", "destination", "origin_activity",
        F.concat("origin_activity", F.lit(S.ARROW), "next_activity").alias("transition"), S.hours(F.col("origin"), F.col("destination")).alias("delay"),
    )


def predecessors(log: DataFrame, document_order: bool = True) -> DataFrame:
    """One row for each event with the event before it and the gap, which document order may make negative."""
    w = by_document() if document_order else by_time()
    own = log.withColumn("previous_activity", F.lag("activity").over(w)).withColumn("gap", S.hours(F.lag("ts").over(w), F.col("ts")))
    return own.withColumn("transition", F.concat("previous_activity", F.lit(S.ARROW), "activity")).withColumn("is_first", F.row_number().over(w) == 1).withColumn("is_last", F.lead("ord").over(w).isNull())


def history(obs: DataFrame, cfg: Config) -> DataFrame:
    """Pairs whose origin and destination were both recorded before the decision."""
    o, d = F.col("origin"), F.col("destination")
    return obs.where((o >= S.at(cfg.start)) & (o < S.at(cfg.decision)) & d.isNotNull() & (d < S.at(cfg.decision)))


def holdout(obs: DataFrame, cfg: Config) -> DataFrame:
    """Pairs of the holdout window with a destination up to the end of observation, inclusive."""
    o, d = F.col("origin"), F.col("destination")
    seen = d.isNotNull() if cfg.observation_end is None else d.isNotNull() & (d <= S.at(cfg.observation_end))
    return obs.where((o >= S.at(cfg.decision)) & (o < S.at(cfg.holdout_end)) & seen)


def ties(log: DataFrame) -> DataFrame:
    """(tie_groups, tie_pairs, tie_cases): events of a case at the same time."""
    groups = log.groupBy("case_id", "ts").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("tie_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("tie_pairs"), F.countDistinct("case_id").alias("tie_cases"))


def cases(log: DataFrame) -> DataFrame:
    """One row for each case: span, size, distinct activities, ends, variant and whether document order follows time."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct("ord", "activity"))), lambda x: x["activity"])
    flagged = log.withColumn("back", F.col("ts") < F.lag("ts").over(by_document()))
    return flagged.groupBy("case_id").agg(
        F.min("ts").alias("case_start"), F.max("ts").alias("case_end"), S.hours(F.min("ts"), F.max("ts")).alias("cycle_hours"), F.count("*").alias("n_events"),
        F.countDistinct("activity").alias("n_activities"), F.min_by("activity", "ord").alias("start_activity"), F.max_by("activity", "ord").alias("end_activity"),
        F.array_join(seq, S.ARROW).alias("variant"), (~F.coalesce(F.bool_or("back"), F.lit(False))).alias("in_order"),
    )


def follows(log: DataFrame) -> DataFrame:
    """(a, b, n): the directly-follows graph in document order."""
    w = by_document()
    pairs = log.select(F.col("activity").alias("a"), F.lead("activity").over(w).alias("b")).where("b is not null")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def variants(case_table: DataFrame, most: int = 5000) -> DataFrame:
    """The `most` frequent variants, with shares of all cases and running shares."""
    counted = case_table.groupBy("variant").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    first = counted.orderBy(F.desc("n"), "variant").limit(most)
    w = Window.orderBy(F.desc("n"), "variant")  # over `most` rows
    out = first.crossJoin(F.broadcast(total))
    return out.select(
        "variant", "n", (100.0 * F.col("n") / F.col("total")).alias("share"), (100.0 * F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")).alias("cum_share"),
        F.row_number().over(w).alias("rank"), F.size(F.split("variant", S.ARROW)).alias("length"),
    )


def variants_for(case_table: DataFrame, percent: int = 80) -> DataFrame:
    """(n): how many variants, from the most frequent on, hold `percent` of all cases, counted over all variants.

    Variants of one frequency are one row, so the running sum is over the far fewer frequencies.
    """
    freq = case_table.groupBy("variant").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("m"))
    total = freq.agg(F.sum(F.col("n") * F.col("m")).alias("total"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    before = freq.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("m")).over(w), F.lit(0))).crossJoin(F.broadcast(total))
    below = F.expr(f"({percent} * total - 100 * before - 1) div (100 * n)")
    short = F.when(100 * F.col("before") < percent * F.col("total"), F.least("m", below)).otherwise(0)
    return before.agg((F.coalesce(F.sum(short), F.lit(0)) + 1).alias("n"))


def classified(log: DataFrame, first_year: int, lo: int, hi: int) -> DataFrame:
    """(case_id, reason, n): whole-case exclusion with the first reason that applies."""
    per = log.groupBy("case_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    reason = F.when(F.col("a").isNull(), "no_timestamp").when((F.year("a") < lo) | (F.year("b") > hi), "extreme").when(F.year("a") < first_year, "left_censored").when(F.year("a") > first_year, "after").otherwise("included")
    return per.select("case_id", reason.alias("reason"), "n")


def reasons(classes: DataFrame) -> DataFrame:
    return classes.groupBy("reason").agg(F.count("*").alias("cases"), F.sum("n").alias("events"))


def first_year_cohort(log: DataFrame, year: int, lo: int, hi: int) -> DataFrame:
    """Events of cases that begin in `year`, without single events outside lo to hi."""
    begun = log.withColumn("first", F.min("ts").over(Window.partitionBy("case_id")))
    return begun.where((F.year("first") == year) & F.year("ts").between(lo, hi)).drop("first")
