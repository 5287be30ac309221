"""Registered queries of the event-log operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.functions import scalars as S
from loomflow.functions import sliced as L
from loomflow.functions import stats as T
from loomflow.operators import audit as A
from loomflow.operators import events as E
from loomflow.operators import schemas as J
from loomflow.plans import checks as C
from loomflow.plans import evaluate as V
from loomflow.plans import model as M
from loomflow.plans import programs as P
from loomflow.plans import resample as R
from loomflow.plans import sweep as W
from loomflow.plans.sql import build, event_ctes

#: Windows and thresholds that suit the synthetic events.
PROFILE = Config(start=datetime(2024, 1, 1), decision=datetime(2024, 1, 22), holdout_end=datetime(2024, 1, 31), cap=96.0, block_days=3, min_obs=100, min_block=10, sizes=(3, 5, 10))
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES = event_ctes(PROFILE)


def even(df: DataFrame) -> DataFrame:
    """Doubles to six places, zero without sign, and integers to long, as the SQL has them."""
    return df.select(*[(F.round(F.col(c), 6) + 0.0).alias(c) if k == "double" else F.col(c).cast("long").alias(c) if k in ("int", "smallint", "tinyint") or k.startswith("decimal") else F.col(c) for c, k in df.dtypes])


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: even(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = build(CTES if ctes is None else ctes, sql)
        return f

    return add


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.log_of(tbl(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.log_of(tbl(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.log_of(tbl(spark, sf_dir, "conversations"), "conv_id", None, "turn", "role")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tbl(spark, sf_dir, "lineitem").withColumn("ord", F.expr("l_linenumber * 10000000000L + l_partkey * 10000 + l_suppkey"))  # line numbers repeat
    return E.log_of(lines, "l_orderkey", "l_shipdate", "ord", F.concat("l_returnflag", "l_linestatus"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.observations(events(spark, sf_dir))


def hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.history(obs(spark, sf_dir), PROFILE)


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.holdout(obs(spark, sf_dir), PROFILE)


def metrics(spark: SparkSession, sf_dir: str, cfg: Config = PROFILE) -> DataFrame:
    return M.fit(hist(spark, sf_dir), cfg)


def r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


ORDERS = {"olog": "SELECT o_custkey AS case_id, o_orderdate AS ts, o_orderkey AS ord, o_orderpriority AS activity FROM orders"}
ITEMS = {"ilog": "SELECT l_orderkey AS case_id, l_shipdate AS ts, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS ord, l_returnflag || l_linestatus AS activity FROM lineitem"}
TALKS = {"tlog": "SELECT conv_id AS case_id, turn AS ord, role AS activity FROM conversations"}

# ---- sequence operators


@query("successor_pairing", f"SELECT case_id, CAST(origin AS VARCHAR) AS origin, origin_activity, transition, {r('delay')} FROM obs")
def _(spark, d):
    return obs(spark, d).select("case_id", F.col("origin").cast("string").alias("origin"), "origin_activity", "transition", "delay")


@query("adjacent_pairs", "SELECT transition, count(*) AS n FROM obs WHERE destination IS NOT NULL GROUP BY 1")
def _(spark, d):
    return obs(spark, d).where("destination is not null").groupBy("transition").agg(F.count("*").alias("n"))


@query("predecessor_pairing", "SELECT case_id, ord, activity, lag(activity) OVER w AS previous_activity, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9, 6) AS gap, row_number() OVER w = 1 AS is_first, lead(ord) OVER w IS NULL AS is_last FROM ilog WINDOW w AS (PARTITION BY case_id ORDER BY ord)", ITEMS)
def _(spark, d):
    return E.predecessors(items(spark, d)).select("case_id", "ord", "activity", "previous_activity", "gap", "is_first", "is_last")


@query("negative_gaps", "SELECT count(*) AS pairs, count_if(g < 0) AS negative, count_if(g = 0) AS zero, count_if(g >= 0) AS kept FROM (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY case_id ORDER BY ord)) AS g FROM ilog) WHERE g IS NOT NULL", ITEMS)
def _(spark, d):
    g = F.col("gap")
    return E.predecessors(items(spark, d)).where("gap is not null").agg(F.count("*").alias("pairs"), F.count_if(g < 0).alias("negative"), F.count_if(g == 0).alias("zero"), F.count_if(g >= 0).alias("kept"))


@query("tie_statistics", "SELECT count(*) AS tie_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS tie_pairs, count(DISTINCT case_id) AS tie_cases FROM (SELECT case_id, ts, count(*) AS n FROM olog GROUP BY ALL HAVING count(*) > 1)", ORDERS)
def _(spark, d):
    return E.ties(orders(spark, d))


@query("order_violations", "SELECT case_id, coalesce(bool_or(b), false) AS violated FROM (SELECT case_id, ts < lag(ts) OVER (PARTITION BY case_id ORDER BY ord) AS b FROM ilog) GROUP BY 1", ITEMS)
def _(spark, d):
    return E.cases(items(spark, d)).select("case_id", (~F.col("in_order")).alias("violated"))


@query("case_table", "SELECT case_id, CAST(min(ts) AS VARCHAR) AS case_start, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS cycle_hours, count(*) AS n_events, count(DISTINCT activity) AS n_activities, arg_min(activity, ord) AS start_activity, arg_max(activity, ord) AS end_activity, string_agg(activity, ' -> ' ORDER BY ord) AS variant FROM olog GROUP BY 1", ORDERS)
def _(spark, d):
    return E.cases(orders(spark, d)).select("case_id", F.col("case_start").cast("string").alias("case_start"), "cycle_hours", "n_events", "n_activities", "start_activity", "end_activity", "variant")


@query("variants", "SELECT variant, n, round(100.0 * n / (sum(n) OVER ()), 6) AS share, round(100.0 * sum(n) OVER o / (sum(n) OVER ()), 6) AS cum_share, row_number() OVER o AS rank, length FROM (SELECT variant, count(*) AS n, any_value(length) AS length FROM (SELECT case_id, string_agg(activity, ' -> ' ORDER BY ord) AS variant, count(*) AS length FROM tlog GROUP BY 1) GROUP BY 1) WINDOW o AS (ORDER BY n DESC, variant ROWS UNBOUNDED PRECEDING) ORDER BY rank LIMIT 5000", TALKS)
def _(spark, d):
    return E.variants(E.cases(talks(spark, d)))


@query("variants_for_80_pct", "SELECT count_if(c < 80) + 1 AS n FROM (SELECT 100.0 * sum(n) OVER (ORDER BY n DESC, variant ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS c FROM (SELECT variant, count(*) AS n FROM (SELECT case_id, string_agg(activity, ' -> ' ORDER BY ord) AS variant FROM tlog GROUP BY 1) GROUP BY 1))", TALKS)
def _(spark, d):
    return E.variants_for(E.cases(talks(spark, d)), 80)


@query("directly_follows_graph", "SELECT a, b, count(*) AS n FROM (SELECT activity AS a, lead(activity) OVER (PARTITION BY case_id ORDER BY ord) AS b FROM tlog) WHERE b IS NOT NULL GROUP BY ALL", TALKS)
def _(spark, d):
    return E.follows(talks(spark, d))


@query("start_end_activities", "SELECT side, activity, count(*) AS n FROM (SELECT 'start' AS side, arg_min(activity, ord) AS activity FROM tlog GROUP BY case_id UNION ALL SELECT 'end', arg_max(activity, ord) FROM tlog GROUP BY case_id) GROUP BY ALL", TALKS)
def _(spark, d):
    c = E.cases(talks(spark, d))
    both = c.select(F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start_activity").alias("activity")), F.struct(F.lit("end").alias("side"), F.col("end_activity").alias("activity")))).alias("x"))
    return both.groupBy("x.side", "x.activity").agg(F.count("*").alias("n"))


# ---- filters and projections


@query("history_filter", "SELECT transition, count(*) AS n FROM hist GROUP BY 1")
def _(spark, d):
    return hist(spark, d).groupBy("transition").agg(F.count("*").alias("n"))


@query("holdout_filter", "SELECT transition, count(*) AS n FROM held GROUP BY 1")
def _(spark, d):
    return held(spark, d).groupBy("transition").agg(F.count("*").alias("n"))


@query("lifecycle_filter", "SELECT o_orderstatus AS status, lower(trim(coalesce(o_orderstatus, ''))) = 'f' AS complete, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    o = tbl(spark, d, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status"), (F.lower(F.trim(F.coalesce("o_orderstatus", F.lit("")))) == "f").alias("complete")).agg(F.count("*").alias("n"))


@query("first_year_cohort", "SELECT year(ts) AS y, count(*) AS n, count(DISTINCT case_id) AS cases FROM (SELECT *, min(ts) OVER (PARTITION BY case_id) AS f FROM olog) WHERE year(f) = 1996 AND year(ts) BETWEEN 1996 AND 1999 GROUP BY 1", ORDERS)
def _(spark, d):
    return E.first_year_cohort(orders(spark, d), 1996, 1996, 1999).groupBy(F.year("ts").alias("y")).agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query("exclusion_reasons", "SELECT reason, count(*) AS cases, CAST(sum(n) AS BIGINT) AS events FROM (SELECT case_id, count(*) AS n, CASE WHEN min(ts) IS NULL THEN 'no_timestamp' WHEN year(min(ts)) < 1993 OR year(max(ts)) > 2000 THEN 'extreme' WHEN year(min(ts)) < 1996 THEN 'left_censored' WHEN year(min(ts)) > 1996 THEN 'after' ELSE 'included' END AS reason FROM olog GROUP BY 1) GROUP BY 1", ORDERS)
def _(spark, d):
    return E.reasons(E.classified(orders(spark, d), 1996, 1993, 2000))


@query("calendar_blocks", "SELECT block, count(*) AS n FROM (SELECT CAST(floor((epoch_us(origin) - epoch_us(TIMESTAMP '2024-01-01')) / 259200000000.0) AS BIGINT) AS block FROM hist) GROUP BY 1")
def _(spark, d):
    return hist(spark, d).groupBy(S.block(F.col("origin"), PROFILE.start, 3).alias("block")).agg(F.count("*").alias("n"))


@query("grid_snapping", "SELECT y, count(*) AS n FROM (SELECT least(greatest(round_even(least(delay, 96.0) / 24.0, 0) * 24.0, 0.0), 96.0) AS y FROM hist) GROUP BY 1")
def _(spark, d):
    return hist(spark, d).groupBy(S.snapped(S.capped(F.col("delay"), 96.0), 24.0, 96.0).alias("y")).agg(F.count("*").alias("n"))


@query("week_start", "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, count(*) AS n FROM log GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy(F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week")).agg(F.count("*").alias("n"))


@query("anchored_week", "SELECT CAST(floor((epoch_us(origin) - epoch_us(TIMESTAMP '2024-01-22')) / 604800000000.0) AS BIGINT) AS week, count(*) AS n, round(sum(least(delay, 96.0)), 6) AS burden FROM held GROUP BY 1")
def _(spark, d):
    return held(spark, d).groupBy(S.block(F.col("origin"), PROFILE.decision, 7).alias("week")).agg(F.count("*").alias("n"), F.sum(S.capped(F.col("delay"), 96.0)).alias("burden"))


@query("period_labels", "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    o = tbl(spark, d, "orders")
    return o.groupBy(S.month_label(F.col("o_orderdate")).alias("month"), S.quarter_label(F.col("o_orderdate")).alias("quarter")).agg(F.count("*").alias("n"))


@query("half_year_split", "SELECT CASE WHEN CAST(substring(strftime(o_orderdate, '%Y-%m'), 6, 2) AS INTEGER) <= 6 THEN 'H1' ELSE 'H2' END AS half, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    m = F.substring(S.month_label(F.col("o_orderdate")), 6, 2).cast("int")
    return tbl(spark, d, "orders").groupBy(F.when(m <= 6, "H1").otherwise("H2").alias("half")).agg(F.count("*").alias("n"))


@query("year_classes", "SELECT CASE WHEN year(o_orderdate) IN (1995, 2001) THEN 'boundary' WHEN year(o_orderdate) BETWEEN 1996 AND 2000 THEN 'core' ELSE 'extreme' END AS class, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    y = F.year("o_orderdate")
    return tbl(spark, d, "orders").groupBy(F.when(y.isin(1995, 2001), "boundary").when(y.between(1996, 2000), "core").otherwise("extreme").alias("class")).agg(F.count("*").alias("n"))


@query("period_buckets", "SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN origin < TIMESTAMP '2024-01-11' AND destination < TIMESTAMP '2024-01-11' THEN 'Q1' WHEN origin >= TIMESTAMP '2024-01-11' AND origin < TIMESTAMP '2024-01-21' AND destination < TIMESTAMP '2024-01-21' THEN 'Q2' WHEN origin >= TIMESTAMP '2024-01-21' AND destination IS NOT NULL THEN 'Q3' ELSE 'OTHER' END AS b FROM obs) WHERE b <> 'OTHER' GROUP BY 1")
def _(spark, d):
    o, e, a, b = F.col("origin"), F.col("destination"), S.at(datetime(2024, 1, 11)), S.at(datetime(2024, 1, 21))
    bucket = F.when((o < a) & (e < a), "Q1").when((o >= a) & (o < b) & (e < b), "Q2").when((o >= b) & e.isNotNull(), "Q3").otherwise("OTHER")
    return obs(spark, d).select(bucket.alias("bucket")).where("bucket != 'OTHER'").groupBy("bucket").agg(F.count("*").alias("n"))


@query("origin_reconstruction", "SELECT count(*) AS n, count_if(abs(epoch_us(destination) - CAST(round(delay * 3.6e9) AS BIGINT) - epoch_us(origin)) <= 1) AS same FROM hist")
def _(spark, d):
    back = F.timestamp_add("MICROSECOND", -F.round(F.col("delay") * S.MICROS).cast("long"), F.col("destination"))
    return hist(spark, d).agg(F.count("*").alias("n"), F.count_if(F.abs(S.micros(back, F.col("origin"))) <= 1).alias("same"))


@query("resource_kinds", "SELECT CASE WHEN lower(trim(role)) LIKE 'user%' THEN 'human' WHEN lower(trim(role)) LIKE 'batch%' THEN 'batch' WHEN role IS NULL OR upper(trim(role)) IN ('NONE', 'NULL', 'NA', '') THEN 'none' ELSE 'other' END AS kind, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    return tbl(spark, d, "conversations").groupBy(S.resource_kind(F.col("role")).alias("kind")).agg(F.count("*").alias("n"))


_ODD = "CASE event_id % 6 WHEN 0 THEN ' user_1' WHEN 1 THEN 'User_2' WHEN 2 THEN 'batch_3' WHEN 3 THEN 'NONE' WHEN 4 THEN 'clerk' END"


@query("resource_kinds_unstripped", f"SELECT CASE WHEN lower(x) LIKE 'user%' THEN 'human' WHEN lower(x) LIKE 'batch%' THEN 'batch' WHEN x IS NULL OR upper(trim(x)) IN ('NONE', 'NULL', 'NA', '') THEN 'none' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT {_ODD} AS x FROM events) GROUP BY 1")
def _(spark, d):
    return tbl(spark, d, "events").select(F.expr(_ODD).alias("x")).groupBy(S.resource_kind(F.col("x"), strip=False).alias("kind")).agg(F.count("*").alias("n"))


@query("resource_kinds_of_three", f"SELECT CASE WHEN lower(trim(x)) LIKE 'user%' THEN 'human' WHEN lower(trim(x)) LIKE 'batch%' THEN 'batch' ELSE 'none' END AS kind, count(*) AS n FROM (SELECT {_ODD} AS x FROM events) GROUP BY 1")
def _(spark, d):
    return tbl(spark, d, "events").select(F.expr(_ODD).alias("x")).groupBy(S.resource_kind(F.col("x"), strict=True).alias("kind")).agg(F.count("*").alias("n"))


@query("followup", "SELECT user_id AS case_id, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(ts))) / 3.6e9, 6) AS hours, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(ts))) / 3.6e9 / 24, 6) AS days FROM events GROUP BY 1")
def _(spark, d):
    h = S.hours(F.min("ts"), S.at(PROFILE.holdout_end))
    return events(spark, d).groupBy("case_id").agg(h.alias("hours"), (h / 24).alias("days"))


@query("typed_attributes", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def _(spark, d):
    return tbl(spark, d, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("time_range_scan", "SELECT count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def _(spark, d):
    t = F.col("ts")
    return tbl(spark, d, "events").where((t >= S.at(datetime(2024, 1, 5))) & (t < S.at(datetime(2024, 1, 10)))).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---- aggregations


@query("activity_counts", "SELECT activity, count(*) AS n, count(DISTINCT case_id) AS cases FROM log GROUP BY 1")
def _(spark, d):
    return events(spark, d).groupBy("activity").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases"))


@query("global_profile", "SELECT count(*) AS events, count(DISTINCT case_id) AS cases, count(DISTINCT activity) AS activities, CAST(min(ts) AS VARCHAR) AS first, CAST(max(ts) AS VARCHAR) AS last, count_if(activity IS NULL) AS no_activity, round(100.0 * count(ts) / count(*), 6) AS ts_coverage FROM log")
def _(spark, d):
    return events(spark, d).agg(F.count("*").alias("events"), F.countDistinct("case_id").alias("cases"), F.countDistinct("activity").alias("activities"), F.min("ts").cast("string").alias("first"), F.max("ts").cast("string").alias("last"), F.count_if(F.col("activity").isNull()).alias("no_activity"), (100.0 * F.count("ts") / F.count("*")).alias("ts_coverage"))


NINE = "count(delay) AS count, round(avg(delay), 6) AS mean, round(quantile_cont(delay, 0.5), 6) AS median, round(quantile_cont(delay, 0.75), 6) AS p75, round(quantile_cont(delay, 0.9), 6) AS p90, round(quantile_cont(delay, 0.95), 6) AS p95, round(quantile_cont(delay, 0.99), 6) AS p99, round(max(delay), 6) AS max, round(sum(delay), 6) AS total"


@query("nine_numbers", f"SELECT {NINE} FROM hist")
def _(spark, d):
    return T.nine(hist(spark, d), "delay", (PROFILE.decision - PROFILE.start).total_seconds() / 3600)


@query("grouped_nine_numbers", f"SELECT transition, {NINE} FROM hist GROUP BY 1 HAVING count(delay) >= 50")
def _(spark, d):
    return hist(spark, d).groupBy("transition").agg(*T.summary("delay")).where("count >= 50")


@query("share_and_tail_ratio", "SELECT transition, round(100.0 * sum(delay) / sum(sum(delay)) OVER (), 6) AS share, round(quantile_cont(delay, 0.95) / nullif(quantile_cont(delay, 0.5), 0), 6) AS tail_ratio FROM hist GROUP BY 1")
def _(spark, d):
    g = hist(spark, d).groupBy("transition").agg(F.sum("delay").alias("s"), F.percentile("delay", F.lit(0.95)).alias("p95"), F.percentile("delay", F.lit(0.5)).alias("p50"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("s").alias("all")))).select("transition", (100.0 * F.col("s") / F.col("all")).alias("share"), S.ratio(F.col("p95"), F.col("p50")).alias("tail_ratio"))


@query("category_summary", "SELECT 'status' AS dimension, o_orderstatus AS value, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY ALL")
def _(spark, d):
    o = tbl(spark, d, "orders")
    long = o.select("o_totalprice", F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(c).alias("value")) for n, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))])).alias("x"))
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("activity_entropy", "SELECT case_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS activities, round(-sum(c / n * ln(c / n)), 6) + 0.0 AS entropy FROM (SELECT case_id, activity, count(*) AS c, sum(count(*)) OVER (PARTITION BY case_id) AS n FROM log GROUP BY case_id, activity) GROUP BY 1")
def _(spark, d):
    return A.profiles(events(spark, d), "case_id").select("case_id", "n", "activities", "entropy")


@query("resource_profiles", "SELECT resource, n, activities, entropy, active_months FROM (SELECT resource, CAST(sum(c) AS BIGINT) AS n, count(*) AS activities, round(-sum(c / n * ln(c / n)), 6) + 0.0 AS entropy FROM (SELECT resource, activity, count(*) AS c, sum(count(*)) OVER (PARTITION BY resource) AS n FROM rlog GROUP BY resource, activity) GROUP BY 1) JOIN (SELECT resource, count(DISTINCT strftime(ts, '%Y-%m')) AS active_months FROM rlog GROUP BY 1) USING (resource)", {"rlog": "SELECT o_custkey AS resource, o_orderdate AS ts, o_orderpriority AS activity FROM orders"})
def _(spark, d):
    return A.profiles(orders(spark, d).withColumnRenamed("case_id", "resource"), "resource")


@query("cohort_performance", "SELECT strftime(s, '%Y-%m') AS month, count(*) AS n, round(quantile_cont(h, 0.5), 6) AS median, round(quantile_cont(h, 0.95), 6) AS p95, round(avg(CAST(k > 10 AS INTEGER)), 6) AS long_share FROM (SELECT case_id, min(ts) AS s, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS h, count(*) AS k FROM olog GROUP BY 1) GROUP BY 1", ORDERS)
def _(spark, d):
    c = E.cases(orders(spark, d))
    return c.groupBy(S.month_label(F.col("case_start")).alias("month")).agg(F.count("*").alias("n"), F.percentile("cycle_hours", F.lit(0.5)).alias("median"), F.percentile("cycle_hours", F.lit(0.95)).alias("p95"), F.avg((F.col("n_events") > 10).cast("int")).alias("long_share"))


@query("dense_cutoff", "SELECT max(n) AS peak, CAST(greatest(10, round_even(0.01 * max(n), 0)) AS BIGINT) AS threshold, (SELECT max(m) FROM mon WHERE n >= (SELECT greatest(10, round_even(0.01 * max(n), 0)) FROM mon)) AS last_dense FROM mon", {"mon": "SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1"})
def _(spark, d):
    m = tbl(spark, d, "orders").groupBy(S.month_label(F.col("o_orderdate")).alias("m")).agg(F.count("*").alias("n"))
    t = m.agg(F.max("n").alias("peak"), F.greatest(F.lit(10.0), F.bround(0.01 * F.max("n"), 0)).cast("long").alias("threshold"))
    return m.crossJoin(F.broadcast(t)).groupBy("peak", "threshold").agg(F.max(F.when(F.col("n") >= F.col("threshold"), F.col("m"))).alias("last_dense"))


@query("horizon_sweep", "SELECT days, count(*) AS cases, round(avg(k), 6) AS mean_events, round(quantile_cont(k, 0.5), 6) AS median_events FROM (SELECT case_id, count(*) AS k, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(min(ts))) / 8.64e10 AS f FROM log GROUP BY 1) JOIN (VALUES (5), (10), (20), (28)) AS v(days) ON f >= days GROUP BY 1")
def _(spark, d):
    c = events(spark, d).groupBy("case_id").agg(F.count("*").alias("k"), (S.hours(F.min("ts"), S.at(PROFILE.holdout_end)) / 24).alias("f"))
    days = F.explode(F.filter(F.array(*[F.lit(x) for x in (5, 10, 20, 28)]), lambda x: F.col("f") >= x))
    return c.select("k", days.alias("days")).groupBy("days").agg(F.count("*").alias("cases"), F.avg("k").alias("mean_events"), F.percentile("k", F.lit(0.5)).alias("median_events"))


@query("end_activity_mix", "SELECT q AS quarter, e AS end_activity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY q), 6) AS share FROM (SELECT CAST(year(max(ts)) AS VARCHAR) || 'Q' || CAST(quarter(max(ts)) AS VARCHAR) AS q, arg_max(activity, ord) AS e FROM olog GROUP BY case_id) GROUP BY q, e", ORDERS)
def _(spark, d):
    g = E.cases(orders(spark, d)).groupBy(S.quarter_label(F.col("case_end")).alias("quarter"), "end_activity").agg(F.count("*").alias("n"))
    return g.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("quarter")))


AUDIT = "count(*) AS origin_events, count_if(destination < cutoff) AS available_pairs, count_if(destination >= cutoff) AS later_recorded, count_if(destination IS NULL) AS no_successor, round(100.0 * count_if(destination IS NULL OR destination >= cutoff) / count(*), 6) AS pending_pct"
WINDOWS = [("snapshot", datetime(2024, 1, 1), datetime(2024, 1, 22), datetime(2024, 1, 22)), ("lag", datetime(2024, 1, 1), datetime(2024, 1, 22), datetime(2024, 1, 25)), ("week", datetime(2024, 1, 8), datetime(2024, 1, 15), datetime(2024, 1, 15))]


@query("availability_audit", f"SELECT label, {AUDIT} FROM obs JOIN (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}', TIMESTAMP '{c}')" for n, a, b, c in WINDOWS) + ") AS w(label, lo, hi, cutoff) ON origin >= lo AND origin < hi GROUP BY 1")
def _(spark, d):
    w = spark.createDataFrame([(n, str(a), str(b), str(c)) for n, a, b, c in WINDOWS], "label string, lo string, hi string, cutoff string")
    w = w.select("label", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("lo", "hi", "cutoff")])
    return V.availability(obs(spark, d), w, ["label"])


@query("block_histogram", f"SELECT transition, CAST(block AS BIGINT) AS block, {r('y')}, c FROM h")
def _(spark, d):
    return M.histogram(hist(spark, d), PROFILE)


@query("weekly_burden", "SELECT CAST(floor((epoch_us(origin) - epoch_us(TIMESTAMP '2024-01-22')) / 604800000000.0) AS BIGINT) AS week, transition, round(sum(least(delay, 96.0)), 6) AS burden FROM held GROUP BY ALL")
def _(spark, d):
    return held(spark, d).groupBy(S.block(F.col("origin"), PROFILE.decision, 7).alias("week"), "transition").agg(F.sum(S.capped(F.col("delay"), 96.0)).alias("burden"))


@query("bridge_rows", "SELECT transition, count_if(destination >= TIMESTAMP '2024-01-22') AS bridge, count_if(destination < TIMESTAMP '2024-01-22') AS inside, round(quantile_cont(CASE WHEN destination >= TIMESTAMP '2024-01-22' THEN delay END, 0.5), 6) AS median, CAST(min(CASE WHEN destination >= TIMESTAMP '2024-01-22' THEN destination END) AS VARCHAR) AS first FROM obs WHERE origin >= TIMESTAMP '2024-01-01' AND origin < TIMESTAMP '2024-01-22' AND destination IS NOT NULL GROUP BY 1")
def _(spark, d):
    late = F.col("destination") >= S.at(PROFILE.decision)
    o = F.col("origin")
    own = obs(spark, d).where((o >= S.at(PROFILE.start)) & (o < S.at(PROFILE.decision)) & F.col("destination").isNotNull())
    return own.groupBy("transition").agg(F.count_if(late).alias("bridge"), F.count_if(~late).alias("inside"), F.percentile(F.when(late, F.col("delay")), F.lit(0.5)).alias("median"), F.min(F.when(late, F.col("destination"))).cast("string").alias("first"))


_BITS = "CASE json_type(v) WHEN 'NULL' THEN 1 WHEN 'BOOLEAN' THEN 2 WHEN 'UBIGINT' THEN 4 WHEN 'BIGINT' THEN 4 WHEN 'DOUBLE' THEN 8 WHEN 'VARCHAR' THEN 16 WHEN 'ARRAY' THEN 32 ELSE 64 END"


def _profile_sql(scope: str, text: str) -> str:
    return (
        f"WITH o AS (SELECT {text} AS j FROM events), e AS (SELECT j, unnest(json_keys(j)) AS key FROM o), x AS (SELECT key, json_extract(j, '$.' || key) AS v FROM e), "
        f"y AS (SELECT key, {_BITS} AS bit, CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE CAST(v AS VARCHAR) END AS t FROM x), "
        "c AS (SELECT key, count(*) AS n, count(CASE WHEN bit = 1 THEN 1 END) AS nulls, bit_or(bit) AS bits FROM y GROUP BY 1), "
        "z AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) AS k FROM (SELECT DISTINCT key, substring(t, 1, 200) AS t FROM y WHERE bit > 1)), "
        "s AS (SELECT key, string_agg(t, ' | ' ORDER BY t) AS samples FROM z WHERE k <= 5 GROUP BY 1) "
        f"SELECT '{scope}' AS scope, key, CASE bits - (bits & 1) WHEN 0 THEN 'null' WHEN 2 THEN 'boolean' WHEN 4 THEN 'int' WHEN 8 THEN 'double' WHEN 12 THEN 'double' WHEN 32 THEN 'array' WHEN 64 THEN 'object' ELSE 'string' END AS tag, n, nulls, CAST(bit_count(bits) AS BIGINT) AS kinds, coalesce(samples, '') AS samples FROM c LEFT JOIN s USING (key)"
    )


#: JSON of events with keys of several types: numbers whole or not, texts, truth values, nulls, lists and objects.
_MIXED = ["'{\"id\":'", "event_id", "',\"part\":'", "CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR(20)) ELSE '0.5' END", "',\"kind\":'", "CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR(20)) WHEN 1 THEN concat('\"', event_type, '\"') ELSE 'true' END", "',\"gone\":'", "CASE WHEN event_id % 5 = 0 THEN 'false' ELSE 'null' END", "',\"list\":[1,2],\"inner\":{\"a\":1}}'"]


@query("schema_profile", _profile_sql("props", "props"))
def _(spark, d):
    return J.profile(tbl(spark, d, "events"), "props", "props")


@query("schema_profile_mixed", _profile_sql("mixed", f"concat({', '.join(_MIXED)})"))
def _(spark, d):
    return J.profile(tbl(spark, d, "events").select(F.expr(f"concat({', '.join(_MIXED)})").alias("j")), "j", "mixed")


@query("finite_quantiles", "SELECT count(*) AS n, round(quantile_cont(rho, 0.5), 6) AS median, round(quantile_cont(rho, 0.75), 6) AS p75, round(quantile_cont(rho, 0.9), 6) AS p90, round(max(rho), 6) AS max FROM met WHERE rho > 0")
def _(spark, d):
    q = lambda p, n: F.percentile("rho", F.lit(p)).alias(n)
    return metrics(spark, d).where("rho > 0").agg(F.count("*").alias("n"), q(0.5, "median"), q(0.75, "p75"), q(0.9, "p90"), F.max("rho").alias("max"))


# ---- statistics


@query("empirical_cvar", f"SELECT transition, n, {r('mean', 'cvar')} FROM cv")
def _(spark, d):
    h = M.histogram(hist(spark, d), PROFILE)
    return T.cvar(M.pooled(h, ["transition"]), ["transition"], PROFILE.tail, PROFILE.cap)


@query("robust_cvar", f"SELECT transition, {r('epsilon', 'epsilon_sat', 'risk', 'rho')} FROM met")
def _(spark, d):
    return metrics(spark, d).select("transition", "epsilon", "epsilon_sat", "risk", "rho")


@query("block_distances", f"SELECT transition, CAST(block AS BIGINT) AS block, {r('d')} FROM dist")
def _(spark, d):
    h = M.histogram(hist(spark, d), PROFILE)
    return M.distances(h, ["transition"], PROFILE).select("transition", "block", "d")


MET = "transition, n, valid_blocks, required, strict_eligibility, " + r("frequency", "mean", "cvar", "epsilon", "epsilon_sat", "rho", "m_cap") + ", empirically_saturated, saturated, sa_saturated, " + r("risk", "sa_epsilon", "sa_risk", "mean_score", "tail_score", "dro_score", "sa_score")


@query("metrics", f"SELECT {MET} FROM met")
def _(spark, d):
    return metrics(spark, d)


for _name, _cfg in {
    "metrics_leave_one_out": PROFILE.but(reference="leave_one_block_out"), "metrics_grid": PROFILE.but(grid=6.0), "metrics_alpha_90": PROFILE.but(alpha=0.9),
    "metrics_kappa_50": PROFILE.but(kappa=0.5), "metrics_double_radius": PROFILE.but(multiplier=2.0), "metrics_cap_60": PROFILE.but(cap=60.0), "metrics_weekly_blocks": PROFILE.but(block_days=7),
    "metrics_radius_quantile_75": PROFILE.but(radius_q=0.75),
}.items():

    def _fit(spark, d, cfg=_cfg):
        return metrics(spark, d, cfg)

    query(_name, f"SELECT {MET} FROM met", event_ctes(_cfg))(_fit)


@query("saturation_diagnostic", "SELECT count(*) AS candidates, count_if(empirically_saturated) AS empirical, count_if(saturated AND NOT empirically_saturated) AS induced, count_if(saturated) AS total, round(quantile_cont(rho, 0.5), 6) AS median_rho, round(quantile_cont(epsilon, 0.5), 6) AS median_epsilon FROM met")
def _(spark, d):
    return M.diagnostic(metrics(spark, d))


@query("transport_threshold", "SELECT transition, round(coalesce(sum(greatest(0.0, least(p, m - (cp - p))) * (96.0 - y)), 0.0), 6) AS threshold FROM tot LEFT JOIN (SELECT transition, y, w / n AS p, sum(w) OVER (PARTITION BY transition ORDER BY y DESC) / n AS cp, greatest(0.0, " + repr(PROFILE.tail) + " - m_cap) AS m FROM pool JOIN tot USING (transition) JOIN mcap USING (transition) WHERE y < 96.0) USING (transition) GROUP BY 1")
def _(spark, d):
    h = M.histogram(hist(spark, d), PROFILE)
    return T.transport(M.pooled(h, ["transition"]), ["transition"], PROFILE.cap, PROFILE.tail)


W1 = "SELECT transition, round(sum(abs(c0 / n0 - c1 / n1) * dx), 6) AS w1 FROM (SELECT transition, y, sum(w0) OVER o AS c0, sum(w1) OVER o AS c1, lead(y) OVER o - y AS dx, sum(w0) OVER p AS n0, sum(w1) OVER p AS n1 FROM (SELECT transition, y, count_if(s = 0) AS w0, count_if(s = 1) AS w1 FROM side GROUP BY ALL) WINDOW o AS (PARTITION BY transition ORDER BY y), p AS (PARTITION BY transition)) WHERE n0 > 0 AND n1 > 0 GROUP BY 1"
SIDE = CTES | {"side": "SELECT transition, least(delay, 96.0) AS y, CASE WHEN origin < TIMESTAMP '2024-01-11' THEN 0 ELSE 1 END AS s FROM hist"}


def _sides(spark, d):
    return hist(spark, d).select("transition", S.capped(F.col("delay"), 96.0).alias("y"), F.when(F.col("origin") < S.at(datetime(2024, 1, 11)), 0).otherwise(1).alias("s"))


@query("wasserstein_drift", W1, SIDE)
def _(spark, d):
    return T.wasserstein(_sides(spark, d).groupBy("transition", "s", "y").agg(F.count("*").alias("w")), ["transition"], "s", PROFILE.cap)


@query("temporal_drift", "SELECT transition, count_if(s = 0) AS n0, count_if(s = 1) AS n1, round(quantile_cont(CASE WHEN s = 0 THEN y END, 0.5), 6) AS median0, round(quantile_cont(CASE WHEN s = 1 THEN y END, 0.5), 6) AS median1, round(avg(CASE WHEN s = 1 THEN y END) / nullif(avg(CASE WHEN s = 0 THEN y END), 0), 6) AS ratio FROM side GROUP BY 1 HAVING count_if(s = 0) >= 50 AND count_if(s = 1) >= 50", SIDE)
def _(spark, d):
    y = lambda k: F.when(F.col("s") == k, F.col("y"))
    out = _sides(spark, d).groupBy("transition").agg(F.count_if(F.col("s") == 0).alias("n0"), F.count_if(F.col("s") == 1).alias("n1"), F.percentile(y(0), F.lit(0.5)).alias("median0"), F.percentile(y(1), F.lit(0.5)).alias("median1"), S.ratio(F.avg(y(1)), F.avg(y(0))).alias("ratio"))
    return out.where("n0 >= 50 and n1 >= 50")


# ---- ranking, sets, evaluation


@query("portfolios", "SELECT method, CAST(K AS BIGINT) AS K, rank, transition FROM port")
def _(spark, d):
    return M.portfolios(metrics(spark, d), PROFILE)


SMALL = PROFILE.but(min_obs=10, min_block=2)


@query("portfolios_small", "SELECT method, CAST(K AS BIGINT) AS K, rank, transition FROM port", event_ctes(SMALL))
def _(spark, d):
    return M.portfolios(metrics(spark, d, SMALL), SMALL)


@query("top_transitions", "SELECT transition, count(*) AS n FROM hist GROUP BY 1 ORDER BY n DESC, transition LIMIT 10")
def _(spark, d):
    return hist(spark, d).groupBy("transition").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "transition").limit(10)


@query("outcomes", f"SELECT transition, n, {r('mean', 'cvar', 'mean_burden', 'tail_burden')} FROM outc")
def _(spark, d):
    return V.outcomes(held(spark, d), PROFILE)


@query("oracle_global", f"SELECT target, CAST(K AS BIGINT) AS K, rank, transition, {r('burden')} FROM orac_g")
def _(spark, d):
    return V.oracle(V.outcomes(held(spark, d), PROFILE), PROFILE)


@query("oracle_eligible", f"SELECT target, CAST(K AS BIGINT) AS K, rank, transition, {r('burden')} FROM orac_e")
def _(spark, d):
    return V.oracle(V.outcomes(held(spark, d), PROFILE), PROFILE, metrics(spark, d))


def _evaluation_sql(scope: str, clamp: bool) -> str:
    cols = []
    for t in ("mean", "tail"):
        regret = f"100 * ({t}_{scope} - {t}_sum) / all_{t}"
        cols += [
            f"round(100 * {t}_sum / all_{t}, 6) AS {t}_share_pct", f"round(100 * {t}_eligible / all_{t}, 6) AS {t}_oracle_eligible_pct", f"round(100 * {t}_global / all_{t}, 6) AS {t}_oracle_global_pct",
            f"round({f'greatest(0.0, {regret})' if clamp else regret}, 6) AS {t}_regret_pp", f"round(len(list_intersect(members, {t}_{scope}_set)) / len(list_distinct(members || {t}_{scope}_set)), 6) AS jaccard_{t}_oracle",
            f"round(100 * {t}_cand / all_{t}, 6) AS candidate_{t}_coverage_pct",
        ]
    return f"SELECT method, CAST(K AS BIGINT) AS K, {', '.join(cols)}, transitions AS holdout_transitions, observations AS holdout_observations FROM chosen JOIN be USING (K) JOIN bg USING (K), alls, covered"


EVAL = CTES | {
    "chosen": "SELECT method, K, coalesce(sum(mean_burden), 0.0) AS mean_sum, coalesce(sum(tail_burden), 0.0) AS tail_sum, list(transition) AS members FROM port LEFT JOIN outc USING (transition) GROUP BY ALL",
    "be": "SELECT K, sum(CASE WHEN target = 'mean' THEN burden END) AS mean_eligible, sum(CASE WHEN target = 'tail' THEN burden END) AS tail_eligible, list(transition) FILTER (target = 'mean') AS mean_eligible_set, list(transition) FILTER (target = 'tail') AS tail_eligible_set FROM orac_e GROUP BY 1",
    "bg": "SELECT K, sum(CASE WHEN target = 'mean' THEN burden END) AS mean_global, sum(CASE WHEN target = 'tail' THEN burden END) AS tail_global, list(transition) FILTER (target = 'mean') AS mean_global_set, list(transition) FILTER (target = 'tail') AS tail_global_set FROM orac_g GROUP BY 1",
    "alls": "SELECT sum(mean_burden) AS all_mean, sum(tail_burden) AS all_tail, CAST(sum(n) AS BIGINT) AS observations, count(*) AS transitions FROM outc",
    "covered": "SELECT sum(mean_burden) AS mean_cand, sum(tail_burden) AS tail_cand FROM outc WHERE transition IN (SELECT transition FROM met)",
}


@query("holdout_evaluation", _evaluation_sql("eligible", True), EVAL)
def _(spark, d):
    m = metrics(spark, d)
    return V.evaluate(m, M.portfolios(m, PROFILE), held(spark, d), PROFILE)


@query("holdout_evaluation_unclamped", _evaluation_sql("global", False), EVAL)
def _(spark, d):
    m = metrics(spark, d)
    return V.evaluate(m, M.portfolios(m, PROFILE), held(spark, d), PROFILE, clamp=False)


@query("portfolio_overlap", "SELECT CAST(a.K AS BIGINT) AS K, a.method AS left_method, b.method AS right_method, round(len(list_intersect(a.members, b.members)) / len(list_distinct(a.members || b.members)), 6) AS jaccard, a.members = b.members AS same_membership FROM sets a JOIN sets b ON a.K = b.K JOIN morder x ON x.method = a.method JOIN morder z ON z.method = b.method WHERE x.k < z.k")
def _(spark, d):
    return V.overlap(M.portfolios(metrics(spark, d), PROFILE), PROFILE)


_TAU = "SELECT method, sum(sign(sa - sb) * sign({t}a - {t}b)) / nullif(sqrt(sum(abs(sign(sa - sb))) * sum(abs(sign({t}a - {t}b)))), 0) AS tau FROM prs GROUP BY 1"
TAU = CTES | {
    "both_": "SELECT method, transition, score, mean_burden, tail_burden FROM scores JOIN outc USING (transition)",
    "prs": "SELECT a.method, a.score AS sa, b.score AS sb, a.mean_burden AS ma, b.mean_burden AS mb, a.tail_burden AS ta, b.tail_burden AS tb FROM both_ a JOIN both_ b ON a.method = b.method AND a.transition < b.transition",
    "taum": _TAU.format(t="m"), "taut": _TAU.format(t="t"),
}


@query("rank_agreement", "SELECT method, (SELECT count(*) FROM both_ b WHERE b.method = taum.method) AS common, round(taum.tau, 6) AS kendall_mean, round(taut.tau, 6) AS kendall_tail FROM taum JOIN taut USING (method)", TAU)
def _(spark, d):
    return V.rank_agreement(metrics(spark, d), V.outcomes(held(spark, d), PROFILE), PROFILE)


@query("spearman", "SELECT method, round(corr(rx, ry), 6) AS rho FROM (SELECT method, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY method ORDER BY tail_burden) + (count(*) OVER (PARTITION BY method, tail_burden) - 1) / 2.0 AS ry FROM both_) GROUP BY 1", TAU)
def _(spark, d):
    both = M.by_method(metrics(spark, d), PROFILE).join(V.outcomes(held(spark, d), PROFILE), "transition")
    return T.spearman(both, ["method"], "score", "tail_burden")


@query("portfolio_members_left_semi", "SELECT transition, count(*) AS n FROM held WHERE transition IN (SELECT transition FROM port) GROUP BY 1")
def _(spark, d):
    return held(spark, d).join(M.portfolios(metrics(spark, d), PROFILE), "transition", "left_semi").groupBy("transition").agg(F.count("*").alias("n"))


@query("outsiders_left_anti", "SELECT transition, n FROM outc WHERE transition NOT IN (SELECT transition FROM port)")
def _(spark, d):
    return V.outcomes(held(spark, d), PROFILE).join(M.portfolios(metrics(spark, d), PROFILE), "transition", "left_anti").select("transition", "n")


@query("all_activities_union", "SELECT DISTINCT a AS activity FROM (SELECT origin_activity AS a FROM obs UNION ALL SELECT split_part(transition, ' -> ', 2) FROM obs WHERE transition IS NOT NULL)")
def _(spark, d):
    o = obs(spark, d)
    return o.select(F.col("origin_activity").alias("activity")).union(o.where("transition is not null").select(F.split("transition", S.ARROW)[1])).distinct()


# ---- resampling, checks and sensitivity

REPS, REFITS, PERMUTATIONS = 1000, 500, 100


def _drawn(weights) -> str:
    """(rep, cluster, weight) of weights that are not zero."""
    return ", ".join(f"({rep}, {k}, {w})" for rep, row in enumerate(weights.tolist()) for k, w in enumerate(row) if w)


def boot_ctes(cfg: Config, days: float, clusters: int) -> dict[str, str]:
    """From the holdout to the shares of each replicate of a calendar scheme, and differences of portfolios and of the oracle."""
    return event_ctes(cfg) | {
        "wts": f"SELECT * FROM (VALUES {_drawn(L.Calendar(clusters, REPS, cfg.seed).weights)}) AS v(rep, cluster, weight)",
        "bpmf": f"SELECT rep, transition, y, CAST(sum(c * weight) AS BIGINT) AS w FROM (SELECT transition, CAST(floor((epoch_us(origin) - epoch_us(TIMESTAMP '{cfg.decision}')) / {days * 86400e6!r}) AS INTEGER) AS cluster, least(delay, {cfg.cap!r}) AS y, count(*) AS c FROM held GROUP BY ALL) JOIN wts USING (cluster) GROUP BY ALL",
        "btot": "SELECT rep, transition, CAST(sum(w) AS BIGINT) AS n, sum(y * w) AS mean_burden FROM bpmf GROUP BY ALL",
        "bcum": "SELECT *, sum(w) OVER (PARTITION BY rep, transition ORDER BY y DESC) AS cw FROM bpmf",
        "breps": f"SELECT rep, transition, mean_burden, n * sum(y * greatest(0.0, least(w, n * {cfg.tail!r} - (cw - w)))) / (n * {cfg.tail!r}) AS tail_burden FROM bcum JOIN btot USING (rep, transition) GROUP BY rep, transition, n, mean_burden",
        "btargets": "SELECT rep, transition, 'mean' AS target, mean_burden AS burden FROM breps UNION ALL SELECT rep, transition, 'tail', tail_burden FROM breps",
        "ball": "SELECT rep, target, sum(burden) AS total FROM btargets GROUP BY ALL",
        "bshare": "SELECT b.rep, b.target, p.method, p.K, 100 * coalesce(sum(x.burden), 0.0) / any_value(total) AS share FROM ball b CROSS JOIN port p LEFT JOIN btargets x ON x.rep = b.rep AND x.target = b.target AND x.transition = p.transition GROUP BY b.rep, b.target, p.method, p.K",
        "branked": "SELECT rep, target, burden, row_number() OVER (PARTITION BY rep, target ORDER BY burden DESC, transition) AS rk FROM btargets WHERE transition IN (SELECT transition FROM met)",
        "bbest": "SELECT b.rep, b.target, s.K, 100 * coalesce(sum(x.burden), 0.0) / any_value(total) AS share FROM ball b CROSS JOIN sizes s LEFT JOIN branked x ON x.rep = b.rep AND x.target = b.target AND x.rk <= s.K GROUP BY b.rep, b.target, s.K",
        "bdiff": "SELECT a.K, a.method AS left_method, b.method AS right_method, a.target, a.share - b.share AS d FROM bshare a JOIN bshare b ON a.rep = b.rep AND a.K = b.K AND a.target = b.target JOIN morder x ON x.method = a.method JOIN morder z ON z.method = b.method WHERE x.k < z.k",
        "bover": f"SELECT a.K, '{R.ORACLE}' AS left_method, b.method AS right_method, a.target, a.share - b.share AS d FROM bbest a JOIN bshare b ON a.rep = b.rep AND a.K = b.K AND a.target = b.target",
        "bsame": "SELECT a.K, a.method AS left_method, b.method AS right_method, a.members = b.members AS same FROM sets a JOIN sets b ON a.K = b.K",
    }


BOOT = boot_ctes(PROFILE, 3, 3)
DIFFERENCES = "SELECT CAST(K AS BIGINT) AS K, left_method, right_method, target, round(avg(d), 6) + 0.0 AS difference, round(quantile_cont(d, 0.025), 6) + 0.0 AS lower, round(quantile_cont(d, 0.975), 6) + 0.0 AS upper, any_value(coalesce(same, false)) AS identical FROM (SELECT * FROM bdiff UNION ALL SELECT * FROM bover) LEFT JOIN bsame USING (K, left_method, right_method) GROUP BY K, left_method, right_method, target"
#: A longer holdout, for schemes of one to four weeks, and portfolios of a short history.
EARLY = PROFILE.but(decision=datetime(2024, 1, 8), block_days=1, min_obs=20, min_block=2)


def _boot(spark, d, cfg: Config, days: float) -> DataFrame:
    o = obs(spark, d)
    m = M.fit(E.history(o, cfg), cfg)
    own, _, weigh = R.schemes(E.holdout(o, cfg), cfg, (days,), REPS)[f"calendar_{days:g}d"]
    return R.paired_bootstrap(own, M.portfolios(m, cfg), m, cfg, weigh, REPS)


@query("bootstrap_shares", "SELECT CAST(rep AS BIGINT) AS rep, target, method, CAST(K AS BIGINT) AS K, round(share, 6) AS share FROM bshare", BOOT)
def _(spark, d):
    weigh = L.Calendar(3, REPS, PROFILE.seed)
    return R.shares(R.burdens(R.calendar(held(spark, d), PROFILE, 3), weigh, PROFILE, REPS), M.portfolios(metrics(spark, d), PROFILE))


@query("oracle_of_replicates", "SELECT CAST(rep AS BIGINT) AS rep, target, CAST(K AS BIGINT) AS K, round(share, 6) AS share FROM bbest", BOOT)
def _(spark, d):
    weigh = L.Calendar(3, REPS, PROFILE.seed)
    return R.oracle_shares(R.burdens(R.calendar(held(spark, d), PROFILE, 3), weigh, PROFILE, REPS), metrics(spark, d), PROFILE)


@query("paired_bootstrap", DIFFERENCES, BOOT)
def _(spark, d):
    return _boot(spark, d, PROFILE, 3)


for _days, _clusters in ((7, 4), (14, 2), (28, 1)):

    def _scheme(spark, d, days=_days):
        return _boot(spark, d, EARLY, days)

    query(f"paired_bootstrap_{_days}d", DIFFERENCES, boot_ctes(EARLY, _days, _clusters))(_scheme)


@query("superiority_gate", "SELECT coalesce(bool_and(lower > 0 AND difference > 0), false) AS superior FROM (SELECT avg(d) AS difference, quantile_cont(d, 0.025) AS lower FROM bdiff GROUP BY K, left_method, right_method, target)", BOOT)
def _(spark, d):
    return R.superior(_boot(spark, d, PROFILE, 3).where(F.col("left_method") != R.ORACLE))


@query("paired_bootstrap_cases")
def _(spark, d):
    m = metrics(spark, d)
    own, _, weigh = R.schemes(held(spark, d), PROFILE, (), REPS)["case_cluster"]
    return R.paired_bootstrap(own, M.portfolios(m, PROFILE), m, PROFILE, weigh, REPS)


BLOCKS = L.Calendar(PROFILE.blocks, REFITS, PROFILE.seed + 11).weights
_T, _CAP = repr(PROFILE.tail), repr(PROFILE.cap)
REFIT = CTES | {
    "rw": f"SELECT * FROM (VALUES {_drawn(BLOCKS)}) AS v(rep, block, weight)",
    "rh": "SELECT rep, transition, block, y, c, weight FROM h JOIN rw USING (block)",
    "rpool": "SELECT rep, transition, y, CAST(sum(c * weight) AS BIGINT) AS w FROM rh GROUP BY ALL",
    "rtot": "SELECT rep, transition, CAST(sum(w) AS BIGINT) AS n, sum(y * w) / sum(w) AS mean FROM rpool GROUP BY ALL",
    "rcum": "SELECT *, sum(w) OVER (PARTITION BY rep, transition ORDER BY y DESC) AS cw FROM rpool",
    "rcv": f"SELECT rep, transition, n, mean, sum(y * greatest(0.0, least(w, n * {_T} - (cw - w)))) / (n * {_T}) AS cvar FROM rcum JOIN rtot USING (rep, transition) GROUP BY rep, transition, n, mean",
    "rper": f"SELECT rep, transition, block, sum(c) AS n_b, any_value(weight) AS weight, sum(c) >= {PROFILE.min_block} AS good FROM rh GROUP BY ALL",
    "rvalid": "SELECT rep, transition, sum(CASE WHEN good THEN weight ELSE 0 END) AS valid_blocks FROM rper GROUP BY ALL",
    "rcdf": "SELECT rep, transition, y, sum(w) OVER o AS cw, lead(y) OVER o - y AS dx FROM rpool WINDOW o AS (PARTITION BY rep, transition ORDER BY y)",
    "rdense": "SELECT d.rep, d.transition, v.block, v.weight, cw, dx, n_b, sum(coalesce(c, 0)) OVER (PARTITION BY d.rep, d.transition, v.block ORDER BY d.y) AS cb FROM rcdf d JOIN rper v ON d.rep = v.rep AND d.transition = v.transition AND v.good LEFT JOIN h ON h.transition = d.transition AND h.block = v.block AND h.y = d.y",
    "rdist": "SELECT rep, transition, block, any_value(weight) AS weight, sum(abs(cb / n_b - cw / n) * dx) AS d FROM rdense JOIN rtot USING (rep, transition) GROUP BY ALL",
    "rrad": f"SELECT rep, transition, quantile_cont(d, {PROFILE.radius_q!r}) AS epsilon FROM (SELECT rep, transition, d, unnest(range(weight)) FROM rdist) GROUP BY ALL",
    "rcal": f"SELECT *, n / sum(n) OVER (PARTITION BY rep) AS frequency, greatest(0.0, {_T} * ({_CAP} - cvar)) AS sat, n >= {PROFILE.min_obs} AND valid_blocks >= {-(-PROFILE.coverage * PROFILE.blocks // 1)} AS able FROM rcv JOIN rvalid USING (rep, transition) LEFT JOIN rrad USING (rep, transition)",
    "rsc": f"SELECT *, least({_CAP}, cvar + greatest(0.0, epsilon) / {_T}) AS risk, least({_CAP}, cvar + greatest(0.0, CASE WHEN sat <= 1e-8 THEN 0.0 ELSE least(epsilon, {PROFILE.kappa!r} * sat) END) / {_T}) AS sa_risk FROM rcal",
    "rfro": "SELECT rsc.* REPLACE (met.risk AS risk, met.sa_risk AS sa_risk) FROM rsc JOIN met USING (transition)",
    "able": "SELECT quantile_cont(n, 0.5) AS median_candidates, min(n) AS min_candidates, max(n) AS max_candidates FROM (SELECT count_if(able) AS n FROM {0} GROUP BY rep)",
    "rscore": "SELECT rep, transition, unnest(['Frequency', 'Mean burden', 'Empirical Tail', 'Original DRO', 'Saturation-Aware DRO']) AS method, unnest([frequency, frequency * mean, frequency * cvar, frequency * risk, frequency * sa_risk]) AS score FROM {0} WHERE able",
    "rport": "SELECT rep, method, K, transition FROM (SELECT *, row_number() OVER (PARTITION BY rep, method ORDER BY round(score, 10) DESC, transition) AS rank FROM rscore) JOIN sizes ON rank <= K",
    "rsets": "SELECT rep, method, K, list(transition) AS x FROM rport GROUP BY ALL",
    "rjac": "SELECT rsets.method, rsets.K, len(list_intersect(x, members)) / len(list_distinct(x || members)) AS j FROM rsets JOIN sets ON sets.method = rsets.method AND sets.K = rsets.K",
}
STABILITY = "SELECT method, CAST(K AS BIGINT) AS K, count(*) AS replicates, round(avg(j), 6) AS mean_jaccard, round(quantile_cont(j, 0.05), 6) AS p05_jaccard, round(quantile_cont(j, 0.95), 6) AS p95_jaccard, count_if(j >= 0.8) AS at_least_80, any_value(median_candidates) AS median_candidates, any_value(min_candidates) AS min_candidates, any_value(max_candidates) AS max_candidates FROM rjac, able GROUP BY method, K"


def _refit_ctes(scored: str) -> dict[str, str]:
    return {k: v.replace("{0}", scored) for k, v in REFIT.items()}


@query("selection_stability", STABILITY, _refit_ctes("rsc"))
def _(spark, d):
    h = hist(spark, d)
    return R.stability(R.refits(h, BLOCKS, PROFILE), M.portfolios(M.fit(h, PROFILE), PROFILE), PROFILE)


@query("selection_probabilities", f"SELECT method, CAST(K AS BIGINT) AS K, transition, round(n / {REFITS}, 6) AS selection_probability, round(e / {REFITS}, 6) AS eligibility_probability, EXISTS (SELECT 1 FROM port p WHERE p.method = x.method AND p.K = x.K AND p.transition = x.transition) AS in_primary FROM (SELECT method, K, transition, count(*) AS n FROM rport GROUP BY ALL) x JOIN (SELECT transition, count_if(able) AS e FROM rsc GROUP BY 1) USING (transition)", _refit_ctes("rsc"))
def _(spark, d):
    h = hist(spark, d)
    return R.probabilities(R.refits(h, BLOCKS, PROFILE), M.portfolios(M.fit(h, PROFILE), PROFILE), PROFILE, REFITS)


@query("frozen_stability", STABILITY, _refit_ctes("rfro"))
def _(spark, d):
    h = hist(spark, d)
    m = M.fit(h, PROFILE)
    return R.stability(R.frozen(R.refits(h, BLOCKS, PROFILE), m), M.portfolios(m, PROFILE), PROFILE)


NOISE = CTES | {
    "nown": f"SELECT transition, case_id, origin, least(delay, {_CAP}) AS y FROM hist WHERE transition IN (SELECT transition FROM met)",
    "nends": "SELECT transition, block, n_b, sum(n_b) OVER (PARTITION BY transition ORDER BY block) - n_b AS lo, sum(n_b) OVER (PARTITION BY transition ORDER BY block) AS hi FROM perblock",
    "nplace": f"SELECT transition, rep, y, row_number() OVER (PARTITION BY transition, rep ORDER BY md5({PROFILE.seed + 23} || ':' || rep || ':' || transition || ':' || coalesce(CAST(case_id AS VARCHAR), '') || ':' || epoch_us(origin)), y) - 1 AS place FROM nown, range({PERMUTATIONS}) AS r(rep)",
    "nh": "SELECT p.rep, p.transition, e.block, p.y, count(*) AS c FROM nplace p JOIN nends e ON e.transition = p.transition AND place >= lo AND place < hi GROUP BY ALL",
    "ndense": f"SELECT r.rep, d.transition, v.block, cw, dx, n_b, sum(coalesce(c, 0)) OVER (PARTITION BY r.rep, d.transition, v.block ORDER BY d.y) AS cb FROM range({PERMUTATIONS}) AS r(rep), cdf d JOIN valid v ON d.transition = v.transition LEFT JOIN nh ON nh.rep = r.rep AND nh.transition = d.transition AND nh.block = v.block AND nh.y = d.y WHERE d.transition IN (SELECT transition FROM met)",
    "ndist": "SELECT rep, transition, block, sum(abs(cb / n_b - cw / n) * dx) AS d FROM ndense JOIN tot USING (transition) GROUP BY ALL",
    "nrad": f"SELECT rep, transition, quantile_cont(d, {PROFILE.radius_q!r}) AS e FROM ndist GROUP BY ALL",
    "nnull": "SELECT transition, quantile_cont(e, 0.5) AS null_median, quantile_cont(e, 0.95) AS null_p95 FROM nrad GROUP BY 1",
    "nbench": "SELECT transition, epsilon AS observed, null_median, null_p95, epsilon > null_p95 AS above FROM met JOIN nnull USING (transition)",
}


@query("permuted_blocks", "SELECT CAST(rep AS BIGINT) AS rep, transition, CAST(block AS BIGINT) AS block, CAST(sum(c) AS BIGINT) AS n, round(sum(c * y), 3) AS burden FROM nh GROUP BY ALL", NOISE)
def _(spark, d):
    h = hist(spark, d)
    return R.Dealt(h, M.fit(h, PROFILE), PROFILE, PERMUTATIONS).sums().withColumn("burden", F.round("burden", 3))


@query("noise_benchmark", f"SELECT transition, {r('observed', 'null_median', 'null_p95')}, above FROM nbench", NOISE)
def _(spark, d):
    h = hist(spark, d)
    return R.noise(h, M.fit(h, PROFILE), PROFILE, PERMUTATIONS)


@query("noise_summary", "SELECT count(*) AS transitions, count_if(above) AS above_p95, round(quantile_cont(observed / nullif(null_median, 0), 0.5), 6) AS median_ratio FROM nbench", NOISE)
def _(spark, d):
    h = hist(spark, d)
    return R.noise_summary(R.noise(h, M.fit(h, PROFILE), PROFILE, PERMUTATIONS))


GRID = PROFILE.but(grid=6.0)
GRIDS = event_ctes(GRID)
PROGRAM = GRIDS | {
    "pp": "SELECT transition, y, w / n AS p FROM pool JOIN tot USING (transition)",
    "tt": "SELECT transition, y AS t FROM pp UNION SELECT transition, unnest([0.0, 96.0]) FROM tot",
    "cc": "SELECT transition, t, (96.0 - t) / (96.0 - y) AS lam FROM tt JOIN pp USING (transition) WHERE y < 96.0 UNION SELECT transition, t, unnest([0.0, 1.0]) FROM tt",
    "ss": "SELECT transition, t, lam, sum(p * greatest(0.0, y - t, 96.0 - t - lam * (96.0 - y))) AS s FROM cc JOIN pp USING (transition) GROUP BY ALL",
    "ee": "SELECT transition, cvar, unnest(['zero', 'half', 'threshold', 'double', 'own']) AS label, unnest([0.0, 0.5 * epsilon_sat, epsilon_sat, 2 * epsilon_sat, epsilon]) AS eps FROM met",
}


def _grid_pmf(spark, d):
    return M.pooled(M.histogram(hist(spark, d), GRID), ["transition"])


@query("linear_program_checks", f"SELECT transition, label, round(min(t + (eps * lam + s) / {GRID.tail!r}), 6) AS program, round(any_value(least(96.0, cvar + greatest(0.0, eps) / {GRID.tail!r})), 6) AS closed, min(t + (eps * lam + s) / {GRID.tail!r}) - any_value(least(96.0, cvar + greatest(0.0, eps) / {GRID.tail!r})) < 1e-6 AS within FROM ss JOIN ee USING (transition) GROUP BY transition, label", PROGRAM)
def _(spark, d):
    x = C.program_checks(_grid_pmf(spark, d), metrics(spark, d, GRID), GRID)
    return x.select("transition", "label", "program", "closed", (F.col("error") < 1e-6).alias("within"))


_GRIDT = repr(GRID.tail)
WORST = PROGRAM | {
    "wr": "SELECT transition, cvar, epsilon_sat, unnest(['zero', 'half', 'below', 'threshold', 'double']) AS label, unnest([0.0e0, 0.5e0, 0.99e0, 1.0e0, 2.0e0]) * epsilon_sat AS eps FROM met",
    "wt": "SELECT unnest(list_distinct([least(k * 6.0e0, 96.0e0) FOR k IN range(17)])) AS t",
    "wm": "SELECT transition, label, t, y, eps, p * greatest(0.0, y - t) AS base, CASE WHEN y < 96.0 THEN (greatest(0.0, 96.0 - t) - greatest(0.0, y - t)) / (96.0 - y) ELSE 0.0 END AS rate, p * (96.0 - y) AS spend FROM wr JOIN pp USING (transition), wt",
    "wg": "SELECT *, rate * greatest(0.0, least(spend, eps - (sum(spend) OVER (PARTITION BY transition, label, t ORDER BY rate DESC, y ROWS UNBOUNDED PRECEDING) - spend))) AS got FROM wm",
    "wv": f"SELECT transition, label, min(v) AS greedy FROM (SELECT transition, label, t, t + (sum(base) + sum(got)) / {_GRIDT} AS v FROM wg GROUP BY transition, label, t) GROUP BY ALL",
    "wd": f"SELECT transition, label, min(t + (eps * lam + s) / {_GRIDT}) AS dual FROM ss JOIN wr USING (transition) GROUP BY ALL",
}


@query("worst_case_programs", f"SELECT transition, label, round(greedy, 6) AS \"primal\", round(greedy, 6) AS greedy, round(dual, 6) AS dual, round(least(96.0, cvar + eps / {_GRIDT}), 6) AS closed, true AS agree FROM wr JOIN wv USING (transition, label) JOIN wd USING (transition, label) WHERE label <> 'below'", WORST)
def _(spark, d):
    x = P.worst_cases(_grid_pmf(spark, d), metrics(spark, d, GRID), GRID)
    each = F.array("primal", "greedy", "dual", "closed")
    return x.withColumn("agree", F.array_max(each) - F.array_min(each) <= 1e-7)


@query("threshold_checks", f"SELECT transition, label, round(eps, 6) AS eps, round(greedy, 6) AS worst, greedy >= 96.0 - 1e-6 AS reached, CASE label WHEN 'zero' THEN abs(greedy - cvar) <= 1e-6 WHEN 'threshold' THEN greedy >= 96.0 - 1e-6 ELSE epsilon_sat <= 1e-6 OR greedy < 96.0 - 1e-6 END AS passed FROM wr JOIN wv USING (transition, label) WHERE label IN ('zero', 'below', 'threshold')", WORST)
def _(spark, d):
    return P.threshold_checks(_grid_pmf(spark, d), metrics(spark, d, GRID), GRID)


@query("hinge_cvar", f"SELECT transition, round(min(t + e / {GRID.tail!r}), 6) AS cvar FROM (SELECT a.transition, a.y AS t, sum(b.p * greatest(0.0, b.y - a.y)) AS e FROM pp a JOIN pp b USING (transition) GROUP BY ALL) GROUP BY 1", PROGRAM)
def _(spark, d):
    return C.hinge_cvar(_grid_pmf(spark, d), GRID.tail)


def _beta_sql() -> str:
    def cdf(e: str, a: float, b: float) -> str:
        return e if b == 1.0 else f"pow({e}, {a!r}) * (1 + {a!r} * (1 - {e}))" if b == 2.0 else f"1 - pow(1 - {e}, {b!r}) * (1 + {b!r} * {e})"

    parts = [f"SELECT '{n}' AS distribution, k / 2000.0e0 AS y, {1 - m!r} * (({cdf('hi', a, b)}) - ({cdf('lo', a, b)})) + CASE WHEN k = 2000 THEN {m!r} ELSE 0.0 END AS w FROM g" for n, a, b, m in C.BETAS]
    alphas, ratios = ", ".join(f"({a!r}::DOUBLE, {1 - a!r}::DOUBLE)" for a in C.ALPHAS), ", ".join(f"({x!r}::DOUBLE)" for x in C.RATIOS)
    return (
        "WITH g AS (SELECT k, greatest(0.0e0, (k - 0.5e0) / 2000) AS lo, least(1.0e0, (k + 0.5e0) / 2000) AS hi FROM range(2001) AS r(k)), pm AS (" + " UNION ALL ".join(parts) + "), "
        f"al AS (SELECT * FROM (VALUES {alphas}) AS v(alpha, tail)), ra AS (SELECT * FROM (VALUES {ratios}) AS v(ratio)), "
        "cu AS (SELECT *, sum(w) OVER (PARTITION BY distribution ORDER BY y DESC) AS cw, sum(w) OVER (PARTITION BY distribution) AS n FROM pm), "
        "cv AS (SELECT distribution, alpha, tail, sum(y * greatest(0.0, least(w, n * tail - (cw - w)))) / (any_value(n) * tail) AS cvar FROM cu, al GROUP BY distribution, alpha, tail), "
        "sa AS (SELECT *, greatest(0.0, tail * (1 - cvar)) AS epsilon_sat FROM cv), "
        "wo AS (SELECT *, CASE WHEN epsilon_sat <= 1e-6 THEN 1.0 ELSE least(1.0, cvar + ratio * epsilon_sat / tail) END AS worst FROM sa, ra) "
        "SELECT distribution, round(alpha, 6) AS alpha, round(ratio, 6) AS ratio, round(epsilon_sat, 6) AS epsilon_sat, round(cvar, 6) AS cvar, round(worst, 6) AS worst, abs(worst - 1) <= 1e-5 AS at_cap FROM wo"
    )


@query("beta_study")
def _(spark, d):
    return C.beta_study(spark)


ORACLES["beta_study"] = _beta_sql()

BOUND = CTES | {
    "pts": "SELECT DISTINCT epsilon_sat / epsilon AS multiplier FROM met WHERE epsilon > 0 AND epsilon_sat / epsilon BETWEEN 0 AND 2 UNION SELECT unnest([0.0e0, 2.0e0])",
    "bs": f"SELECT multiplier, transition, frequency * least(96.0, cvar + multiplier * epsilon / {PROFILE.tail!r}) AS score, cvar + multiplier * epsilon / {PROFILE.tail!r} >= 96.0 - 1e-7 AS filled FROM met, pts",
    "br": "SELECT *, row_number() OVER (PARTITION BY multiplier ORDER BY score DESC, transition) AS rk FROM bs",
    "bm": "SELECT s.K, multiplier, score, filled, rk <= s.K AS picked, EXISTS (SELECT 1 FROM port p WHERE p.method = 'Original DRO' AND p.K = s.K AND p.transition = br.transition) AS inside FROM br, sizes s",
}


@query("boundary_audit", "SELECT CAST(K AS BIGINT) AS K, round(multiplier, 6) AS multiplier, count_if(filled) AS saturated_candidates, round(count_if(picked AND inside) / count_if(picked OR inside), 6) AS jaccard_primary, round(min(CASE WHEN inside THEN score END) - max(CASE WHEN NOT inside THEN score END), 6) AS margin, count_if(picked AND inside) = count_if(picked OR inside) AS same_membership FROM bm GROUP BY bm.K, bm.multiplier", BOUND)
def _(spark, d):
    m = metrics(spark, d)
    return C.boundary_audit(m, M.portfolios(m, PROFILE), PROFILE)


KAPPA = CTES | {"kd": f"SELECT kappa, transition, risk, frequency, least(96.0, cvar + greatest(0.0, CASE WHEN epsilon_sat <= 1e-8 THEN 0.0 ELSE least(epsilon, kappa * epsilon_sat) END) / {PROFILE.tail!r}) AS sa_risk FROM met, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) AS v(kappa)"}


@query("kappa_diagnostics", "SELECT kappa, transition, round(sa_risk, 6) AS sa_risk, round(frequency * sa_risk, 6) AS score, row_number() OVER (PARTITION BY kappa ORDER BY frequency * sa_risk DESC, transition) AS rank, sa_risk < risk - 1e-8 AS active FROM kd", KAPPA)
def _(spark, d):
    return C.kappa_diagnostics(metrics(spark, d), PROFILE)


@query("clipping_diagnostics", "SELECT kappa, count_if(sa_risk < risk - 1e-8) AS active_clipping, count_if(sa_risk >= 96.0 - 1e-7) AS sa_saturated FROM kd GROUP BY 1", KAPPA)
def _(spark, d):
    return C.clipping(C.kappa_diagnostics(metrics(spark, d), PROFILE), PROFILE)


@query("grid_comparison", "SELECT count(*) AS candidates, round(max(abs(a.risk - b.risk)), 6) AS risk_change, round(max(abs(a.cvar - b.cvar)), 6) AS cvar_change, round(max(abs(a.epsilon_sat - b.epsilon_sat)), 6) AS threshold_change, count_if(a.saturated <> b.saturated) AS reclassified FROM gma a JOIN gmb b USING (transition)", {"gma": build(CTES, "SELECT * FROM met"), "gmb": build(GRIDS, "SELECT * FROM met")})
def _(spark, d):
    return C.compared(metrics(spark, d), metrics(spark, d, GRID))


EVERY = W.settings(PROFILE, blocks=(1, 7), least=(5, 20), grids=(6.0, 12.0), alpha=0.9, cap=128.0, followup=5, lags=(3, 6))


def _setting_ctes(s: W.Setting) -> dict[str, str]:
    """Metrics, portfolios and outcomes of a setting: of its own candidates with a lag, else of `prim`."""
    own = event_ctes(s.cfg.but(decision=s.end, holdout_end=s.holdout_end))
    decision = f"TIMESTAMP '{s.cfg.decision}'"
    own["hist"] = f"SELECT * FROM obs WHERE origin >= TIMESTAMP '{s.cfg.start}' AND origin < TIMESTAMP '{s.end}' AND destination IS NOT NULL AND destination < {decision}"
    own["held"] = f"SELECT * FROM obs WHERE origin >= {decision} AND origin < TIMESTAMP '{s.holdout_end}' AND destination IS NOT NULL"
    if not s.lag:
        own["met"] = own["met"].replace("WHERE strict_eligibility", "WHERE transition IN (SELECT transition FROM prim) AND epsilon IS NOT NULL")
    return EVAL | own


_DIAGNOSTIC = "SELECT count(*) AS candidates, count_if(empirically_saturated) AS empirical, count_if(saturated AND NOT empirically_saturated) AS induced, count_if(saturated) AS total, quantile_cont(rho, 0.5) AS median_rho, quantile_cont(epsilon, 0.5) AS median_epsilon, count_if(strict_eligibility) AS strict_eligible_candidates FROM met"


def _sweep_ctes(every: list[W.Setting]) -> dict[str, str]:
    first = event_ctes(every[0].cfg)
    out = {"prim": build(first, "SELECT transition FROM met"), "psets": build(first, "SELECT method, K, members FROM sets")}
    evaluation = _evaluation_sql("eligible", True).replace("SELECT method, CAST(K AS BIGINT) AS K", "SELECT chosen.method, CAST(chosen.K AS BIGINT) AS K, chosen.members AS members")
    for k, s in enumerate(every):
        own = _setting_ctes(s)
        out |= {f"se{k}": build(own, evaluation), f"sd{k}": build(own, _DIAGNOSTIC), f"sp{k}": build(own, "SELECT method, K, rank, transition FROM port")}
    return out


SWEEP = _sweep_ctes(EVERY)
_COLUMNS = [x for t in V.TARGETS for x in (f"{t}_share_pct", f"{t}_oracle_eligible_pct", f"{t}_oracle_global_pct", f"{t}_regret_pp", f"jaccard_{t}_oracle", f"candidate_{t}_coverage_pct")]


def _sensitivity_sql(every: list[W.Setting]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{s.name}' AS configuration, e.method, e.K, {', '.join('e.' + c for c in _COLUMNS)}, holdout_transitions, holdout_observations, candidates, empirical, induced, total, round(median_rho, 6) AS median_rho, round(median_epsilon, 6) AS median_epsilon, strict_eligible_candidates, round(len(list_intersect(e.members, p.members)) / len(list_distinct(e.members || p.members)), 6) AS jaccard_primary FROM se{k} e JOIN psets p ON p.method = e.method AND p.K = e.K, sd{k}"
        for k, s in enumerate(every)
    )


@query("sensitivity_sweep", _sensitivity_sql(EVERY), SWEEP)
def _(spark, d):
    return W.sensitivity(obs(spark, d), EVERY)


EXPLORED = W.explored(PROFILE, caps=(96.0, 128.0), alphas=(0.95, 0.9), grids=(12.0, 6.0))


@query("exploratory_sensitivity", _sensitivity_sql(EXPLORED), _sweep_ctes(EXPLORED))
def _(spark, d):
    return W.sensitivity(obs(spark, d), EXPLORED)


@query("sensitivity_risks", " UNION ALL ".join(f"SELECT '{s.name}' AS configuration, transition, {r('cvar', 'epsilon', 'epsilon_sat', 'rho', 'risk', 'sa_risk')}, saturated FROM sr{k}" for k, s in enumerate(EVERY)), {"prim": SWEEP["prim"]} | {f"sr{k}": build(_setting_ctes(s), "SELECT * FROM met") for k, s in enumerate(EVERY)})
def _(spark, d):
    return W.swept(obs(spark, d), EVERY)[0].select("configuration", "transition", "cvar", "epsilon", "epsilon_sat", "rho", "risk", "sa_risk", "saturated")


FROZEN = CTES | SWEEP | {
    "fp": " UNION ALL ".join(f"SELECT '{s.name}' AS configuration, method, K, rank, transition FROM sp{k}" for k, s in enumerate(EVERY)),
    "fo": "SELECT configuration, method, K, count(outc.n) AS covered, coalesce(sum(mean_burden), 0.0) AS mean_sum, coalesce(sum(tail_burden), 0.0) AS tail_sum, list(transition ORDER BY rank) AS members FROM fp LEFT JOIN outc USING (transition) GROUP BY configuration, method, K",
    "fb": "SELECT K, sum(CASE WHEN target = 'mean' THEN burden END) AS mean_best, sum(CASE WHEN target = 'tail' THEN burden END) AS tail_best, list(transition) FILTER (target = 'mean') AS mean_set, list(transition) FILTER (target = 'tail') AS tail_set FROM orac_g GROUP BY 1",
    "fa": "SELECT sum(mean_burden) AS all_mean, sum(tail_burden) AS all_tail FROM outc",
}


def _frozen_sql() -> str:
    cols = [x for t in V.TARGETS for x in (f"round(100 * {t}_sum / all_{t}, 6) AS {t}_share_pct", f"round(100 * ({t}_best - {t}_sum) / all_{t}, 6) AS {t}_regret_pp", f"round(len(list_intersect(o.members, {t}_set)) / len(list_distinct(o.members || {t}_set)), 6) AS jaccard_{t}_oracle")]
    same = "list_sort(o.members) = list_sort(p.members)"
    return f"SELECT o.configuration, o.method, CAST(o.K AS BIGINT) AS K, o.covered, {', '.join(cols)}, round(len(list_intersect(o.members, p.members)) / len(list_distinct(o.members || p.members)), 6) AS jaccard_primary, {same} AS same_set, o.members = p.members AS same_order, {same} AND o.members <> p.members AS differs_only_in_order FROM fo o JOIN fb USING (K) JOIN (SELECT method, K, members FROM fo WHERE configuration = 'primary') p ON p.method = o.method AND p.K = o.K, fa"


@query("frozen_sensitivity", _frozen_sql(), FROZEN)
def _(spark, d):
    metrics_, outcomes = W.swept(obs(spark, d), EVERY)
    ports = M.portfolios(metrics_, PROFILE, ["configuration"])
    return W.frozen(ports, outcomes.where("configuration = 'primary'").drop("configuration"), PROFILE)


@query("portfolio_digest", "SELECT sha256(string_agg(l, chr(10) ORDER BY l)) AS digest FROM (SELECT method || '|K=' || K || '|' || rank || '|' || transition AS l FROM port)")
def _(spark, d):
    return C.manifest_digest(M.portfolios(metrics(spark, d), PROFILE))


@query("reproduction_gate", "SELECT metric, count(*) AS rows, round(max(abs(a - b)), 6) AS worst, bool_and(a IS NOT DISTINCT FROM b OR coalesce(abs(a - b) <= 1e-6, false)) AS passed FROM (SELECT unnest(['cvar', 'epsilon', 'risk']) AS metric, unnest([x.cvar, x.epsilon, x.risk]) AS a, unnest([z.cvar, z.epsilon, z.risk]) AS b FROM gma x FULL JOIN gmb z USING (transition)) GROUP BY 1", {"gma": build(CTES, "SELECT * FROM met"), "gmb": build(event_ctes(PROFILE.but(start=datetime(2024, 1, 2))), "SELECT * FROM met")})
def _(spark, d):
    later = PROFILE.but(start=datetime(2024, 1, 2))
    return C.reproduction(metrics(spark, d), M.fit(E.history(obs(spark, d), later), later), "transition", ["cvar", "epsilon", "risk"])


@query("drift_candidates", "SELECT transition, round(share * (1 + ln(1 + w)), 5) AS score FROM (SELECT transition, 100.0 * sum(y) / sum(sum(y)) OVER () AS share FROM side GROUP BY transition) JOIN (" + W1.replace("round(sum(abs(c0 / n0 - c1 / n1) * dx), 6) AS w1", "sum(abs(c0 / n0 - c1 / n1) * dx) AS w") + ") USING (transition)", SIDE)
def _(spark, d):
    x = _sides(spark, d)
    w = T.wasserstein(x.groupBy("transition", "s", "y").agg(F.count("*").alias("w")), ["transition"], "s", PROFILE.cap)
    g = x.groupBy("transition").agg(F.sum("y").alias("b"))
    share = g.crossJoin(F.broadcast(g.agg(F.sum("b").alias("all")))).select("transition", (100.0 * F.col("b") / F.col("all")).alias("share"))
    return C.drift_score(share.join(w, "transition")).select("transition", F.round("score", 5).alias("score"))
