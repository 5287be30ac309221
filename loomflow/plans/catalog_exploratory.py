"""Registered queries of the audits and the exploratory operators, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loomflow.config import SCORES
from loomflow.functions import scalars as S
from loomflow.functions.sliced import Calendar
from loomflow.operators import audit as A
from loomflow.plans import checks as C
from loomflow.plans import exploratory as X
from loomflow.plans import model as M
from loomflow.plans.catalog import CTES, ORDERS, PROFILE, TALKS, events, held, hist, metrics, obs, orders, query, r, talks, tbl
from loomflow.plans import evaluate as V
from loomflow.plans.sql import build, event_ctes

_PORT = "SELECT method, CAST(K AS BIGINT) AS K, rank, transition FROM port"


@query("case_maturity", f"SELECT month, cases, {r('mean_cycle_hours', 'max_cycle_hours', 'min_followup_days', 'max_followup_days')}, mature, round(mature / cases, 6) AS mature_share FROM (SELECT strftime(f, '%Y-%m') AS month, count(*) AS cases, avg(c) AS mean_cycle_hours, max(c) AS max_cycle_hours, min(d) AS min_followup_days, max(d) AS max_followup_days, count_if(d >= 400) AS mature FROM (SELECT min(ts) AS f, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS c, (epoch_us(TIMESTAMP '2002-01-01') - epoch_us(min(ts))) / 3.6e9 / 24 AS d FROM olog GROUP BY case_id) GROUP BY 1)", ORDERS)
def _(spark, d):
    return A.maturity_by_month(orders(spark, d), datetime(2002, 1, 1), 400)


@query("case_anomalies", "SELECT * FROM (SELECT case_id, count(*) AS events, count_if(NOT year(ts) BETWEEN 1996 AND 2000) AS non_core, count_if(year(ts) IN (1995, 2001)) AS boundary, count_if(NOT year(ts) BETWEEN 1995 AND 2001) AS extreme FROM olog GROUP BY 1) WHERE non_core > 0", ORDERS)
def _(spark, d):
    return A.anomalies(orders(spark, d), (1996, 2000), (1995, 2001))


@query("first_cases", "SELECT case_id, ord, activity FROM olog WHERE case_id IN (SELECT case_id FROM olog GROUP BY 1 ORDER BY min(ts), case_id LIMIT 250)", ORDERS)
def _(spark, d):
    return A.first_cases(orders(spark, d), 250).select("case_id", "ord", "activity")


@query("gap_sample", "SELECT case_id, CAST(origin AS VARCHAR) AS origin, round(delay, 6) AS delay FROM obs WHERE delay IS NOT NULL ORDER BY md5(concat_ws(':', case_id, CAST(epoch_us(origin) AS VARCHAR), transition)), case_id LIMIT 2000")
def _(spark, d):
    o = obs(spark, d).where("delay is not null").withColumn("us", F.unix_micros(F.col("origin").cast("timestamp")))
    return A.sampled(o, ["case_id", "us", "transition"], 2000).select("case_id", F.col("origin").cast("string").alias("origin"), "delay")


@query("case_resource_kinds", "SELECT case_id, count_if(k = 'human') AS human_events, count_if(k = 'batch') AS batch_events, count_if(k = 'none') AS none_events, count_if(k = 'other') AS other_events, count(DISTINCT CASE WHEN k <> 'none' THEN activity END) AS resources FROM (SELECT *, CASE WHEN lower(trim(activity)) LIKE 'user%' THEN 'human' WHEN lower(trim(activity)) LIKE 'batch%' THEN 'batch' WHEN activity IS NULL OR upper(trim(activity)) IN ('NONE', 'NULL', 'NA', '') THEN 'none' ELSE 'other' END AS k FROM tlog) GROUP BY 1", TALKS)
def _(spark, d):
    return A.kinds_by_case(talks(spark, d), F.col("activity"))


@query("feasibility", "SELECT count_if(activity = 'user') > 0 AND count_if(activity = 'assistant') > 0 AS service_times, count(activity) > 0 AS resources, (SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM tlog GROUP BY case_id)) AS gaps FROM tlog", TALKS)
def _(spark, d):
    return A.feasibility(talks(spark, d), F.col("activity"), F.col("activity"), "user", "assistant")


@query("first_seen", "SELECT activity, min(ord) AS first_ord, count(*) AS n FROM log GROUP BY 1")
def _(spark, d):
    return A.first_seen(events(spark, d))


@query("first_of_case", "SELECT case_id, ord, activity FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, ord) AS k FROM olog) WHERE k = 1", ORDERS)
def _(spark, d):
    return A.first_of_group(orders(spark, d), ["case_id"], ["ts", "ord"], ["ord", "activity"])


@query("counts_on_base", "SELECT b.transition, coalesce(n, 0) AS n FROM (SELECT DISTINCT transition FROM obs WHERE destination IS NOT NULL) b LEFT JOIN (SELECT transition, count(*) AS n FROM held WHERE delay > 48 GROUP BY 1) USING (transition)")
def _(spark, d):
    base = obs(spark, d).where("destination is not null").select("transition").distinct()
    return A.on_base(base, held(spark, d).where("delay > 48").groupBy("transition").agg(F.count("*").alias("n")), ["transition"], ["n"])


@query("window_labels", "SELECT CASE WHEN strftime(o_orderdate, '%Y-%m') IN ('1996-01', '1996-02') THEN 'nominal' ELSE 'holdout' END AS label, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    label = X.labelled(S.month_label(F.col("o_orderdate")), ("1996-01", "1996-02"))
    return tbl(spark, d, "orders").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("universe_metrics", "SELECT transition, n, round(n / t, 6) AS frequency, round(n / t * mean, 6) AS mean_score, round(n / t * cvar, 6) AS tail_score FROM outc, (SELECT sum(n) AS t FROM outc)")
def _(spark, d):
    return X.universe(V.outcomes(held(spark, d), PROFILE))


@query("floor_cvar", f"SELECT transition, {r('cvar')} FROM cv")
def _(spark, d):
    return X.floor_cvar(M.pooled(M.histogram(hist(spark, d), PROFILE), ["transition"]), ["transition"], PROFILE.tail, PROFILE.cap)


GRID = PROFILE.but(grid=4.0)
_GRIDDED = CTES | {"g": "SELECT transition, least(greatest(round_even(least(delay, 96.0) / 4.0, 0) * 4.0, 0.0), 96.0) AS y, count(*) AS w FROM hist GROUP BY ALL", "gt": "SELECT transition, sum(w) AS n, sum(CASE WHEN y >= 96.0 THEN w ELSE 0 END) / sum(w) AS m_cap FROM g GROUP BY 1"}


@query("grid_threshold", f"SELECT transition, round(any_value(m_cap), 6) AS m_cap, round(any_value(delta), 6) AS delta, round(sum(CASE WHEN y < 96.0 THEN greatest(0.0, least(p, delta - (cp - p))) * (96.0 - y) ELSE 0 END), 6) AS cost FROM (SELECT transition, y, m_cap, greatest(0.0, {PROFILE.tail!r} - m_cap) AS delta, w / n AS p, sum(CASE WHEN y < 96.0 THEN w ELSE 0 END) OVER (PARTITION BY transition ORDER BY y DESC) / n AS cp FROM g JOIN gt USING (transition)) GROUP BY 1", _GRIDDED)
def _(spark, d):
    h = M.histogram(hist(spark, d), GRID)
    return X.grid_threshold(M.pooled(h, ["transition"]), ["transition"], GRID.cap, GRID.tail)


@query("radius_table", "SELECT transition, count(*) AS blocks, min(n_b) AS least_n, max(n_b) AS most_n, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS q75, round(quantile_cont(d, 0.9), 6) AS q90, round(max(d), 6) AS most FROM dist JOIN valid USING (transition, block) GROUP BY 1")
def _(spark, d):
    return X.radius_table(hist(spark, d), PROFILE)


@query("exploratory_eligibility", f"SELECT transition, CAST(sum(n_b) AS BIGINT) AS n, count_if(n_b >= {PROFILE.min_block}) AS full_blocks FROM perblock GROUP BY 1 HAVING sum(n_b) >= {PROFILE.min_obs} AND count_if(n_b >= {PROFILE.min_block}) >= 6")
def _(spark, d):
    return X.explorable(hist(spark, d), PROFILE, 6)


@query("representatives", "SELECT 'top_score' AS pick, (SELECT transition FROM met ORDER BY dro_score DESC, transition LIMIT 1) AS transition UNION ALL SELECT 'median_ratio', (SELECT transition FROM met, (SELECT quantile_cont(rho, 0.5) AS m FROM met) WHERE rho IS NOT NULL ORDER BY abs(rho - m), transition LIMIT 1) UNION ALL SELECT 'largest_ratio', (SELECT transition FROM met WHERE rho IS NOT NULL ORDER BY rho DESC, transition LIMIT 1)")
def _(spark, d):
    return X.representatives(metrics(spark, d))


@query("portfolio_overlap_counts", "SELECT a.K::BIGINT AS K, a.method AS left, b.method AS right, len(list_intersect(a.members, b.members)) AS shared, round(len(list_intersect(a.members, b.members)) / a.K, 6) AS share FROM sets a JOIN sets b ON a.K = b.K AND a.method < b.method")
def _(spark, d):
    return X.overlaps(M.portfolios(metrics(spark, d), PROFILE))


@query("portfolio_saturation", "SELECT method, CAST(K AS BIGINT) AS K, count(*) AS members, count_if(saturated) AS saturated, count_if(empirically_saturated) AS empirical, round(count_if(saturated) / count(*), 6) AS share, round(quantile_cont(rho, 0.5), 6) AS median_rho, round(max(rho), 6) AS max_rho FROM port JOIN met USING (transition) GROUP BY method, K")
def _(spark, d):
    m = metrics(spark, d)
    return X.portfolio_saturation(M.portfolios(m, PROFILE), m)


@query("saturation_mismatch", "SELECT transition, saturated, coalesce(rho >= 1, false) AS by_ratio, CASE WHEN empirically_saturated THEN 'empirical tail at the cap' WHEN saturated AND NOT coalesce(rho >= 1, false) THEN 'risk within tolerance of the cap' WHEN NOT saturated AND coalesce(rho >= 1, false) THEN 'ratio reached, risk below the cap' ELSE 'agree' END AS reason FROM met")
def _(spark, d):
    return X.mismatch(metrics(spark, d))


@query("selection_strings", "SELECT 'primary|' || method || '|K=' || CAST(K AS VARCHAR) AS key, string_agg(transition, ' || ' ORDER BY rank) AS selection FROM port GROUP BY method, K")
def _(spark, d):
    return X.selections(M.portfolios(metrics(spark, d), PROFILE), "primary")


@query("manifest_selections", "SELECT 'primary' AS label, method, CAST(K AS BIGINT) AS K, rank, transition FROM port")
def _(spark, d):
    return X.parsed(X.selections(M.portfolios(metrics(spark, d), PROFILE), "primary"))


_OTHER = PROFILE.but(alpha=0.9)
_FITS = {"pa": build(CTES, "SELECT method, K, rank, transition FROM port"), "pb": build(event_ctes(_OTHER), "SELECT method, K, rank, transition FROM port"), "ma": build(CTES, "SELECT * FROM met"), "mb": build(event_ctes(_OTHER), "SELECT * FROM met")}


@query("manifest_agreement", "SELECT count(a.method) AS rows, count_if(b.method IS NULL) AS missing, count_if(a.method IS NULL) AS added, count_if(a.method IS NOT NULL AND b.method IS NOT NULL AND a.transition <> b.transition) AS changed FROM pa a FULL JOIN pb b ON a.method = b.method AND a.K = b.K AND a.rank = b.rank", _FITS)
def _(spark, d):
    frozen = X.parsed(X.selections(M.portfolios(metrics(spark, d), PROFILE), "primary"))
    return X.agreement(frozen, M.portfolios(metrics(spark, d, _OTHER), _OTHER), ["method", "K", "rank"], ["transition"])


_DIFFS = ", ".join(f"round(a.{c}, 6) AS before_{c}, round(b.{c}, 6) AS after_{c}, round(b.{c} - a.{c}, 6) + 0.0 AS {c}_difference" if c != "n" else "a.n AS before_n, b.n AS after_n, b.n - a.n AS n_difference" for c in X.COMPARED)


@query("before_and_after", f"SELECT transition, {_DIFFS}, a.empirically_saturated AS before_empirically_saturated, b.empirically_saturated AS after_empirically_saturated, a.saturated AS before_saturated, b.saturated AS after_saturated, a.saturated <> b.saturated AS classification_changed FROM ma a JOIN mb b USING (transition)", _FITS)
def _(spark, d):
    return X.before_and_after(metrics(spark, d), metrics(spark, d, _OTHER))


_PAIRS = " UNION ALL ".join([f"SELECT 'scores' AS scope, '' AS method, '{x}' AS l, '{y}' AS r, transition, {x} AS x, {y} AS y FROM met" for x, y in X.SCORE_PAIRS] + [f"SELECT 'holdout', '{m}', '{SCORES[m]}', '{t}_burden', transition, {SCORES[m]}, {t}_burden FROM met JOIN outc USING (transition)" for m in PROFILE.methods for t in ("mean", "tail")])
_CORR = CTES | {
    "cpairs": _PAIRS,
    "cranks": "SELECT *, rank() OVER (PARTITION BY scope, method, l, r ORDER BY x) + (count(*) OVER (PARTITION BY scope, method, l, r, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY scope, method, l, r ORDER BY y) + (count(*) OVER (PARTITION BY scope, method, l, r, y) - 1) / 2.0 AS ry FROM cpairs",
    "crho": "SELECT scope, method, l, r, 'Spearman' AS kind, corr(rx, ry) AS value, count(*) AS n FROM cranks GROUP BY scope, method, l, r",
    "ctau": "SELECT a.scope, a.method, a.l, a.r, 'Kendall' AS kind, sum(sign(a.x - b.x) * sign(a.y - b.y)) / nullif(sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 0) AS value FROM cpairs a JOIN cpairs b ON a.scope = b.scope AND a.method = b.method AND a.l = b.l AND a.r = b.r AND a.transition < b.transition GROUP BY a.scope, a.method, a.l, a.r",
}


@query("correlations", "SELECT scope, method, l AS \"left\", r AS \"right\", kind, round(value, 6) AS value, n FROM (SELECT * FROM crho UNION ALL SELECT t.scope, t.method, t.l, t.r, t.kind, t.value, c.n FROM ctau t JOIN crho c ON t.scope = c.scope AND t.method = c.method AND t.l = c.l AND t.r = c.r)", _CORR)
def _(spark, d):
    return X.correlations(metrics(spark, d), V.outcomes(held(spark, d), PROFILE), PROFILE)


_WEEKS = Calendar(2, 1000, PROFILE.seed + 5).weights
_WEEKLY = CTES | {
    "ww": f"SELECT * FROM (VALUES {', '.join(str((rep, k, int(w))) for rep, row in enumerate(_WEEKS) for k, w in enumerate(row) if w)}) AS v(rep, week, weight)",
    "wb": "SELECT CAST(floor((epoch_us(origin) - epoch_us(TIMESTAMP '2024-01-22')) / 604800000000.0) AS BIGINT) AS week, transition, sum(greatest(0.0, least(delay, 96.0))) AS burden FROM held GROUP BY ALL",
    "wtot": "SELECT week, sum(burden) AS total FROM wb GROUP BY 1",
    "wch": "SELECT week, method, sum(burden) AS burden FROM wb JOIN port USING (transition) WHERE K = 5 GROUP BY ALL",
    "wsh": "SELECT rep, m.method, sum(coalesce(burden, 0) * weight) / sum(total * weight) AS share FROM wtot t JOIN ww USING (week) CROSS JOIN (SELECT DISTINCT method FROM port) m LEFT JOIN wch c ON c.week = t.week AND c.method = m.method GROUP BY rep, m.method",
    "wdf": "SELECT b.method AS baseline, 100 * a.share AS own, 100 * b.share AS other, 100 * (a.share - b.share) AS d FROM wsh a JOIN wsh b USING (rep) WHERE a.method = 'Original DRO' AND b.method <> 'Original DRO'",
}


@query("weekly_share_bootstrap", "SELECT baseline, round(avg(own), 6) AS method_share, round(avg(other), 6) AS baseline_share, round(avg(d), 6) + 0.0 AS difference, round(quantile_cont(d, 0.5), 6) + 0.0 AS median, round(quantile_cont(d, 0.025), 6) + 0.0 AS lower, round(quantile_cont(d, 0.975), 6) + 0.0 AS upper, round(quantile_cont(d, 0.025), 9) <= 0 AND round(quantile_cont(d, 0.975), 9) >= 0 AS includes_zero FROM wdf GROUP BY 1", _WEEKLY)
def _(spark, d):
    weights = spark.createDataFrame([(rep, k, int(w)) for rep, row in enumerate(_WEEKS.tolist()) for k, w in enumerate(row) if w], "rep int, week int, weight int")
    return X.weekly_shares(held(spark, d), M.portfolios(metrics(spark, d), PROFILE), weights, PROFILE, 5, "Original DRO")


@query("reproduction_gate_of_changes", "SELECT metric, count(*) AS rows, round(max(abs(a - b)), 6) AS worst, bool_and(b IS NOT NULL AND abs(a - b) <= 1e-6) AS passed FROM (SELECT unnest(['cvar', 'epsilon', 'risk']) AS metric, unnest([cvar, epsilon, risk]) AS a, unnest([cvar, CASE WHEN transition = last THEN epsilon + 0.5 ELSE epsilon END, CASE WHEN transition = last THEN risk + 1e-8 ELSE risk END]) AS b FROM met, (SELECT max(transition) AS last FROM met)) GROUP BY 1")
def _(spark, d):
    m = metrics(spark, d)
    changed = F.col("transition") == F.col("last")
    other = m.crossJoin(m.agg(F.max("transition").alias("last"))).withColumn("epsilon", F.col("epsilon") + F.when(changed, 0.5).otherwise(0.0)).withColumn("risk", F.col("risk") + F.when(changed, 1e-8).otherwise(0.0))
    return C.reproduction(m, other, "transition", ["cvar", "epsilon", "risk"])
