"""Independent checks of the closed forms, and sensitivity of the portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.functions import stats as T
from loomflow.plans import model as M

# Fixed values of the synthetic study.
BETAS = (("Beta(1,1)", 1.0, 1.0, 0.0), ("Beta(2,5)", 2.0, 5.0, 0.0), ("Beta(5,2)", 5.0, 2.0, 0.0), ("Beta(0.7,2)", 0.7, 2.0, 0.0), ("0.02 mass at 1 + 0.98 Beta(2,5)", 2.0, 5.0, 0.02), ("0.04 mass at 1 + 0.96 Beta(2,5)", 2.0, 5.0, 0.04))
RATIOS = (0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0, 1.1, 1.25, 1.5)
ALPHAS = (0.9, 0.95, 0.99)


def dual_risk(pmf: DataFrame, eps: DataFrame, cap: float, tail: float) -> DataFrame:
    """(transition, label, risk): the dual linear program at its vertices, over supports of a bounded grid.

    The optimum lies where t is 0, the cap or a support point, and lambda 0, 1 or
    (cap - t) / (cap - x). `pmf` is (transition, y, w), `eps` is (transition, label, eps).
    """
    p = pmf.join(pmf.groupBy("transition").agg(F.sum("w").alias("n")), "transition").select("transition", "y", (F.col("w") / F.col("n")).alias("p"))
    t = p.select("transition", F.col("y").alias("t")).union(p.select("transition", F.explode(F.array(F.lit(0.0), F.lit(float(cap)))))).distinct()
    slopes = t.join(p.select("transition", F.col("y").alias("x")), "transition").where(F.col("x") < cap).select("transition", "t", ((cap - F.col("t")) / (cap - F.col("x"))).alias("lam"))
    corners = slopes.union(t.select("transition", "t", F.explode(F.array(F.lit(0.0), F.lit(1.0))))).distinct()
    slack = F.greatest(F.lit(0.0), F.col("y") - F.col("t"), F.lit(float(cap)) - F.col("t") - F.col("lam") * (F.lit(float(cap)) - F.col("y")))
    inner = corners.join(p, "transition").groupBy("transition", "t", "lam").agg(F.sum(F.col("p") * slack).alias("s"))
    value = F.col("t") + (F.col("eps") * F.col("lam") + F.col("s")) / F.lit(tail)
    return inner.join(eps, "transition").groupBy("transition", "label").agg(F.min(value).alias("risk"))


def hinge_cvar(pmf: DataFrame, tail: float) -> DataFrame:
    """(transition, cvar): least of t + E(y - t)+ / (1 - alpha) over thresholds of a bounded grid."""
    p = pmf.join(pmf.groupBy("transition").agg(F.sum("w").alias("n")), "transition").select("transition", "y", (F.col("w") / F.col("n")).alias("p"))
    t = p.select("transition", F.col("y").alias("t"))
    e = t.join(p, "transition").groupBy("transition", "t").agg(F.sum(F.col("p") * F.greatest(F.lit(0.0), F.col("y") - F.col("t"))).alias("e"))
    return e.groupBy("transition").agg(F.min(F.col("t") + F.col("e") / F.lit(tail)).alias("cvar"))


def program_checks(pmf: DataFrame, metrics: DataFrame, cfg: Config) -> DataFrame:
    """(transition, label, program, closed, error) at radii around each transition's own threshold."""
    s = F.col("epsilon_sat")
    labels = {"zero": F.lit(0.0), "half": 0.5 * s, "threshold": s, "double": 2 * s, "own": F.col("epsilon")}
    eps = metrics.select("transition", "cvar", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("eps")) for k, v in labels.items()])).alias("x")).select("transition", "cvar", "x.*")
    got = dual_risk(pmf, eps.select("transition", "label", "eps"), cfg.cap, cfg.tail)
    closed = T.robust(F.col("cvar"), F.col("eps"), cfg.cap, cfg.tail)
    return eps.join(got, ["transition", "label"]).select("transition", "label", F.col("risk").alias("program"), closed.alias("closed"), F.abs(F.col("risk") - closed).alias("error"))


def beta_study(spark: SparkSession, points: int = 2001) -> DataFrame:
    """(distribution, alpha, ratio, epsilon_sat, cvar, worst, at_cap) of beta distributions on a grid of [0, 1]."""
    x = F.col("k") / F.lit(float(points - 1))
    lo, hi = F.greatest(F.lit(0.0), (F.col("k") - 0.5) / (points - 1)), F.least(F.lit(1.0), (F.col("k") + 0.5) / (points - 1))

    def cdf(e, a: float, b: float):
        if b == 1.0:
            return e
        if b == 2.0:
            return F.pow(e, F.lit(a)) * (1 + a * (1 - e))
        return 1 - F.pow(1 - e, F.lit(b)) * (1 + b * e)  # a = 2

    grid = spark.range(points).withColumnRenamed("id", "k")
    parts = [grid.select(F.lit(n).alias("transition"), x.alias("y"), ((1 - m) * (cdf(hi, a, b) - cdf(lo, a, b)) + F.when(F.col("k") == points - 1, m).otherwise(0.0)).alias("w")) for n, a, b, m in BETAS]
    pmf = parts[0]
    for part in parts[1:]:
        pmf = pmf.union(part)
    out = []
    for alpha in ALPHAS:
        tail = 1 - alpha
        c = T.cvar(pmf, ["transition"], tail, 1.0).withColumn("epsilon_sat", T.saturation(F.col("cvar"), 1.0, tail))
        c = c.withColumn("ratio", F.explode(F.array(*[F.lit(v) for v in RATIOS])))
        worst = F.when(F.col("epsilon_sat") <= 1e-6, F.lit(1.0)).otherwise(T.robust(F.col("cvar"), F.col("ratio") * F.col("epsilon_sat"), 1.0, tail))
        out.append(c.select(F.col("transition").alias("distribution"), F.lit(alpha).alias("alpha"), "ratio", "epsilon_sat", "cvar", worst.alias("worst"), (F.abs(worst - 1) <= 1e-5).alias("at_cap")))
    return out[0].union(out[1]).union(out[2])


def boundary_audit(metrics: DataFrame, ports: DataFrame, cfg: Config, top: float = 2.0) -> DataFrame:
    """(K, multiplier, saturated_candidates, jaccard_primary, margin, same_membership) at each radius multiplier where a candidate saturates."""
    points = metrics.where(F.col("epsilon") > 0).select((F.col("epsilon_sat") / F.col("epsilon")).alias("multiplier")).where(F.col("multiplier").between(0, top))
    points = points.union(metrics.sparkSession.createDataFrame([(0.0,), (top,)], "multiplier double")).distinct()
    raw = F.col("cvar") + F.col("multiplier") * F.col("epsilon") / F.lit(cfg.tail)
    x = metrics.crossJoin(F.broadcast(points)).select("multiplier", "transition", (F.col("frequency") * F.least(F.lit(float(cfg.cap)), raw)).alias("score"), (raw >= cfg.cap - M.REACHED).alias("full"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("multiplier").orderBy(F.desc("score"), "transition")))
    fixed = ports.where(F.col("method") == "Original DRO").select("K", "transition", F.lit(True).alias("inside"))
    sizes = fixed.select("K").distinct()
    y = x.crossJoin(F.broadcast(sizes)).join(F.broadcast(fixed), ["K", "transition"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    picked = F.col("rank") <= F.col("K")
    g = y.groupBy("K", "multiplier").agg(
        F.count_if("full").alias("saturated_candidates"), F.count_if(picked & F.col("inside")).alias("both"), F.count_if(picked | F.col("inside")).alias("any"),
        (F.min(F.when(F.col("inside"), F.col("score"))) - F.max(F.when(~F.col("inside"), F.col("score")))).alias("margin"),
    )
    return g.select("K", "multiplier", "saturated_candidates", (F.col("both") / F.col("any")).alias("jaccard_primary"), "margin", (F.col("both") == F.col("any")).alias("same_membership"))


def kappa_diagnostics(metrics: DataFrame, cfg: Config, kappas: tuple[float, ...] = (0.5, 0.75, 0.9)) -> DataFrame:
    """(kappa, transition, sa_risk, score, rank, active): ranks under each clip of the radius."""
    x = metrics.withColumn("kappa", F.explode(F.array(*[F.lit(k) for k in kappas])))
    eps = F.when(F.col("epsilon_sat") <= M.SATURATED, F.lit(0.0)).otherwise(F.least("epsilon", F.col("kappa") * F.col("epsilon_sat")))
    x = x.withColumn("sa_risk", T.robust(F.col("cvar"), eps, cfg.cap, cfg.tail)).withColumn("score", F.col("frequency") * F.col("sa_risk"))
    rank = F.row_number().over(Window.partitionBy("kappa").orderBy(F.desc("score"), "transition"))
    return x.select("kappa", "transition", "sa_risk", "score", rank.alias("rank"), (F.col("sa_risk") < F.col("risk") - 1e-8).alias("active"))


def clipping(diagnostics: DataFrame, cfg: Config) -> DataFrame:
    return diagnostics.groupBy("kappa").agg(F.count_if("active").alias("active_clipping"), F.count_if(F.col("sa_risk") >= cfg.cap - M.REACHED).alias("sa_saturated"))


def compared(base: DataFrame, other: DataFrame) -> DataFrame:
    """Largest changes of risk, CVaR and threshold, and changed saturation, of one fit against another."""
    o = other.select("transition", *[F.col(c).alias(f"o_{c}") for c in ("risk", "cvar", "epsilon_sat", "saturated")])
    gap = lambda c: F.max(F.abs(F.col(c) - F.col(f"o_{c}")))
    return base.join(o, "transition").agg(F.count("*").alias("candidates"), gap("risk").alias("risk_change"), gap("cvar").alias("cvar_change"), gap("epsilon_sat").alias("threshold_change"), F.count_if(F.col("saturated") != F.col("o_saturated")).alias("reclassified"))


def reproduction(expected: DataFrame, found: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(metric, rows, worst, passed): a gate between two tables, rows missing on either side failing it."""
    a = expected.select(key, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns])
    b = found.select(key, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])).alias("x")
    x = a.join(b, key, "full_outer").select(stack).select("x.*")
    same = F.col("a").eqNullSafe(F.col("b")) | (F.abs(F.col("a") - F.col("b")) <= tolerance)
    return x.groupBy("metric").agg(F.count("*").alias("rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("worst"), F.bool_and(F.coalesce(same, F.lit(False))).alias("passed"))


def manifest_digest(ports: DataFrame) -> DataFrame:
    """(digest): a hash of frozen portfolios that no order of rows changes."""
    line = F.concat_ws("|", "method", F.concat(F.lit("K="), "K"), "rank", "transition")
    return ports.select(line.alias("l")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("digest"))


def sweep(hist: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """Metrics of each named configuration, one under another."""
    out = None
    for name, cfg in configs.items():
        one = M.fit(hist, cfg).select(F.lit(name).alias("configuration"), *M.METRICS)
        out = one if out is None else out.unionByName(one)
    return out


def drift_score(table: DataFrame) -> DataFrame:
    """Candidates by share of burden, raised by drift (share, w1)."""
    return table.withColumn("score", F.col("share") * (1 + F.log1p("w1"))).orderBy(F.desc("score"), "transition")


