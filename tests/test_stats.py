"""Single operators on small inputs with known results."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomflow.config import Config, common_followup_end
from loomflow.functions import scalars as S
from loomflow.functions import stats as T
from loomflow.operators import events as E
from loomflow.plans import checks as C
from loomflow.plans import model as M

CFG = Config(start=datetime(2018, 1, 1), decision=datetime(2018, 7, 1), holdout_end=datetime(2018, 10, 1))


def pmf(spark, x, p, name="t"):
    return spark.createDataFrame([(name, float(a), float(b)) for a, b in zip(x, p)], "transition string, y double, w double")


def test_fractional_tail(spark):
    assert T.cvar(pmf(spark, [0, 1, 2], [0.9, 0.08, 0.02]), ["transition"], 1 - 0.95, 2.0).first().cvar == pytest.approx(1.4)


def test_saturation_cannot_be_undone(spark):
    row = T.cvar(pmf(spark, [0, 2], [0.94, 0.06]), ["transition"], 1 - 0.95, 2.0).select("cvar", T.robust(F.col("cvar"), F.lit(0.0), 2.0, 0.05).alias("r"), T.saturation(F.col("cvar"), 2.0, 0.05).alias("s")).first()
    assert (row.cvar, row.r, row.s) == (pytest.approx(2.0), pytest.approx(2.0), pytest.approx(0.0))


@pytest.mark.parametrize("alpha", [0.9, 0.95])
def test_transport_and_program_agree_with_the_closed_form(spark, alpha):
    rng, cap, tail = np.random.default_rng(20260914), 2160.0, 1 - alpha
    parts = None
    for k in range(8):
        x = np.sort(np.append(rng.uniform(0, cap, 9), cap))
        one = pmf(spark, x, rng.dirichlet(np.ones(10)), f"t{k}")
        parts = one if parts is None else parts.union(one)
    parts = parts.cache()
    c = T.cvar(parts, ["transition"], tail, cap).withColumn("epsilon_sat", T.saturation(F.col("cvar"), cap, tail)).withColumn("epsilon", 0.3 * F.col("epsilon_sat")).cache()
    both = T.transport(parts, ["transition"], cap, tail).join(c, "transition").select(F.max(F.abs(F.col("threshold") - F.col("epsilon_sat")))).first()[0]
    assert both < 1e-7
    checks = C.program_checks(parts, c, CFG.but(cap=cap, alpha=alpha)).collect()
    assert len(checks) == 40 and max(r.error for r in checks) < 1e-6 and max(r.closed for r in checks) <= cap
    hinge = C.hinge_cvar(parts, tail).join(c.select("transition", F.col("cvar").alias("c")), "transition").select(F.max(F.abs(F.col("cvar") - F.col("c")))).first()[0]
    assert hinge < 1e-7


def test_cutoff_is_strict(spark):
    cut = datetime(2018, 7, 1)
    rows = [(1, datetime(2018, 6, 1), cut + d, "a", "a -> b", 1.0) for d in (timedelta(seconds=-1), timedelta(0), timedelta(days=1))]
    obs = spark.createDataFrame(rows, "case_id int, origin timestamp_ntz, destination timestamp_ntz, origin_activity string, transition string, delay double")
    assert E.history(obs, CFG).count() == 1
    assert E.holdout(obs.withColumn("origin", F.lit("2018-07-02").cast("timestamp_ntz")), CFG.but(observation_end=cut)).count() == 2


def test_running_sums_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [("k", float(y), int(w)) for y, w in zip(np.unique(rng.uniform(0, 50, 300)), rng.integers(1, 9, 300))]
    df = spark.createDataFrame(rows, "transition string, y double, w long")
    for bins in (1, 7, 256):
        got = {r.y: r.c for r in T.running(df, ["transition"], "y", {"c": "w"}, 50.0, bins=bins).collect()}
        total, want = 0, {}
        for _, y, w in rows:
            total += w
            want[y] = total
        assert got == want
    gaps = {r.y: r.dx for r in T.spaced(df, ["transition"], "y", 50.0).collect()}
    ys = [y for _, y, _ in rows]
    assert gaps[ys[-1]] is None and gaps[ys[3]] == pytest.approx(ys[4] - ys[3])


def test_empty_history_gives_an_empty_table(spark):
    obs = spark.createDataFrame([], "case_id int, origin timestamp_ntz, destination timestamp_ntz, origin_activity string, transition string, delay double")
    assert M.fit(E.history(obs, CFG), CFG).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, " User_1 ", "TRUE"), (3.5, "batch_2", "no"), (-1.0, None, "1")], "x double, r string, b string")
    rows = df.select(S.snapped(F.col("x"), 1.0, 3.0).alias("s"), S.resource_kind(F.col("r")).alias("k"), S.as_bool(F.col("b")).alias("b"), S.clipped(F.col("x"), 3.0).alias("c")).collect()
    assert [tuple(r) for r in rows] == [(2.0, "human", True, 2.5), (3.0, "batch", False, 3.0), (0.0, "none", True, 0.0)]
    assert CFG.blocks == 13 and common_followup_end(datetime(2018, 10, 1), datetime(2019, 1, 18), 120) == datetime(2018, 9, 20)
    assert CFG.digest() != CFG.but(kappa=0.5).digest()


@pytest.mark.parametrize("counts", [[1] * 7000, [9, 9, 4, 4, 4, 1, 1], [5], [8, 2], [3, 2, 2, 1, 1, 1]])
def test_variants_for_80_percent_counts_all_variants(spark, counts):
    table = spark.createDataFrame([(f"v{k}",) for k, n in enumerate(counts) for _ in range(n)], "variant string")
    share = np.cumsum(sorted(counts, reverse=True)) * 100.0 / sum(counts)
    assert E.variants_for(table).first()["n"] == int((share < 80).sum()) + 1


def test_nine_numbers_of_a_table_leave_no_task_with_all_values(spark):
    rng = np.random.default_rng(4)
    y = [*rng.exponential(20, 3001), *[5.0] * 900, -1.0, 900.0]
    df = spark.createDataFrame([(float(v),) for v in y] + [(None,)], "delay double").repartition(3)
    got = T.nine(df, "delay", 504.0)
    want = df.agg(*T.summary("delay")).first()
    assert got.columns == list(want.asDict()) and tuple(got.first()) == pytest.approx(tuple(want))
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    empty = T.nine(df.where("false"), "delay", 504.0).collect()
    assert [tuple(r) for r in empty] == [(0, *[None] * 8)]
