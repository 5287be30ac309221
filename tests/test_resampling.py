"""Sliced histograms, replicates and programs against brute force."""

import hashlib
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomflow.config import Config
from loomflow.functions import sliced as L
from loomflow.plans import model as M
from loomflow.plans import programs as P
from loomflow.plans import resample as R
from loomflow.plans import sweep as W

CFG = Config(start=datetime(2018, 1, 1), decision=datetime(2018, 7, 1), holdout_end=datetime(2018, 10, 1), min_block=3, cap=50.0)
PORTS = [("Frequency", 2, 1, "A -> B"), ("Frequency", 2, 2, "C -> D"), ("Mean burden", 2, 1, "C -> D"), ("Mean burden", 2, 2, "A -> B"), ("Empirical Tail", 2, 1, "A -> B"), ("Empirical Tail", 2, 2, "E -> F")]


def held_rows(n=240, seed=2):
    rng = np.random.default_rng(seed)
    names = ["A -> B", "C -> D", "E -> F", "G -> H"]
    return [(int(k // 3) if k % 11 else None, datetime(2018, 7, 1) + timedelta(hours=9 * k), names[int(rng.integers(4))], float(rng.exponential(20))) for k in range(n)]


@pytest.fixture(scope="module")
def held(spark):
    return spark.createDataFrame(held_rows(), "case_id int, origin timestamp_ntz, transition string, delay double").repartition(3).cache()


@pytest.fixture(scope="module")
def ports(spark):
    return spark.createDataFrame(PORTS, "method string, K int, rank int, transition string")


def tail_sum(y, w, tail):
    order = np.argsort(-y, kind="stable")
    y, w = y[order], w[order]
    before = np.cumsum(w) - w
    return float((y * np.clip(w.sum() * tail - before, 0, w)).sum())


def differences(rows, weights, cluster, cap=50.0, tail=1 - 0.95, k=2, candidates=("A -> B", "C -> D", "E -> F")):
    """Brute force of the paired bootstrap: one replicate after another."""
    y = np.minimum([r[3] for r in rows], cap)
    names = sorted({r[2] for r in rows})
    at = np.array([names.index(r[2]) for r in rows])
    got = {}
    for rep in range(weights.shape[1]):
        w = weights[cluster, rep].astype(float)
        burden = {"mean": [float((y * w)[at == i].sum()) for i in range(len(names))], "tail": [tail_sum(y[at == i], w[at == i], tail) / tail for i in range(len(names))]}
        for target, b in burden.items():
            total = sum(b)
            share = {m: 100 * sum(b[names.index(t)] for m2, _, _, t in PORTS if m2 == m) / total for m in ("Frequency", "Mean burden", "Empirical Tail")}
            share[R.ORACLE] = 100 * sum(sorted((b[names.index(c)] for c in candidates), reverse=True)[:k]) / total
            for left, right in (("Frequency", "Mean burden"), ("Frequency", "Empirical Tail"), ("Mean burden", "Empirical Tail"), *[(R.ORACLE, m) for m in ("Frequency", "Mean burden", "Empirical Tail")]):
                got.setdefault((left, right, target), []).append(share[left] - share[right])
    return {key: (np.mean(v), np.quantile(v, 0.025), np.quantile(v, 0.975)) for key, v in got.items()}


@pytest.mark.parametrize("scheme", ["calendar_7d", "calendar_14d", "calendar_28d", "case_cluster"])
def test_paired_bootstrap_against_brute_force(spark, held, ports, scheme):
    cfg, reps = CFG.but(sizes=(2,)), 40
    candidates = spark.createDataFrame([(t,) for t in ("A -> B", "C -> D", "E -> F")], "transition string")
    own, n, weigh = R.schemes(held, cfg, (7, 14, 28), reps)[scheme]
    got = {(r.left_method, r.right_method, r.target): r for r in R.paired_bootstrap(own, ports, candidates, cfg, weigh, reps).collect()}
    every = own.select("case_id", "origin", "transition", "delay", "cluster").collect()
    rows, cluster = [tuple(r)[:4] for r in every], np.array([r.cluster for r in every])
    assert n == cluster.max() + 1
    want = differences(rows, weigh(np.arange(n)), cluster)
    assert set(got) == set(want)
    for key, (mean, lo, hi) in want.items():
        assert (got[key].difference, got[key].lower, got[key].upper) == (pytest.approx(mean, abs=1e-9), pytest.approx(lo, abs=1e-9), pytest.approx(hi, abs=1e-9))
    for target in ("mean", "tail"):
        same = got["Frequency", "Mean burden", target]
        assert (same.difference, same.lower, same.upper, same.identical) == (0.0, 0.0, 0.0, True)


def test_all_schemes_in_one_table(held, ports):
    got = R.bootstrapped(held, ports, ports.select("transition").distinct(), CFG.but(sizes=(2,)), (7, 14), 10)
    assert {r.scheme: r.clusters for r in got.select("scheme", "clusters").distinct().collect()} == {"calendar_7d": 13, "calendar_14d": 7, "case_cluster": 81}


@pytest.mark.parametrize("size", [1, 2, 97, 1000])
def test_splitting_draws_as_many_as_there_are_clusters(size):
    draw = L.Splitting(size, 50, 7)
    whole = draw(np.arange(size))
    assert (whole.sum(axis=0) == size).all()
    some = np.unique(np.random.default_rng(1).integers(0, size, 20))
    assert (draw(some) == whole[some]).all() and (draw(np.zeros(0, dtype=int)).shape == (0, 50))
    if size == 1000:
        assert abs((whole == 0).mean() - (1 - 1 / size) ** size) < 0.01 and abs(whole.var() - (1 - 1 / size)) < 0.03
        assert (L.Splitting(size, 50, 8)(np.arange(size)) != whole).any()


def test_weights_of_scattered_cases_cost_no_generator_each(spark, monkeypatch):
    some = np.arange(0, 300_000, 601)
    draw = L.splitting(spark, 300_000, 20, 7)
    assert draw.left == L.Splitting(300_000, 20, 7).left and min(draw.left) >= 0
    made, real = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda *a: made.append(a) or real(*a))
    got = draw(some)
    assert len(made) <= 1 and abs(got.mean() - 1) < 0.05 and abs(got.var() - 1) < 0.08


@pytest.mark.parametrize("rows", [1, 7, 4096])
def test_slices_do_not_change_replicates(spark, rows):
    rng = np.random.default_rng(5)
    data = [("t", int(rng.integers(12)), float(rng.integers(0, 40)) / 2, int(rng.integers(1, 4))) for _ in range(200)]
    pmf = spark.createDataFrame(data, "transition string, cluster long, y double, c long")
    weigh = L.Calendar(12, 9, 3)
    got = {r.rep: r for r in L.resampled(pmf, ["transition"], 20.0, 0.1, 9, weigh, rows).collect()}
    y, w = np.array([d[2] for d in data]), weigh(np.array([d[1] for d in data])) * np.array([d[3] for d in data])[:, None]
    for rep in range(9):
        assert got[rep].s == pytest.approx(float(y @ w[:, rep])) and got[rep].worst == pytest.approx(tail_sum(y, w[:, rep], 0.1))


@pytest.mark.parametrize("rows", [1, 5, 4096])
@pytest.mark.parametrize("leave_out", [False, True])
def test_distances_against_the_dense_table(spark, rows, leave_out):
    rng = np.random.default_rng(6)
    data = Counter((int(rng.integers(5)), float(rng.integers(0, 60)) / 3) for _ in range(150))
    hist = spark.createDataFrame([("t", b, y, c) for (b, y), c in data.items()] + [("u", 0, 1.0, 9)], "transition string, block int, y double, c long")
    weights = np.vstack([np.ones(6, int), L.Calendar(6, 4, 1).weights])
    for w in (None, weights):
        if leave_out and w is not None:
            continue
        parts = L.calibrations(hist, ["transition"], [L.Spec(0, 15.0, 0.1, 25, leave_out)], w, rows).where("transition = 't'").collect()
        xs = np.unique([y for _, y in data])
        counts = np.zeros((6, len(xs)))
        for (b, y), c in data.items():
            counts[b, np.searchsorted(xs, y)] += c
        for rep, m in enumerate(weights if w is not None else weights[:1]):
            total, pool = counts.sum(axis=1), m @ counts
            row = next(p for p in parts if p.rep == rep and p.block == -1)
            assert (row.n, row.top) == (pool.sum(), pool[xs >= 15].sum()) and row.s == pytest.approx(pool @ xs) and row.worst == pytest.approx(tail_sum(xs, pool, 0.1))
            good = {b for b in range(6) if total[b] >= 25 and m[b] > 0}
            assert {p.block for p in parts if p.rep == rep and p.block >= 0} == good
            for b in good:
                ref = np.cumsum(pool - counts[b] if leave_out else pool)
                want = float((np.abs(np.cumsum(counts[b]) / total[b] - ref / ref[-1])[:-1] * np.diff(xs)).sum())
                assert next(p.d for p in parts if p.rep == rep and p.block == b) == pytest.approx(want)


def test_a_block_without_others_has_no_distance(spark):
    hist = spark.createDataFrame([("u", 0, 1.0, 9), ("u", 0, 2.0, 9)], "transition string, block int, y double, c long")
    assert M.distances(hist, ["transition"], CFG.but(reference="leave_one_block_out")).count() == 0
    assert [r.d for r in M.distances(hist, ["transition"], CFG).collect()] == [0.0]


def test_permutations_keep_the_sizes_of_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(9)), datetime(2018, 1, 1) + timedelta(hours=7 * k), "ab"[k % 2] + " -> c", float(rng.integers(0, 9))) for k in range(300)]
    hist = spark.createDataFrame(rows, "case_id int, origin timestamp_ntz, transition string, delay double").repartition(4)
    metrics = spark.createDataFrame([("a -> c", 1.0), ("b -> c", 1.0)], "transition string, epsilon double")
    got = R.dealt_anew(hist, metrics, CFG, 20).collect()
    block = lambda o: (o - CFG.start) // timedelta(days=CFG.block_days)
    sizes = Counter((r[2], block(r[1])) for r in rows)
    values = Counter((r[2], r[3]) for r in rows)
    placed = {}
    for rep in range(20):
        own = [r for r in got if r.rep == rep]
        assert Counter((r.transition, r.block) for r in own) == sizes and Counter((r.transition, r.y) for r in own) == values
        placed[rep] = sorted((r.transition, r.block, r.y) for r in own)
    assert placed[0] != placed[1]
    text = lambda r, rep: hashlib.md5(f"{CFG.seed + 23}:{rep}:{r[2]}:{r[0]}:{round((r[1] - datetime(1970, 1, 1)) / timedelta(microseconds=1))}".encode()).hexdigest()
    order = [r[3] for r in sorted((r for r in rows if r[2] == "a -> c"), key=lambda r: text(r, 3))]
    first = sorted(b for t, b in sizes if t == "a -> c")[0]
    assert sorted(r.y for r in got if r.rep == 3 and r.transition == "a -> c" and r.block == first) == sorted(order[: sizes["a -> c", first]])


def test_numbers_of_clusters_are_dense(spark):
    df = spark.createDataFrame([(k % 700 if k % 9 else None,) for k in range(3000)], "case_id int")
    out, n = L.numbered(df, "case_id", "cluster")
    pairs = {(r.case_id, r.cluster) for r in out.collect()}
    assert out.count() == 3000 and sorted(c for _, c in pairs) == list(range(n)) and n == len({v for v, _ in pairs})


def test_many_small_values_do_not_share_a_slice(spark):
    df = spark.range(20_000).select(F.lit("t").alias("transition"), (F.col("id") / 1e5).alias("y"))
    sizes = [r["count"] for r in L.sliced(df.union(df.limit(1).select("transition", F.lit(2160.0))), ["transition"], "y", 2160.0, 1000).groupBy("slice").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 2500 and sum(sizes) == 20_001


@pytest.mark.parametrize("seed", range(6))
def test_programs_agree_with_the_closed_form(seed):
    rng = np.random.default_rng(seed)
    x = np.append(np.sort(rng.choice(np.arange(0, 96, 6), 9, replace=False)).astype(float), 96.0) if seed else np.array([0.0, 1.0, 2.0, 96.0])
    x[0] = 0.0
    p = rng.dirichlet(np.ones(len(x))) if seed else np.array([0.9, 0.08, 0.02, 0.0])
    tail = 0.05 if seed % 2 else 0.1
    cvar = tail_sum(x, p, tail) / tail
    s = tail * (96 - cvar)
    for eps in (0.0, 0.5 * s, s, 2 * s):
        assert P.worst_cvar(x, p, eps, tail)[0] == pytest.approx(min(96.0, cvar + eps / tail), abs=1e-7)


def test_maximum_of_known_programs():
    assert P.maximum(np.array([3.0, 5.0]), np.array([[1.0, 0.0], [0.0, 2.0], [3.0, 2.0]]), np.array([4.0, 12.0, 18.0])) == pytest.approx(36.0)
    assert P.maximum(np.array([-1.0]), np.array([[1.0]]), np.array([1.0])) == 0.0
    with pytest.raises(ValueError):
        P.maximum(np.array([1.0]), np.array([[-1.0]]), np.array([1.0]))


def test_settings_are_twenty_one_and_scan_once(spark):
    every = W.settings(CFG, (7, 28), (50, 100), (12.0, 24.0), 0.9, 80.0, 20, (30, 60))
    assert len(every) == 21 and len({s.name for s in every}) == 21
    obs = spark.createDataFrame([], "case_id int, origin timestamp_ntz, destination timestamp_ntz, origin_activity string, transition string, delay double")
    table = W.sensitivity(obs, every)
    assert table.count() == 0
    plan = W.counted(spark.read.schema(obs.schema).parquet("/root/testdata/sf0.001/region.parquet"), every)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    spark.catalog.clearCache()


def test_a_histogram_has_no_row_for_each_way_to_count(spark):
    every = W.settings(CFG, (7, 28), (50, 100), (12.0, 24.0), 0.9, 80.0, 20, (30, 60))
    rows = [(k, CFG.start + timedelta(hours=10 * k), CFG.start + timedelta(hours=10 * k + 1), "a", "a -> b", 1.0 + k / 100) for k in range(600)]
    obs = spark.createDataFrame(rows, "case_id int, origin timestamp_ntz, destination timestamp_ntz, origin_activity string, transition string, delay double")
    assert 500 < W.counted(obs, every).count() <= 600


def test_a_permutation_has_no_row_for_each_replicate(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(9)), datetime(2018, 1, 1) + timedelta(hours=k // 2), "a -> c", 7.0 if k % 3 else float(rng.integers(0, 40))) for k in range(3000)]
    hist = spark.createDataFrame(rows, "case_id int, origin timestamp_ntz, transition string, delay double").repartition(4)
    dealt = R.Dealt(hist, spark.createDataFrame([("a -> c", 1.0)], "transition string, epsilon double"), CFG, 6)
    held = dealt.rows.collect()
    assert sum(max(1, r["rows"]) for r in held) == 3000 and len(held) < 1500  # the shared value is counted
    table = {}
    for r in dealt.table().collect():
        table.setdefault((r.rep, r.block), []).append(r.y)
    assert {(r.rep, r.block): (r.n, pytest.approx(r.burden)) for r in dealt.sums().collect()} == {k: (len(v), sum(v)) for k, v in table.items()}
    y = np.array([r[3] for r in rows])
    xs = np.unique(y)
    cdf = lambda v: np.searchsorted(np.sort(v), xs, side="right") / len(v)
    blocks = sorted({b for _, b in table})
    got = {(r.rep, blocks[r["at"]]): r.d for r in dealt.distances().collect()}
    assert got == {k: pytest.approx(float((np.abs(cdf(v) - cdf(y))[:-1] * np.diff(xs)).sum())) for k, v in table.items() if len(v) >= CFG.min_block}
    spark.catalog.clearCache()
