import numpy as np
import pytest
from pyspark.sql import functions as F

from walksieve.operators import calibration as C, pairs as P
from walksieve.params import Calib
from tests.test_selection import make


def numpy_far(v, t, yaw, far):
    v = v.astype(np.float64)
    out = [v[i] @ v[j] for i in range(len(v)) for j in range(i + 1, len(v))
           if yaw[i] == yaw[j] and abs(t[i] - t[j]) > far]
    return np.array(out)


def walk(spark, seed, n=90, copies=0, dim=16, walk_id=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    if copies:
        v[:copies] = v[0] + rng.normal(scale=1e-4, size=(copies, dim))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    t, yaw = np.arange(n) * 0.5, np.arange(n) % 2 * 90
    return v, t, yaw, make(spark, v, np.ones(n), yaw=yaw, t_sec=t, walk=walk_id)


@pytest.mark.parametrize("seed,copies,block", [(0, 0, 8192), (1, 0, 17), (2, 60, 8192), (3, 80, 16)])
def test_far_statistics_equal_numpy(spark, seed, copies, block):
    v, t, yaw, df = walk(spark, seed, copies=copies)
    far = numpy_far(v, t, yaw, 5.0)
    hist = P.far_histogram(df, 5.0, block).cache()
    assert hist.agg(F.sum("pairs")).first()[0] == len(far)
    got = C.far_quantiles(df, hist, Calib(far_seconds=5.0, false_merge_pct=7.5), size=block).first()
    assert got.n == len(far)
    for name, pct in (("median", 50), ("p95", 95), ("p99", 99), ("tau", 92.5)):
        assert got[name] == pytest.approx(np.round(np.percentile(far, pct), 4), abs=1e-9), name
    assert got["max"] == pytest.approx(np.round(far.max(), 4))


def test_budget_per_walk(spark):
    v, t, yaw, a = walk(spark, 0, walk_id=1)
    b = walk(spark, 0, walk_id=2)[3]
    both = a.unionByName(b)
    budgets = spark.createDataFrame([(1, 5.0), (2, 20.0)], "walk_id long, false_merge_pct double")
    got = {r.walk_id: r.tau for r in C.far_quantiles(both, P.far_histogram(both, 5.0), Calib(far_seconds=5.0), budgets).collect()}
    far = numpy_far(v, t, yaw, 5.0)
    assert got == {1: pytest.approx(np.round(np.percentile(far, 95), 4)), 2: pytest.approx(np.round(np.percentile(far, 80), 4))}


def test_exactly_far_seconds_apart_is_not_far(spark):
    df = make(spark, [[1, 0], [0, 1], [1, 1]], [1, 1, 1], t_sec=[0, 20, 20.5], yaw=[45, 45, 45])
    assert P.far_histogram(df, 20.0).agg(F.sum("pairs")).first()[0] == 1


def test_too_few_pairs_give_no_threshold(spark):
    v, t, yaw, df = walk(spark, 0, n=14)
    hist = P.far_histogram(df, 0.1)
    got = C.far_quantiles(df, hist, Calib(far_seconds=0.1)).first()
    assert got.n == 42 and got.tau is None and got.median is not None


@pytest.mark.parametrize("n,keep", [(1000, 100), (4001, 501), (99, 100), (101, 100), (250, 2)])
def test_sketch_is_the_spaced_ranks(spark, n, keep):
    rng = np.random.default_rng(n)
    values = np.round(rng.uniform(-1, 1, n), 4)
    bins, counts = np.unique(np.rint(values * 10000).astype(int), return_counts=True)
    hist = spark.createDataFrame([(0, 45, int(b), int(c), float(b) / 1e4, float(b) / 1e4) for b, c in zip(bins, counts)],
                                 "walk_id long, yaw int, bin long, pairs long, low double, high double")
    ordered = np.sort(values)
    if n > keep:
        ordered = ordered[np.linspace(0, n - 1, keep).round().astype(int)]
    got = C.far_sketch(hist, keep).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(ordered)))
    assert np.allclose([r.cosine for r in got], ordered)
    assert np.allclose(C.sketch_arrays(hist, keep).first().cosines, ordered)


def test_large_sketch_holds_the_percentiles(spark):
    n = 400_000
    values = np.random.default_rng(1).beta(2, 5, n)
    bins, counts = np.unique(np.rint(values * 10000).astype(int), return_counts=True)
    hist = spark.createDataFrame([(0, 45, int(b), int(c), float(b) / 1e4, float(b) / 1e4) for b, c in zip(bins, counts)],
                                 "walk_id long, yaw int, bin long, pairs long, low double, high double")
    kept = np.array(C.sketch_arrays(hist).first().cosines)
    assert len(kept) == 5000
    for p in (50, 95, 99):
        assert np.percentile(kept, p) == pytest.approx(np.percentile(values, p), abs=1e-3)


@pytest.mark.parametrize("n,samples", [(50, 10), (7, 10), (10, 10), (33, 1), (21, 2), (12, 0), (44, 7)])
def test_sample_panos(spark, n, samples):
    ids = [i * 3 for i in range(n)]
    df = spark.createDataFrame([(0, i) for i in ids for _ in range(2)], "walk_id long, pano_idx long")
    got = sorted(r.pano_idx for r in C.sample_panos(df, samples).collect())
    if samples <= 0:
        want = []
    elif n <= samples:
        want = ids
    elif samples == 1:
        want = ids[:1]
    else:
        want = sorted({ids[round(i * (n - 1) / (samples - 1))] for i in range(samples)})
    assert got == want


def test_reference_pairs_skip_what_is_missing(spark):
    df = make(spark, [[1, 0], [0, 1], [1, 1]], [1, 1, 1], yaw=[45, 135, 45], t_sec=[0.0, 0.0, 1.0], pano=[0, 0, 1])
    near = spark.createDataFrame([(0, 1, 45, [1.0, 0.0]), (0, 31, 135, [1.0, 0.0])],
                                 "walk_id long, frame_no long, yaw int, embedding array<double>")
    got = C.reference_pairs(df, near, 30.0, 10).collect()
    assert [(r.pano, r.yaw, r.neighbour, r.cosine) for r in got] == [(0, 45, "n00000_y045.jpg", 1.0)]


def test_record_and_requantile(spark):
    v, t, yaw, df = walk(spark, 4)
    near = df.limit(0).select("walk_id", F.lit(1).cast("long").alias("frame_no"), "yaw", "embedding")
    record = C.calibrate(df, near, 30.0, Calib(far_seconds=5.0)).cache()
    r = record.first()
    far = numpy_far(v, t, yaw, 5.0)
    assert r.far.n == len(far) and r.reference.n == 0 and r.reference.median == 0.0
    assert not r.healthy and r.reference_error
    again = C.requantile(record, 20.0).first()
    assert again.tau == pytest.approx(np.round(np.percentile(np.round(far, 4), 80), 4), abs=1e-9)
    assert again.false_merge_pct == 20.0 and again.far.n == len(far)
    without = record.withColumn("far", F.col("far").withField("cosines", F.array().cast("array<double>")))
    assert C.requantile(without, 20.0).count() == 0


def test_healthy_needs_a_high_median(spark):
    df = make(spark, [[1, 0]] * 60, [1] * 60, t_sec=np.arange(60) * 10)
    for vector, healthy in (([1.0, 0.0], True), ([0.0, 1.0], False)):
        near = spark.createDataFrame([(0, 1, 45, vector)], "walk_id long, frame_no long, yaw int, embedding array<double>")
        assert C.calibrate(df, near, 30.0).first().healthy is healthy


def test_low_reference_pairs(spark):
    pair = {"cosine": 0.9, "pano": 1, "yaw": 45, "t_sec": 0.5, "face": "a", "neighbour": "b"}
    rows = [(0, 0.9, [pair]), (1, 0.8, [pair]), (2, None, [pair])]
    record = spark.createDataFrame(rows, "walk_id long, tau double, pairs array<struct<cosine:double,"
                                         "pano:int,yaw:int,t_sec:double,face:string,neighbour:string>>")
    assert [r.walk_id for r in C.low_reference_pairs(record).collect()] == [0]


@pytest.mark.parametrize("block", [8192, 13])
def test_similar_neighbours(spark, block):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 5))
    v[20:40] = v[0]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    pano = np.arange(60) // 3
    got = {r.face_idx: (r.neighbours, round(r.best_cosine, 6), r.best_face)
           for r in P.similar_neighbours(make(spark, v, np.ones(60), pano), 0.5, block).collect()}
    w = v.astype(float)
    cos = np.where(pano[:, None] == pano[None, :], -9, w @ w.T)
    for i in range(60):
        if (cos[i] >= 0.5).any():
            assert got[i][0] == (cos[i] >= 0.5).sum()
            assert got[i][1] == pytest.approx(cos[i].max(), abs=1e-6)
        else:
            assert i not in got
