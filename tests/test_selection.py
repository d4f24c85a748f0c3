import numpy as np
import pytest
from pyspark.sql import functions as F

from walksieve.operators import selection

SCHEMA = ("walk_id long, face_idx int, pano_idx int, t_sec double, yaw int, path string, "
          "sharpness double, embedding array<float>")


def make(spark, vectors, sharpness, pano=None, walk=0, yaw=None, t_sec=None):
    v = np.asarray(vectors, dtype=np.float64)
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    pano = range(len(v)) if pano is None else pano
    return spark.createDataFrame(
        [(walk, i, int(p), float(t_sec[i] if t_sec is not None else p), int(yaw[i] if yaw is not None else 45),
          f"f{i}", float(s), e.tolist()) for i, (e, s, p) in enumerate(zip(v, sharpness, pano))], SCHEMA)


def sequential(v, sharpness, pano, tau):
    """The rule one face at a time: the second opinion of these tests."""
    kept, absorbed = [], {}
    for i in sorted(range(len(v)), key=lambda i: (-sharpness[i], i)):
        best, who = -2.0, None
        for k in kept:
            cos = float(v[k].astype(np.float64) @ v[i].astype(np.float64))
            if pano[k] != pano[i] and cos > best:
                best, who = cos, k
        if who is not None and best >= tau:
            absorbed[i] = (who, best)
        else:
            kept.append(i)
    return set(kept), absorbed


def result(df):
    out = df.collect()
    return {r.face_idx for r in out if r.kept}, {r.face_idx: (r.anchor, r.cosine) for r in out if r.anchor is not None}


def planted(seed, n=120, twins=120, dim=24):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v = np.concatenate([v, v[:twins] + rng.normal(scale=0.05, size=(twins, dim))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v.astype(np.float32), rng.uniform(1, 200, len(v)), np.arange(len(v)) // 4


def test_near_copy_goes_to_the_sharper(spark):
    df = make(spark, [[1, 0, 0], [1, 0.01, 0], [0, 1, 0]], [5, 9, 1])
    kept, absorbed = result(selection.greedy_dedup(df, 0.9))
    assert kept == {1, 2} and absorbed[0][0] == 1


def test_cosine_at_tau_absorbs(spark):
    df = make(spark, [[1, 0], [0.6, 0.8]], [2, 1])
    exact = float(np.float32(0.6))
    assert result(selection.greedy_dedup(df, exact))[0] == {0}
    assert result(selection.greedy_dedup(df, exact + 1e-9))[0] == {0, 1}


def test_one_panorama_never_absorbs_itself(spark):
    df = make(spark, [[1, 0], [1, 0], [1, 0]], [3, 2, 1], pano=[0, 0, 1])
    kept, absorbed = result(selection.greedy_dedup(df, 0.9))
    assert kept == {0, 1} and absorbed == {2: (0, pytest.approx(1.0))}


def test_ties_follow_capture_order(spark):
    df = make(spark, [[1, 0], [1, 0], [1, 0]], [7, 7, 7])
    kept, absorbed = result(selection.greedy_dedup(df, 0.9))
    assert kept == {0} and {k for k, _ in absorbed.values()} == {0}


def test_empty_input(spark):
    df = make(spark, [[1, 0]], [1]).limit(0)
    assert selection.greedy_dedup(df, 0.9).count() == 0


@pytest.mark.parametrize("seed,tau,block", [(0, 0.9, 8192), (1, 0.9, 16), (2, 0.35, 16), (3, 0.2, 7)])
def test_rounds_equal_the_sequential_rule(spark, seed, tau, block):
    v, sharp, pano = planted(seed)
    kept, absorbed = sequential(v, sharp, pano, tau)
    got_kept, got = result(selection.greedy_dedup(make(spark, v, sharp, pano), tau, block))
    assert got_kept == kept
    assert {i: a for i, (a, _) in got.items()} == {i: a for i, (a, _) in absorbed.items()}
    for i, (_, c) in got.items():
        assert c == pytest.approx(absorbed[i][1], abs=1e-9)


def test_shipped_faces_stay_under_tau_and_lead_their_groups(spark):
    v, sharp, pano = planted(5)
    kept, absorbed = result(selection.greedy_dedup(make(spark, v, sharp, pano), 0.9, 32))
    ids = sorted(kept)
    cos = v[ids].astype(float) @ v[ids].astype(float).T
    other = np.array(pano)[ids][:, None] != np.array(pano)[ids][None, :]
    assert (cos[other] < 0.9).all()
    assert all(sharp[a] >= sharp[i] for i, (a, _) in absorbed.items())


def test_walks_do_not_mix_and_one_may_be_mostly_copies(spark):
    rng = np.random.default_rng(3)
    big = np.concatenate([np.tile([1.0, 0, 0, 0], (90, 1)), rng.normal(size=(60, 4))])
    a, b = make(spark, big, rng.uniform(1, 9, 150), walk=1), make(spark, [[1, 0, 0, 0]] * 2, [1, 2], walk=2)
    out = selection.greedy_dedup(a.unionByName(b), 0.99, block=20)
    assert out.count() == 152
    per = {r.walk_id: r.k for r in out.groupBy("walk_id").agg(F.count_if("kept").alias("k")).collect()}
    v = (big / np.linalg.norm(big, axis=1, keepdims=True)).astype(np.float32)
    assert per[2] == 1
    sharp = [r.sharpness for r in a.orderBy("face_idx").collect()]
    assert per[1] == len(sequential(v, sharp, range(150), 0.99)[0])


def test_drop_solo(spark):
    df = make(spark, [[1, 0, 0], [1, 0.01, 0], [0, 1, 0], [0, 0, 1]], [90, 10, 80, 5])
    groups = selection.greedy_dedup(df, 0.9)
    ratio = spark.createDataFrame([(0, i, r) for i, r in enumerate([1.0, 0.1, 1.0, 0.2])],
                                  "walk_id long, face_idx int, ratio double")
    kept = lambda floor: {r.face_idx for r in selection.drop_solo(groups, ratio, floor).filter("kept").collect()}
    assert kept(0.5) == {0, 2}
    assert kept(0.0) == {0, 2, 3}
    # an anchor with members stays however smeared it is
    low = ratio.withColumn("ratio", F.lit(0.01))
    assert {r.face_idx for r in selection.drop_solo(groups, low, 0.5).filter("kept").collect()} == {0}


@pytest.mark.parametrize("span", [45.0, 3.0])
def test_heading_ratio(spark, span):
    rng = np.random.default_rng(1)
    n = 300
    t, yaw, sharp = rng.uniform(0, 400, n), rng.choice([45, 135], n), rng.uniform(0, 9, n)
    df = make(spark, np.ones((n, 2)), sharp, yaw=yaw, t_sec=t)
    got = {r.face_idx: r.ratio for r in selection.heading_ratio(df, span).collect()}
    for i in range(n):
        near = (yaw == yaw[i]) & (np.abs(t - t[i]) <= span)
        assert got[i] == pytest.approx(sharp[i] / np.median(sharp[near]))


def test_heading_ratio_of_blank_faces(spark):
    df = make(spark, [[1, 0]] * 3, [0, 0, 0])
    assert {r.ratio for r in selection.heading_ratio(df, 45.0).collect()} == {1.0}


def test_threshold_rule(spark):
    walks = spark.createDataFrame([(0, "fixed", 0.94), (1, "calibrated", 0.94), (2, "calibrated", 0.94),
                                   (3, "calibrated", 0.94)], "walk_id long, rule string, tau double")
    records = spark.createDataFrame([(1, 0.85), (2, None)], "walk_id long, tau double")
    got = {r.walk_id: (r.tau, r.problem) for r in selection.threshold_rule(walks, records).collect()}
    assert got == {0: (0.94, ""), 1: (0.85, ""), 2: (None, "too few far pairs"),
                   3: (None, "no calibration record")}


def test_reselect_at_angles(spark):
    angles = [0, 0.15, 0.30, 1.2]
    df = make(spark, [[np.cos(a), np.sin(a)] for a in angles], [1, 2, 3, 4])
    count = lambda tau: selection.greedy_dedup(df, tau).filter("kept").count()
    assert count(0.90) == 2 and count(0.98) == 3
