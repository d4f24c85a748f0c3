"""Pruned blocks, rounds of long walks, the threshold sweep and the sliding median."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_selection import make, planted, sequential
from walksieve.operators import pairs, regions, selection
from walksieve.params import Dedup


def clustered(seed, places=12, each=30, dim=16, spread=0.04):
    """Views of a few places, in the order of the walk."""
    rng = np.random.default_rng(seed)
    v = np.repeat(rng.normal(size=(places, dim)), each, axis=0) + rng.normal(scale=spread, size=(places * each, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True), rng.uniform(1, 200, places * each)


def met(spark, v, sharp, tau, size):
    rows = make(spark, v, sharp).select("walk_id", "face_idx", "pano_idx", F.lit(tau).alias("tau"), "embedding")
    laid = regions.laid_out(rows, size)
    parts, near = regions.near_parts(laid, F.col("tau"), size)
    home = {r.face_idx: r.part for r in laid.join(parts, ["walk_id", "block"]).collect()}
    return home, {(r._pa, r._pb) for r in near.collect()}


@pytest.mark.parametrize("tau", [0.3, 0.8, 0.97])
def test_no_similar_pair_is_pruned(spark, tau):
    v, sharp = clustered(1)
    home, near = met(spark, v, sharp, tau, 20)
    cos = v @ v.T
    for i, j in zip(*np.nonzero(np.triu(cos >= tau))):
        assert tuple(sorted((home[i], home[j]))) in near
    blocks = len(set(home.values()))
    assert max(np.bincount(list(home.values()))) <= 2 * 20
    if tau > 0.9:       # most pairs of places never meet
        assert len(near) < 0.35 * blocks * (blocks + 1) / 2


def test_random_vectors_prune_little(spark):
    v, sharp, _ = planted(4)
    home, near = met(spark, v, sharp, 0.3, 30)
    blocks = len(set(home.values()))
    assert len(near) > 0.9 * blocks * (blocks + 1) / 2


@pytest.mark.parametrize("tau", [0.35, 0.9])
def test_neighbours_over_pruned_blocks(spark, tau):
    v, sharp = clustered(2, each=12)
    df = make(spark, v, sharp, pano=np.arange(len(v)) // 2).unionByName(make(spark, v[:9], sharp[:9], walk=7))
    whole, blocks = (sorted(pairs.similar_neighbours(df, tau, size).collect()) for size in (8192, 16))
    assert [(r.walk_id, r.face_idx, r.neighbours, r.best_face) for r in whole] == [(r.walk_id, r.face_idx, r.neighbours, r.best_face) for r in blocks]


def test_rounds_grow_like_the_logarithm(spark):
    took = {}
    for n in (100, 700):
        rng = np.random.default_rng(n)
        v = rng.normal(size=(n, 8))
        v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        sharp = rng.permutation(n) + 1.0
        slim = make(spark, v, sharp).select("walk_id", "face_idx", "pano_idx", "sharpness", F.lit(0.6).alias("tau"), "embedding")
        out, took[n] = selection.parallel_rounds(slim, 64)
        assert {r.face_idx for r in out.filter("kept").collect()} == sequential(v, sharp, range(n), 0.6)[0]
        assert took[n] <= 2 * math.log2(n)
    assert took[700] <= took[100] + 6


def test_distinct_faces_take_one_round(spark):
    v = np.eye(40)
    slim = make(spark, v, np.arange(40)).select("walk_id", "face_idx", "pano_idx", "sharpness", F.lit(0.9).alias("tau"), "embedding")
    out, rounds = selection.parallel_rounds(slim, 8)
    assert rounds == 1 and out.filter("kept").count() == 40


@pytest.mark.parametrize("block", [8192, 40])
def test_sweep_equals_separate_selections(spark, block):
    v, sharp, pano = planted(6, n=50, twins=30)
    yaw = [45 + 90 * (i % 4) for i in range(len(v))]
    df = make(spark, v, sharp, pano, yaw=yaw).unionByName(make(spark, v[:20], sharp[:20], pano[:20], walk=3, yaw=yaw[:20])).cache()
    dedup, taus = Dedup(solo_floor=0.6), [0.2, 0.9, 0.45]
    got = {(r.walk_id, r.tau): (r.kept, r.absorbed, r.solo) for r in selection.threshold_sweep(df, taus, dedup, block).collect()}
    for tau in taus:
        level = spark.createDataFrame([(0, tau), (3, tau)], "walk_id long, tau double")
        rows = selection.select_faces(df, level, dedup).groupBy("walk_id").agg(
            F.count_if("kept"), F.count_if(F.col("anchor").isNotNull()), F.count_if("solo")).collect()
        for walk, *counts in rows:
            assert got.pop((walk, tau)) == tuple(counts)
    assert not got


def test_sweep_needs_a_threshold_and_takes_no_faces(spark):
    df = make(spark, [[1.0, 0.0]], [1])
    with pytest.raises(ValueError):
        selection.threshold_sweep(df, [])
    assert selection.threshold_sweep(df.limit(0), [0.5]).collect() == []


def test_sliding_median_with_ties_and_missing_values():
    rng = np.random.default_rng(9)
    t = np.sort(rng.integers(0, 60, 400).astype(float))
    value = rng.integers(0, 12, 400).astype(float)
    value[rng.random(400) < 0.2] = np.nan
    value[:15] = np.nan
    got = selection.sliding_median(t, value, 4.0)
    for i in range(400):
        near = value[(np.abs(t - t[i]) <= 4.0) & ~np.isnan(value)]
        assert np.isnan(got[i]) if not len(near) else got[i] == np.median(near)
    assert len(selection.sliding_median(np.empty(0), np.empty(0), 1.0)) == 0


def test_a_wide_window_costs_little_more():
    rng = np.random.default_rng(10)
    t, value = np.arange(20_000) * 0.5, rng.uniform(0, 9, 20_000)
    took = []
    for span in (45.0, 1000.0):
        begun = time.process_time()
        selection.sliding_median(t, value, span)
        took.append(time.process_time() - begun)
    assert took[1] < 3 * took[0]
