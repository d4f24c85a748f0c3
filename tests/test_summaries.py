from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from walksieve.operators import calibration, pairs, summaries
from walksieve.operators.pairs import BINS
from walksieve.params import Calib
from tests.test_calibration import walk

CELLS = "walk_id long, yaw int, bin long, pairs long, low double, high double"


def cells(spark, counts):
    """A histogram of {walk: counts of the bins from 0 on}."""
    return spark.createDataFrame([(w, 45, b, int(n), b / BINS, b / BINS) for w, row in counts.items() for b, n in enumerate(row) if n], CELLS)


def off_by(counts, value, share):
    """How far from `share` the ranks of a value lie, as a share of all."""
    upto = np.cumsum(counts)
    b = int(round(value * BINS))
    low, high = (upto[b - 1] if b else 0) / upto[-1], upto[b] / upto[-1]
    return max(0.0, low - share, share - high)


@pytest.mark.parametrize("size", [200, 2048])
def test_ranks_keep_to_the_stated_error(spark, size):
    """Counts from one to billions, in the order of the values and not."""
    rng = np.random.default_rng(size)
    rows = {0: rng.integers(1, 100, 9000), 1: 10 ** rng.uniform(0, 9, 9000), 2: np.geomspace(1, 3e9, 8000), 3: np.full(5, 2 ** 40), 4: np.r_[np.zeros(500), 1e12, rng.integers(1, 9, 5000)]}
    rows = {w: np.asarray(c).astype(np.int64) for w, c in rows.items()}
    made = summaries.far_summary(cells(spark, rows), size=size).cache()
    got = {r.walk_id: r for r in summaries.summary_quantiles(made).collect()}
    whole = np.zeros(9000, np.int64)
    for w, counts in rows.items():
        whole[:len(counts)] += counts
        assert got[w].n == counts.sum() and got[w].max == (len(counts) - 1) / BINS
        for name, share in (("median", 0.5), ("p95", 0.95), ("p99", 0.99), ("tau", 0.95)):
            assert off_by(counts, got[w][name], share) <= 2 * summaries.rank_error(size), (w, name)
    fleet = summaries.summary_quantiles(summaries.merged(made, size=size)).first()
    assert fleet.n == whole.sum() and off_by(whole, fleet.tau, 0.95) <= 2 * summaries.rank_error(size)
    assert made.select(F.max(F.length("sketch"))).first()[0] < 40 * size


def test_few_pairs_are_kept_exactly(spark):
    made = summaries.far_summary(cells(spark, {0: [3, 0, 46], 1: [0, 100]}))
    got = {r.walk_id: (r.n, r.median, r.tau) for r in summaries.summary_quantiles(made).collect()}
    assert got == {0: (49, 0.0002, None), 1: (100, 0.0001, 0.0001)}
    all_of = summaries.summary_quantiles(summaries.merged(made), Calib(false_merge_pct=2.0)).first()
    assert (all_of.n, all_of.median, all_of.tau) == (149, 0.0001, 0.0002)


def test_no_pairs_give_no_summary(spark):
    none = summaries.far_summary(cells(spark, {0: [1]}).limit(0))
    assert none.count() == 0 and summaries.merged(none).count() == 0 and summaries.merged(none, ("walk_id",)).count() == 0


def test_later_faces_join_a_stored_summary(spark):
    """What was stored and the pairs that later faces bring are together all pairs, in any number of blocks."""
    faces = walk(spark, 3)[3].unionByName(walk(spark, 4, n=70, copies=40, walk_id=1)[3]).cache()
    later = F.col("face_idx") >= 60
    for size in (16, 8192):
        total = pairs.far_histogram(faces, 5.0, size)
        old, new = pairs.far_histogram(faces.filter(~later), 5.0, size), pairs.far_histogram(faces, 5.0, size, later)
        sums = lambda *hs: sorted(map(tuple, reduce(lambda a, b: a.unionByName(b), hs).groupBy("walk_id", "yaw", "bin").agg(F.sum("pairs")).collect()))
        assert sums(old, new) == sums(total) and new.count()
        stored = summaries.far_summary(old)
        grown = summaries.summary_quantiles(summaries.with_later(stored, summaries.far_summary(new))).collect()
        assert sorted(grown) == sorted(summaries.summary_quantiles(summaries.far_summary(total)).collect())
    exact = {r.walk_id: r for r in calibration.far_quantiles(faces, pairs.far_histogram(faces, 5.0)).collect()}
    for r in grown:
        assert r.n == exact[r.walk_id].n and r.max == pytest.approx(exact[r.walk_id].max) and r.tau == pytest.approx(exact[r.walk_id].tau, abs=0.02)
