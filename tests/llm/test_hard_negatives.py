import numpy as np
import pytest
from pyspark.sql import functions as F

from walksieve.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, v string, a int, r int, dim string, square string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA).repartition(4)


def plain(rows, every=3):
    rows = {i: (lab, [int(np.floor(256 * c)) for c in v]) for i, lab, v in rows}
    out = set()
    for a in (i for i in rows if i % every == 0):
        score = {i: sum(x * y for x, y in zip(rows[a][1], v)) for i, (_, v) in rows.items() if i != a and len(v) == len(rows[a][1])}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if rows[i][0] == rows[a][0]][:5]:
            fit = [i for i in best if rows[i][0] != rows[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit[:10], 1)}
    return out


def found(spark, rows, **how):
    got = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 3 == 0, **how).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


@pytest.mark.parametrize("block", [8, 50, 8192])
def test_against_all_pairs(spark, block):
    pick = np.random.default_rng(4)
    rows = [(i, int(pick.integers(4)), (pick.normal(size=9) + 0.6).tolist()) for i in range(160)]
    want = plain(rows)
    assert want and found(spark, rows, block=block) == want


def test_many_primes_and_long_vectors():
    pick = np.random.default_rng(5)
    for size, d in ((3, 1), (300, 700), (2**20, 130)):
        a, b = (pick.integers(-size, size + 1, (n, d)) for n in (7, 11))
        bound = int((np.square(a.astype(float)).sum(1).max() * np.square(b.astype(float)).sum(1).max()) ** 0.5) + 1
        primes = hn.primes_for(bound)
        assert np.prod([float(p) for p in primes]) >= 2 * bound + 1 and len(set(primes)) == len(primes)
        got = hn.scores([hn.residues(a, p) for p in primes], [hn.residues(b, p) for p in primes], primes)
        assert (got == a @ b.T).all()


def test_extreme_scores():
    primes = hn.primes_for(8)
    a = np.array([[2, 2], [-2, -2]])
    assert (hn.scores([hn.residues(a, p) for p in primes], [hn.residues(a, p) for p in primes], primes) == [[8, -8], [-8, 8]]).all()


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, i % 2, [1.0, 0.0]) for i in range(40)] + [(100 + i, 1 - i % 2, [0.5, 0.3]) for i in range(40)]
    assert found(spark, rows, block=16) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, i % 3, [1.0, 0.1 * i]) for i in range(12)]
    other = [(300, 1, [1.0, 2.0, 3.0]), (303, 2, [2.0, 2.0, 2.0]), (304, 1, [2.0, 1.0, 2.0])]
    odd = [(None, 1, [1.0, 1.0]), (30, None, [1.0, 1.0]), (33, 1, None), (36, 1, [nan, 1.0]), (39, 1, [inf, 1.0]), (42, 1, [None, 1.0]), (45, 0, [1e30, 0.0]), (48, 0, [])]
    want = plain(good + other)
    assert want and found(spark, good + other + odd) == want == found(spark, (good + other) * 3 + odd)
    assert found(spark, odd) == set() and hn.hard_negatives(table(spark, []).where("false"), F.lit(True)).collect() == []


def test_negative_and_zero_positives(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [-1.0, 0.0]), (4, 2, [0.0, 1.0]), (5, 2, [0.5, 0.0]), (7, 2, [-0.5, 0.0])]
    assert found(spark, rows) == plain(rows) == {(0, 1, 1, 4, 0, 0)}
