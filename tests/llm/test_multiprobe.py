import numpy as np
import pytest
from pyspark.sql import functions as F

from walksieve.llm import multiprobe, queries

from .conftest import SF


def plain(rows, k=5, step=50):
    """Brute force over usable (vec_id, vector) rows."""
    fine = [(i, np.array(v, dtype=np.float64)) for i, v in rows
            if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    ids, x = np.array([i for i, _ in fine]), np.stack([v for _, v in fine])
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for a in np.flatnonzero(ids % step == 0):
        c = (x * x[a]).sum(axis=1) / (norm * norm[a])
        c[ids == ids[a]] = -2
        order = [j for j in np.lexsort((ids, -c)) if c[j] > -2][:k]
        out[int(ids[a])] = [(int(ids[j]), float(c[j])) for j in order]
    return out


def recall(got, want):
    found = {(r.query_id, r.vec_id): r.score for r in got}
    pairs = {(q, v): s for q, near in want.items() for v, s in near}
    assert all(abs(found[p] - s) < 1e-12 for p, s in pairs.items() if p in found)
    return len(found.keys() & pairs.keys()) / max(1, len(pairs))


def test_query_recall(spark, given):
    got = queries.op7_multiprobe(spark, SF).collect()
    want = plain([(r.vec_id, r.embedding) for r in given("embeddings").collect()])
    assert {r.query_id for r in got} == want.keys() and recall(got, want) >= 0.9
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [(r.score, -r.vec_id) for r in mine] == sorted(((r.score, -r.vec_id) for r in mine), reverse=True)


@pytest.mark.parametrize("chunk", [64, 4096])
def test_recall_with_a_large_group_of_near_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(multiprobe, "CHUNK", chunk)
    pick = np.random.default_rng(2)
    x = pick.normal(size=(3000, 24))
    x[1000:2000] = x[0] + 0.05 * pick.normal(size=(1000, 24))
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket string").repartition(5)
    got = multiprobe.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert recall(got, plain([r[:2] for r in rows])) >= 0.9


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (50, [3.0, 4.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (9, [4.0, 0.0]), (10, [5.0, 0.0]), (11, [6.0, 0.0]), (12, [7.0, 0.0]), (12, [7.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(multiprobe.nearest(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 9, 10, 11] and got[50] == [0, 1, 2, 9, 10] and 100 not in got


def test_fewer_vectors_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, -1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in multiprobe.nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert multiprobe.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert multiprobe.nearest(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("chunk", [64, 4096])
def test_a_repeated_id_takes_one_place(spark, monkeypatch, chunk):
    monkeypatch.setattr(multiprobe, "CHUNK", chunk)
    pick = np.random.default_rng(4)
    x = pick.normal(size=(40, 8))
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())]
    # id 41 is near the query in 200 different vectors, id 42 in 100 equal ones
    rows += [(41, (x[0] + 0.01 * pick.normal(size=8)).tolist()) for _ in range(200)] + [(42, (x[0] * 1.5 + 0.01).tolist())] * 100
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = multiprobe.nearest(df, F.col("vec_id") == 0).collect()
    ids = [r.vec_id for r in sorted(got, key=lambda r: r.rank)]
    assert len(ids) == len(set(ids)) == 5 and {1, 41, 42} <= set(ids)
    assert recall(got, {0: distinct(rows, 0)}) >= (1 if chunk == 4096 else 0.6)


def distinct(rows, query, k=5):
    """The query's nearest ids, each by its best vector."""
    a, best = np.array(next(v for i, v in rows if i == query)), {}
    for i, v in rows:
        if i != query:
            c = float(np.dot(a, v) / (np.linalg.norm(a) * np.linalg.norm(v)))
            best[i] = max(best.get(i, -2), c)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
