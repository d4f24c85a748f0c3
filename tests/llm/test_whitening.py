import numpy as np
import pytest

from walksieve.llm import whitening


def plain(vectors):
    x = np.floor(np.array(vectors, dtype=np.float64) * 1024).astype(object).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, np.square(n * x - sums).sum(axis=1), centred, e[::-1], v[:, ::-1].T


def table(spark, vectors, ids=None):
    rows = [(i, v, "x", 1) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, n int").repartition(4)


def agrees(spark, vectors, most=8):
    vectors = [[float(np.float32(c)) for c in v] for v in vectors]
    found = {r["vec_id"]: r for r in whitening.whitened(table(spark, vectors), most).collect()}
    n, deviation, centred, e, components = plain(vectors)
    some = found[0]["whitened"]
    assert len(found) == n and all(r["n"] == n and int(r["deviation"]) == int(deviation[i]) for i, r in found.items())
    z = np.array([found[i]["whitened"] for i in range(n)])
    for k in range(len(some)):
        want = centred @ components[k] / np.sqrt(e[k])
        assert np.abs(z[:, k] - np.sign(want @ z[:, k]) * want).max() < 1e-8
        assert found[0]["explained"][k] == pytest.approx(e[k] / e.sum(), rel=1e-10)
    assert found[0]["identity_error"] < 1e-9
    return len(some)


def test_random_vectors(spark):
    pick = np.random.default_rng(1)
    assert agrees(spark, pick.normal(size=(300, 12)) * np.linspace(0.3, 2, 12)) == 8


def test_falling_deviations_end_early(spark):
    pick = np.random.default_rng(2)
    vectors = pick.normal(size=(400, 24)) * 3.0 ** -np.arange(24)
    rows = whitening.whole_vectors(table(spark, vectors.tolist()))
    fitted = whitening.fit(rows, 3)
    assert fitted.steps < 24
    e, v = plain(vectors.astype(np.float32))[3:]
    assert np.allclose(fitted.variances, e[:3], rtol=1e-12) and np.allclose(np.abs((fitted.components * v[:3]).sum(axis=1)), 1, atol=1e-13)


def test_fewer_directions_than_wanted(spark):
    pick = np.random.default_rng(3)
    assert agrees(spark, pick.normal(size=(4, 10))) == 3                                # three differences
    flat = np.zeros((60, 6))
    flat[:, 2], flat[:, 4] = pick.normal(size=60), pick.normal(size=60) * 3
    assert agrees(spark, flat) == 2


def test_equal_deviations(spark):
    """Two equal deviations: any basis of their plane, still white."""
    vectors = [[x, y, z / 8] for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)]
    rows = whitening.whitened(table(spark, vectors)).collect()
    z = np.array([r["whitened"] for r in rows])
    assert z.shape == (8, 3) and np.abs(z.T @ z / 8 - np.eye(3)).max() < 1e-12


def test_equal_rows_and_one_row(spark):
    for vectors in ([[0.5, 0.25]] * 30, [[1.0, 2.0, 3.0]]):
        rows = whitening.whitened(table(spark, vectors)).collect()
        assert len(rows) == len(vectors) and all(r["whitened"] == [] and r["deviation"] == 0 for r in rows)
        assert whitening.by_component(whitening.whitened(table(spark, vectors))).count() == 0


def test_odd_rows(spark):
    vectors = [[1.0, 2.0], None, [float("nan"), 1.0], [float("inf"), 0.0], [None, 1.0], [], [3.0, 1.0, 2.0], [0.5, -4.0], [2.0, 2.0], [1e30, 0.0], [2.0, 2.0]]
    rows = whitening.whitened(table(spark, vectors, [*range(9), 9, None])).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in rows) == [(False, 0), (False, 7), (False, 8), (True, None)]
    assert {tuple(r["whitened"]) for r in rows if r["vec_id"] in (8, None)} == {tuple(next(r for r in rows if r["vec_id"] == 8)["whitened"])}
    assert whitening.by_component(whitening.whitened(table(spark, []).where("false"))).collect() == []


def test_large_deviations_are_exact(spark):
    vectors = [[float(2**19), -float(2**19)]] * 2 + [[-float(2**19), float(2**19)]] * 40_000
    found = whitening.whitened(table(spark, vectors), 2).where("vec_id < 3").collect()
    n, deviation = plain(vectors)[:2]
    exact = [sum((n * a - s) ** 2 for a, s in zip(x, S)) for x, S in [
        ([int(c * 1024) + 100_000 for c in v], [sum(int(w[k] * 1024) + 100_000 for w in vectors) for k in (0, 1)]) for v in vectors[:3]]]
    assert {int(r["vec_id"]): int(r["deviation"]) for r in found} == dict(enumerate(exact)) and max(exact) > 2**63
