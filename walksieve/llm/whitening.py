"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers x = floor(SCALE * c) + SHIFT. X is the matrix of the rows'
x less their mean. Starting from one direction v, the method alternates u = X v and
v = X'u, orthogonalises each new u and v fully against all earlier ones, and so builds
orthonormal U and V with X V = U B for a small upper bidiagonal B. The singular values of B
give the deviations along the components, V and its right singular vectors the components.

Rows stay where they are: a step is one map over them. A task computes its part of X w and
at once that of X'(X w); only the second, as long as a vector, is summed up. The left
vectors are never stored, since each is X w for a short w that the driver keeps, and their
products follow from what the steps summed: (X w)'(X z) = w'(X'X z). Where the space that
was started is used up, the method goes on from another direction. It ends when the wanted
components are exact to double precision, after as many steps as there are dimensions
at most. A lost executor repeats a part of one step.

Rows whose vector is null or holds null or non-finite entries are left out, as are vectors
with entries of 2^20 or more (64-bit sums would not hold them), vectors
of another length than the most frequent one (the longest, if several are) and rows
without entries. Repeated rows count as often as they occur; equal vectors get equal
results; a row without vec_id is whitened like others. Directions without deviation
(RANK of the first) give no component, so equal rows give none. An empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walksieve.llm.common import documents
from walksieve.session import written

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**20
RANK = 1e-12            # variance of a component over the first one's, at least
EXACT = 1e-15           # of the first deviation: what may be left of a component outside the space
STRIP = 8192            # rows of a product held at once


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray            # per dimension, of x
    components: np.ndarray      # (components, dimensions), of unit length
    variances: np.ndarray
    trace: float
    steps: int


def whole_vectors(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x (whole numbers) of the rows that take part, as a written table."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    named = documents(vectors, "vec_id", "embedding").where("size(embedding) > 0").where(fine)
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    rows = written(named.select("vec_id", x.alias("x")), "whole-vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == usual[0]["d"]) if usual else rows


def _matrix(column) -> np.ndarray:
    """A list column without nulls as an (n, d) matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less its mean; the numerator is exact."""
    return (n * x - sums) / n


def _summed(rows: DataFrame, part, kind: str) -> np.ndarray:
    """The sum over all rows of `part(x)`, a vector per strip of rows; one row per task and entry moves."""
    dtype = np.int64 if kind == "long" else np.float64

    def sums(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                more = part(_matrix(batch.column(0).slice(at, STRIP)))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(dtype))], names=["at", "s"])

    found = rows.select("x").mapInArrow(sums, f"at long, s {kind}").groupBy("at").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(len(found), dtype=dtype)
    out[found["at"].to_numpy(np.int64)] = found["s"].to_numpy(dtype)
    return out


def _apart(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """`v` without what lies along an orthonormal basis; twice, as once is not exact."""
    for _ in range(2 if basis else 0):
        known = np.stack(basis)
        v = v - known.T @ (known @ v)
    return v


class _Steps:
    """The growing factorisation X V = U B, with U = X W."""

    def __init__(self, product, d: int):
        self.product, self.d = product, d       # product: w to X'X w, summed over all rows
        self.right: list[np.ndarray] = []       # V
        self.short: list[np.ndarray] = []       # W
        self.back: list[np.ndarray] = []        # X'u
        self.alpha: list[float] = []
        self.beta: list[float] = []             # what links each u to the next v
        self.pick = np.random.default_rng(12)

    def _fresh(self) -> np.ndarray:
        v = _apart(self.pick.normal(size=self.d), self.right)
        return v / np.sqrt(v @ v)

    def step(self) -> bool:
        """One more u and v; False when no direction with deviation is left."""
        v = self.pending if self.right else self._fresh()
        w = v - self.beta[-1] * self.short[-1] if self.right else v
        self.right.append(v)
        # u = X w, less its parts along the earlier left vectors: its products with them are W'X'u
        for _ in range(3):
            back = self.product(w)
            if not self.short:
                break
            along = np.stack(self.short) @ back
            w = w - along @ np.stack(self.short)
            back = back - along @ np.stack(self.back)
            if along @ along <= 1e-12 * abs(w @ back):
                break
        square = float(w @ back)
        top = max([*self.alpha, square ** 0.5 if square > 0 else 0.0])
        if square <= RANK / 100 * top * top:
            self.alpha.append(0.0)
            self.short.append(np.zeros(self.d))
            self.back.append(np.zeros(self.d))
        else:
            alpha = square ** 0.5
            self.alpha.append(alpha)
            self.short.append(w / alpha)
            self.back.append(back / alpha)
        left = _apart(self.back[-1] - self.alpha[-1] * v, self.right)
        length = float(np.sqrt(left @ left))
        done = len(self.right) == self.d
        if done or length <= EXACT * max(top, 1e-300):
            self.beta.append(0.0)
            self.pending = None if done else self._fresh()
        else:
            self.beta.append(length)
            self.pending = left / length
        return not done

    def solved(self):
        """Deviations (falling), components, and how far each is from exact."""
        k = len(self.right)
        b = np.diag(self.alpha) + np.diag(self.beta[:-1], 1)
        left, deviations, right = np.linalg.svd(b)
        return deviations, right @ np.stack(self.right), self.beta[-1] * np.abs(left[k - 1])


def fit(rows: DataFrame, wanted: int = 8) -> Whitening | None:
    """Mean, components and deviations of the vectors in `rows` (vec_id, x)."""
    n = rows.count()
    if not n:
        return None
    sums = _summed(rows, lambda x: x.sum(axis=0), "long")
    d = len(sums)
    trace = float(_summed(rows, lambda x: np.array([np.square(_centred(x, n, sums)).sum()]), "double")[0]) / n

    def product(w):
        def part(x):
            c = _centred(x, n, sums)
            return c.T @ (c @ w)
        return _summed(rows, part, "double")

    steps = _Steps(product, d)
    if trace == 0:
        return Whitening(n, sums, np.empty((0, d)), np.empty(0), 0.0, 0)
    while steps.step():
        if len(steps.right) >= min(d, wanted + 2):
            deviations, _, off = steps.solved()
            # a space that ends by itself may miss a copy of a repeated deviation, so it goes on
            if all(steps.beta) and (off[:wanted] <= EXACT * deviations[0]).all():
                break
        if np.square(steps.alpha + steps.beta[:-1]).sum() >= (1 - 1e-13) * trace * n:
            break                               # no deviation is left outside
    deviations, components, _ = steps.solved()
    variances = deviations * deviations / n
    some = int((variances[:wanted] > RANK * variances[0]).sum())
    return Whitening(n, sums, components[:some], variances[:some], trace, len(steps.right))


def _whitened(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    return _centred(x, fitted.n, fitted.sums) @ fitted.components.T / np.sqrt(fitted.variances)


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(fitted.variances)
    if not k:
        return 0.0

    def part(x):
        z = _whitened(x, fitted)
        return np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))

    sums = _summed(rows, part, "double") / fitted.n
    return float(np.abs(sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k]) - np.eye(k)).max())


def whitened(vectors: DataFrame, wanted: int = 8) -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array), identity_error of every row that takes part.

    `deviation` is exact, hence decimal(38,0): the sum over dimensions of (n * x - S)^2.
    """
    rows = whole_vectors(vectors)
    fitted = fit(rows, wanted)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, n long, deviation string, whitened array<double>, explained array<double>, identity_error double"
    if fitted is None:
        made = rows.sparkSession.createDataFrame([], schema)
        return made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    error = identity_error(rows, fitted)
    explained = (fitted.variances / fitted.trace).tolist() if fitted.trace else []

    def make(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                ids, x = batch.column(0).slice(at, STRIP), _matrix(batch.column(1).slice(at, STRIP))
                off = fitted.n * x - fitted.sums
                if float(np.abs(off).max()) ** 2 * off.shape[1] < 2.0**62:
                    deviation = np.square(off).sum(axis=1).tolist()
                else:                           # beyond 64 bits
                    deviation = np.square(off.astype(object)).sum(axis=1).tolist()
                z = _whitened(x, fitted)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1], pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.full(len(x), fitted.n)), pa.array([str(v) for v in deviation]), lists,
                    pa.array([explained] * len(x), pa.list_(pa.float64())), pa.array(np.full(len(x), error))],
                    names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(make, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def by_component(table: DataFrame) -> DataFrame:
    """One row per vector and component; components are numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c")
    return table.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each).select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error")
