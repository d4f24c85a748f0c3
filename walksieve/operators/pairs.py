"""Products between the faces of a walk, block by block.

A walk is cut into blocks of consecutive faces. Two blocks meet in one task,
which takes their matrix product and hands back summaries only: histogram
cells, counts or the best match of a face. No pair leaves its task, so the
output grows with the faces and not with the pairs, and a long walk turns into
many tasks of equal size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walksieve.functions.vectors import matrix, numbers
from walksieve.operators.regions import laid_out, meeting, near_parts
from walksieve.session import written

BLOCK = 8192      # faces per block
STRIP = 512       # rows of a product held at once
BINS = 10_000     # cosine cells per unit: cells are the 4-decimal values


def met_blocks(faces: DataFrame, keys: list[str], size: int = BLOCK,
               index: str = "face_idx") -> DataFrame:
    """Copies of the rows so that each pair of blocks of a group shares (_pa, _pb).

    `_b` is a row's own block. Blocks follow `index`, unique in a walk and
    dense, so none exceeds `size` rows. Where no walk is longer than a block,
    which one look at `index` tells, every group meets itself and nothing is
    joined or copied.
    """
    own = faces.withColumn("_b", F.floor(F.col(index) / size).cast("int"))
    longer = faces.filter(F.col(index) >= size)
    if longer.isEmpty():
        return own.withColumn("_pa", F.lit(0)).withColumn("_pb", F.lit(0))
    last = written(longer.groupBy(*keys).agg(
        F.floor(F.max(index) / size).cast("int").alias("_last")), "last-blocks")
    return (own.join(last, keys, "left")
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0)))))
            .withColumn("_pa", F.least("_b", "_o")).withColumn("_pb", F.greatest("_b", "_o"))
            .drop("_o", "_last"))


def near_blocks(faces: DataFrame, tau: str, size: int = BLOCK) -> DataFrame:
    """As :func:`met_blocks` for the pairs whose cosine reaches the column `tau`.

    Faces of longer walks are laid out by likeness first, and blocks that hold no such
    pair do not meet. `faces` ends with the embedding.
    """
    longer = faces.filter(F.col("face_idx") >= size)
    alone = lambda df: df.withColumns({"_b": F.lit(0), "_pa": F.lit(0), "_pb": F.lit(0)})
    if longer.isEmpty():
        return alone(faces)
    long_walks = written(longer.select("walk_id").distinct(), "long-walks")
    laid = laid_out(faces.join(long_walks, "walk_id", "left_semi").select(*faces.columns), size)
    met = meeting(laid, *near_parts(laid, F.col(tau), size))
    return alone(faces.join(long_walks, "walk_id", "left_anti")).unionByName(met.drop("block", "pos", "angles"))


def _strips(key, table: pa.Table):
    """Yields (rows, cols, product): index arrays into `table` and their cosines.

    Inside one block a pair is seen once; across blocks every left-right pair is.
    """
    block = numbers(table["_b"])
    left = np.flatnonzero(block == key[-2].as_py())
    right = np.flatnonzero(block == key[-1].as_py())
    if not len(left) or not len(right):
        return
    v = matrix(table["embedding"])
    same = key[-2].as_py() == key[-1].as_py()
    for at in range(0, len(left), STRIP):
        rows = left[at:at + STRIP]
        cols = right[at:] if same else right
        yield rows, cols, v[rows] @ v[cols].T, same


def _apart(table: pa.Table, rows, cols, same: bool, far_seconds: float) -> np.ndarray:
    """Which cells of a strip are far pairs."""
    t = numbers(table["t_sec"])
    apart = np.abs(t[rows][:, None] - t[cols][None, :]) > far_seconds
    if "_later" in table.column_names:
        later = numbers(table["_later"]).astype(bool)
        apart &= later[rows][:, None] | later[cols][None, :]
    return np.triu(apart, k=1) if same else apart


def _slim(faces: DataFrame, *more: Column) -> DataFrame:
    return faces.select("walk_id", F.col("yaw").cast("int").alias("yaw"), "face_idx",
                        F.col("t_sec").cast("double").alias("t_sec"), *more, "embedding")


class _Cells:
    """Counts, lowest and highest value of numbered cells, gathered strip by strip."""

    def __init__(self, size: int, place):
        self.place, self.count = place, np.zeros(size, np.int64)
        self.low, self.high = np.full(size, np.inf), np.full(size, -np.inf)

    def add(self, value: np.ndarray) -> None:
        if not len(value):
            return
        cell = self.place(value)
        self.count += np.bincount(cell, minlength=len(self.count))
        np.minimum.at(self.low, cell, value)
        np.maximum.at(self.high, cell, value)

    def table(self, **named: tuple) -> pa.Table:
        """The cells in use; `named` are columns of one value each, as (value, type)."""
        used = np.flatnonzero(self.count)
        return pa.table({
            **{n: pa.array([v] * len(used), t) for n, (v, t) in named.items()},
            "cell": pa.array(used), "pairs": pa.array(self.count[used]),
            "low": pa.array(self.low[used]), "high": pa.array(self.high[used])})


_MIDDLE = int(BINS * 1.02)      # room for rounding on either side of 1
_SUM_CELLS = (F.sum, "pairs"), (F.min, "low"), (F.max, "high")


def far_histogram(faces: DataFrame, far_seconds: float, size: int = BLOCK,
                  later: Column | None = None) -> DataFrame:
    """Far pairs counted by heading and 4-decimal cosine.

    A far pair is two faces of one heading more than `far_seconds` apart. `bin`
    is the rounded cosine times 10 000, so a walk has at most 20 001 of them;
    `low` and `high` are the extreme cosines in it. Columns: walk_id, yaw, bin,
    pairs, low, high. Given `later`, only pairs with a face where it is true are counted.
    """
    def place(value):
        if max(-value.min(), value.max()) > 1.01:
            raise ValueError("cosine over 1: the vectors are not of unit length")
        return np.rint(value * BINS).astype(np.int64) + _MIDDLE

    def count(key, table):
        cells = _Cells(2 * _MIDDLE + 1, place)
        some = "_later" not in table.column_names or numbers(table["_later"]).any()
        for rows, cols, cos, same in _strips(key, table) if some else ():
            cells.add(cos[_apart(table, rows, cols, same, far_seconds)])
        return cells.table(walk_id=(key[0].as_py(), table.schema.field("walk_id").type),
                           yaw=(key[1].as_py(), pa.int32()))

    walk_type = faces.schema["walk_id"].dataType.simpleString()
    marks = () if later is None else (F.coalesce(later, F.lit(False)).cast("int").alias("_later"),)
    return (met_blocks(_slim(faces, *marks), ["walk_id", "yaw"], size)
            .drop("face_idx").groupBy("walk_id", "yaw", "_pa", "_pb")
            .applyInArrow(count, f"walk_id {walk_type}, yaw int, cell long, pairs long, "
                                 "low double, high double")
            .withColumn("bin", F.col("cell") - _MIDDLE)
            .groupBy("walk_id", "yaw", "bin").agg(*[f(c).alias(c) for f, c in _SUM_CELLS]))


SPLIT = 4096      # cells that one range is cut into


def far_cells(faces: DataFrame, ranges: DataFrame, far_seconds: float,
              size: int = BLOCK) -> DataFrame:
    """Far pairs inside a few narrow ranges of cosine, counted in finer cells.

    `ranges`: walk_id and `ranges`, a short array of (i, low, high), both ends
    inside. Columns: walk_id, i, cell, pairs, low, high.
    """
    def count(key, table):
        wanted = table["ranges"][0].as_py()
        places = [lambda v, r=r: np.minimum(
            (v - r["low"]) / (r["high"] - r["low"]) * SPLIT, SPLIT - 1).astype(np.int64) for r in wanted]
        found = [_Cells(SPLIT, place) for place in places]
        for rows, cols, cos, same in _strips(key, table):
            far = cos[_apart(table, rows, cols, same, far_seconds)]
            for r, cells in zip(wanted, found):
                cells.add(far[(far >= r["low"]) & (far <= r["high"])])
        return pa.concat_tables([
            c.table(walk_id=(key[0].as_py(), table.schema.field("walk_id").type), i=(r["i"], pa.int32()))
            for r, c in zip(wanted, found)])

    walk_type = faces.schema["walk_id"].dataType.simpleString()
    asked = _slim(faces).join(ranges.select("walk_id", "ranges"), "walk_id")
    return (met_blocks(asked, ["walk_id", "yaw"], size)
            .drop("face_idx").groupBy("walk_id", "yaw", "_pa", "_pb")
            .applyInArrow(count, f"walk_id {walk_type}, i int, cell long, pairs long, "
                                 "low double, high double")
            .groupBy("walk_id", "i", "cell").agg(*[f(c).alias(c) for f, c in _SUM_CELLS]))


def similar_neighbours(faces: DataFrame, tau: float | Column, size: int = BLOCK) -> DataFrame:
    """Per face: how many faces of other panoramas reach `tau`, and the closest one.

    Summarises the similarity edges of a walk without listing them; ties go to
    the lower face index. Faces without such a neighbour are left out.
    """
    level = F.lit(float(tau)) if isinstance(tau, (int, float)) else tau

    def meet(key, table):
        # in order of face index, the first best is the one with the lowest index
        table = table.take(pa.array(np.argsort(numbers(table["face_idx"]), kind="stable")))
        face, pano = numbers(table["face_idx"]).astype(np.int64), numbers(table["pano_idx"])
        cut = table["tau"][0].as_py()
        n = len(face)
        degree, best, who = np.zeros(n, np.int64), np.full(n, -np.inf), np.full(n, -1, np.int64)

        def fold(me, other, cos):
            degree[me] += (cos >= cut).sum(axis=1)
            j = cos.argmax(axis=1)
            top, name = cos[np.arange(len(me)), j], face[other[j]]
            better = (top > best[me]) | ((top == best[me]) & (name < who[me]))
            best[me] = np.where(better, top, best[me])
            who[me] = np.where(better, name, who[me])

        for rows, cols, cos, same in _strips(key, table):
            cos = np.where(pano[rows][:, None] == pano[cols][None, :], -np.inf, cos)
            fold(rows, cols, cos)
            if not same:
                fold(cols, rows, cos.T)
            elif len(cols) > len(rows):
                # the part right of the diagonal square is the only one not mirrored in it
                fold(cols[len(rows):], rows, cos[:, len(rows):].T)
        hit = degree > 0
        return pa.table({
            "walk_id": pa.array([key[0].as_py()] * int(hit.sum()), table.schema.field("walk_id").type),
            "face_idx": pa.array(face[hit].astype(np.int32)), "neighbours": pa.array(degree[hit]),
            "best_cosine": pa.array(best[hit]), "best_face": pa.array(who[hit].astype(np.int32))})

    walk_type = faces.schema["walk_id"].dataType.simpleString()
    slim = faces.select("walk_id", F.col("face_idx").cast("int").alias("face_idx"),
                        F.col("pano_idx").cast("int").alias("pano_idx"),
                        level.cast("double").alias("tau"), "embedding")
    closest = F.struct("best_cosine", (-F.col("best_face")).alias("_first"))
    return (near_blocks(slim, "tau", size)
            .groupBy("walk_id", "_pa", "_pb")
            .applyInArrow(meet, f"walk_id {walk_type}, face_idx int, neighbours long, "
                                "best_cosine double, best_face int")
            .groupBy("walk_id", "face_idx")
            .agg(F.sum("neighbours").alias("neighbours"),
                 F.max("best_cosine").alias("best_cosine"),
                 F.max_by("best_face", closest).alias("best_face")))
