"""Nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables cuts the (unit) vectors' projections on PROJECTIONS Gaussian
directions into cells of width CELL; a vector's cells name its bucket. A query visits
buckets by the estimated success of looking at one of their vectors, the chance that a
neighbour at cosine NEAR lies there over the chance that any vector does: given the
query's projection p, the neighbour's is normal around NEAR * p with variance
1 - NEAR^2, any vector's is standard normal. Buckets are visited from the most
promising on until the neighbour's chances sum up to MASS.
The candidates of all tables are ranked by their exact cosine. A query that has met
fewer than k vectors then visits all buckets of one table.

Vectors that are null, zero or hold null or non-finite components take no part, nor
do rows without vec_id; vectors of other lengths are never compared. Rows with a
query's own vec_id are not its candidates; a repeated vec_id is found once, by its best
vector, and asks with its smallest. Equal cosines go to the smaller vec_id. Empty
tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from walksieve.llm.common import documents
from walksieve.session import written

TABLES = 3
PROJECTIONS = 8
CELL = 2.6
NEAR = 0.36
MASS = 0.65
CHUNK = 4096            # vectors compared in one call
LEAST = 1e-3            # cells of a projection with a smaller chance are not visited
_BASE = 64              # cells per projection in a bucket's name


def directions(table: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (dim, PROJECTIONS) and offsets of a table."""
    pick = np.random.default_rng([97, table, dim])
    return pick.normal(size=(dim, PROJECTIONS)), pick.uniform(0, CELL, PROJECTIONS)


def _named(cells: np.ndarray) -> np.ndarray:
    """Bucket names of integer cells (..., PROJECTIONS)."""
    return np.clip(cells + _BASE // 2, 0, _BASE - 1).astype(np.int64) @ (_BASE ** np.arange(PROJECTIONS, dtype=np.int64))


def buckets(unit: np.ndarray, table: int) -> np.ndarray:
    a, b = directions(table, unit.shape[1])
    return _named(np.floor((unit @ a + b) / CELL).astype(np.int64))


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function (Abramowitz and Stegun 7.1.26)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x >= 0, 1 - tail / 2, tail / 2)


def probes(query: np.ndarray, table: int, mass: float = MASS) -> np.ndarray:
    """Buckets that a unit query visits, its own included."""
    a, b = directions(table, len(query))
    p = query @ a
    chance, gain, name = np.ones(1), np.ones(1), np.zeros(1, dtype=np.int64)
    sigma = math.sqrt(1 - NEAR * NEAR)
    for m in range(PROJECTIONS):
        mid = math.floor((NEAR * p[m] + b[m]) / CELL)
        cells = np.arange(mid - 3, mid + 4)
        edge = np.append(cells, mid + 4) * CELL - b[m]
        share, usual = np.diff(_normal((edge - NEAR * p[m]) / sigma)), np.diff(_normal(edge))
        some = share > LEAST
        cells, share, usual = cells[some], share[some], np.maximum(usual[some], 1e-12)
        chance = np.outer(chance, share).ravel()
        gain = np.outer(gain, share / usual).ravel()
        name = (name[:, None] + np.clip(cells + _BASE // 2, 0, _BASE - 1) * _BASE**m).ravel()
        keep = chance > LEAST * LEAST
        chance, gain, name = chance[keep], gain[keep], name[keep]
    order = np.argsort(-gain, kind="stable")
    upto = int(np.searchsorted(np.cumsum(chance[order]), mass)) + 1
    own = buckets(query[None, :], table)
    return np.unique(np.append(name[order][:upto], own))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, dim of the rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = documents(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine)
    return named.where(F.exists("embedding", lambda x: x != 0)).select("vec_id", F.col("embedding").alias("v"), F.size("embedding").alias("dim"))


def _hashed(batches):
    import pandas as pd

    for batch in batches:
        for dim, rows in batch.groupby("dim"):
            unit = _units(_matrix(rows["v"]))
            yield pd.concat([rows.assign(tab=t, bucket=buckets(unit, t)) for t in range(TABLES)])[["vec_id", "v", "dim", "tab", "bucket"]]


def _probing(batches):
    import pandas as pd

    for batch in batches:
        for dim, rows in batch.groupby("dim"):
            unit = _units(_matrix(rows["v"]))
            found = [(q, dim, t, probes(u, t)) for q, u in zip(rows["vec_id"], unit) for t in range(TABLES)]
            yield pd.DataFrame(found, columns=["query_id", "dim", "tab", "buckets"])


def _searcher(k: int):
    wide = 4 * k + 4

    def search(key, queries, vectors):
        """The nearest of one bundle's buckets to each query that visits them."""
        import pandas as pd

        out = []
        if len(queries) and len(vectors):
            vectors = vectors.sort_values(["tab", "bucket", "vec_id"], kind="stable")
            ids, v = vectors["vec_id"].to_numpy(), _matrix(vectors["v"])
            unit = _units(v)
            names, begin = np.unique(vectors["bucket"].to_numpy(), return_index=True)
            end = np.append(begin[1:], len(ids))
            first = np.append(True, (ids[1:] != ids[:-1]) | (vectors["bucket"].to_numpy()[1:] != vectors["bucket"].to_numpy()[:-1]))
            asker, q = queries["query_id"].to_numpy(), _matrix(queries["v"])
            q_unit = _units(q)
            visits = [names if b is None else np.intersect1d(names, b) for b in queries["buckets"]]
            of = np.repeat(np.arange(len(asker)), [len(x) for x in visits])
            where = np.searchsorted(names, np.concatenate(visits))
            order = np.argsort(where, kind="stable")
            of, where = of[order], where[order]
            for at, upto in zip(*(np.searchsorted(where, range(len(names)), side) for side in ("left", "right"))):
                if at == upto:
                    continue
                lo, hi = begin[where[at]], end[where[at]]
                for some in range(at, upto, 512):
                    rows = of[some:min(some + 512, upto)]
                    rough = np.round(q_unit[rows] @ unit[lo:hi].T, 12)
                    rough[asker[rows][:, None] == ids[None, lo:hi]] = -2
                    # a vec_id takes one place, however many vectors it has here
                    starts = np.flatnonzero(first[lo:hi])
                    sizes = np.diff(np.append(starts, hi - lo))
                    by_id = np.maximum.reduceat(rough, starts, axis=1)
                    best = np.argsort(-by_id, axis=1, kind="stable")[:, :wide]
                    near = starts[best]
                    for several in np.unique(best[sizes[best] > 1]):
                        at_row, at_place = np.nonzero(best == several)
                        s = starts[several]
                        near[at_row, at_place] = s + np.argmax(rough[at_row, s:s + sizes[several]], axis=1)
                    fine = (np.take_along_axis(by_id, best, axis=1) > -2).ravel()
                    out.append(np.stack((np.repeat(rows, best.shape[1])[fine], near.ravel()[fine] + lo)))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        row, near = np.concatenate(out, axis=1)
        score = (q[row] * v[near]).sum(axis=1) / (np.sqrt((q * q).sum(axis=1))[row] * np.sqrt((v * v).sum(axis=1))[near])
        order = np.lexsort((-score, ids[near], row))
        row, near, score = row[order], near[order], score[order]
        other = np.ones(len(row), dtype=bool)
        other[1:] = (row[1:] != row[:-1]) | (ids[near][1:] != ids[near][:-1])
        row, near, score = row[other], near[other], score[other]
        order = np.lexsort((ids[near], -score, row))
        row, near, score = row[order], near[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < wide
        return pd.DataFrame({"query_id": asker[row], "vec_id": ids[near], "score": score})[keep]

    return search


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by cosine.

    `is_query` is a condition on vec_id; all usable rows are candidates.
    """
    rows = written(usable(vectors).distinct(), "vectors")
    bundles = 1 + rows.count() // CHUNK
    asking = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("s")).select("vec_id", "s.v", "s.dim")
    asking = written(asking, "queries")
    index = written(rows.mapInPandas(_hashed, "vec_id long, v array<float>, dim int, tab int, bucket long") if dict(rows.dtypes)["v"] == "array<float>"
                    else rows.mapInPandas(_hashed, "vec_id long, v array<double>, dim int, tab int, bucket long"), "hashed")
    place = ["dim", "tab", "bucket"]
    hot = written(index.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(*place, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "hot-buckets")
    chunk = F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.coalesce("chunks", F.lit(1))).cast("int")

    def bundle(chunk_column):
        spread = F.pmod(F.xxhash64("bucket", chunk_column), F.lit(bundles))
        return F.concat_ws("/", "dim", "tab", spread)

    laid = index.join(hot, place, "left").withColumn("chunk", chunk).select("vec_id", "v", "tab", "bucket", bundle(F.col("chunk")).alias("bundle"))
    # as many tasks as there are bundles, however few files the queries are in
    visits = asking.repartition(bundles, "vec_id").mapInPandas(_probing, "query_id long, dim int, tab int, buckets array<bigint>").select("query_id", "dim", "tab", F.explode("buckets").alias("bucket"))
    visits = visits.join(hot, place, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    visits = visits.groupBy("query_id", bundle(F.col("chunk")).alias("bundle")).agg(F.collect_set("bucket").alias("buckets"))
    visits = visits.join(asking.select(F.col("vec_id").alias("query_id"), "v"), "query_id")

    def found(visits, laid):
        pairs = visits.groupBy("bundle").cogroup(laid.groupBy("bundle")).applyInPandas(_searcher(k), "query_id long, vec_id long, score double")
        return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    first = written(found(visits, laid), "neighbours")
    short = asking.join(first.groupBy("query_id").agg(F.count("*").alias("n")).select(F.col("query_id").alias("vec_id"), "n"), "vec_id", "left")
    short = written(short.where(F.coalesce("n", F.lit(0)) < k).select(F.col("vec_id").alias("query_id"), "dim", "v"), "short-queries")
    if not short.isEmpty():
        everywhere = short.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
        everywhere = everywhere.select("query_id", F.concat_ws("/", "dim", F.lit(0), "bundle").alias("bundle"), F.lit(None).cast("array<bigint>").alias("buckets"), "v")
        first = first.unionByName(found(everywhere, laid.where("tab = 0"))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
