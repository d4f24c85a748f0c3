"""Hard negatives by exact integer scores, in a residue number system.

Components become whole numbers floor(scale * x). Scores are integer inner products,
computed without rounding in float32: the component matrices are reduced modulo several
small primes and multiplied modulo each (sums stay below 2^24, so they are exact), and the
signed scores are put together by the Chinese remainder theorem. As many primes are taken
as the vectors' lengths ask for, since |a.b| <= |a| |b|.

Anchors and rows are laid out in blocks by hash; two blocks meet in one task, which hands
out only each anchor's best. First the blocks give every anchor its best rows of
the same label (positives); then, with those known, its best rows of another label within
the window of each positive's score. What moves between the two is a few rows per anchor and block.

Rows with a null vec_id, label or vector, with null or non-finite components, or with
a squared length of 2^50 or more (their scores need not fit) take no part. Of rows
with one vec_id the smallest (by label, then vector) counts, so repeated rows count once;
vectors of other lengths are never compared. Equal scores go to the smaller
vec_id. Empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walksieve.llm.common import documents
from walksieve.session import written

SCALE = 256
TOO_LONG = 2.0**50
BLOCK = 8192            # rows, and anchors, of one block
STRIP = 2048            # scores of so many rows at once, for 256 anchors
ANCHORS = 256
LARGEST = 1021          # primes from here downwards


def primes_for(bound: int) -> list[int]:
    """The largest primes up to LARGEST whose product tells apart all of -bound..bound."""
    out, product, p = [], 1, LARGEST
    while product < 2 * bound + 1:
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 1
    return out


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """Symmetric residues (from -(p-1)/2 to (p-1)/2) of whole numbers, as float32."""
    r = np.mod(v, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a b' modulo p, from residues; dimensions are taken in slices whose sums float32 holds."""
    width = max(1, 2**24 // (p // 2 + 1) ** 2)
    total = np.zeros((len(a), len(b)), dtype=np.int32)
    for at in range(0, a.shape[1], width):
        total += (a[:, at:at + width] @ b[:, at:at + width].T).astype(np.int32) % p
        if at:
            total %= p
    return total


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed inner products of rows given by their residues (mixed radix, from the first prime on)."""
    value, weight = None, 1
    for x, y, p in zip(a, b, primes):
        r = _product(x, y, p).astype(np.int64)
        if value is None:
            value = r
        else:
            value = value + weight * ((r - value) % p * pow(weight, -1, p) % p)
        weight *= p
    return np.where(value > weight // 2, value - weight, value)


def usable(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole numbers), dim, square (the squared length), one row per vec_id."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = documents(vectors, "vec_id", "label", "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine)
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = rows.select("vec_id", label.cast("long").alias("label"), whole.alias("v"))
    rows = rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).where(F.col("square") < TOO_LONG)
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v", "square")).alias("r")).select("vec_id", "r.*")
    # the squares are below 2^50, so every component fits an int
    return least.select("vec_id", "label", F.col("v").cast("array<int>").alias("v"), F.size("v").alias("dim"), "square")


def _laid(rows: DataFrame, anchors: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors with the cells (dim, a, r) in which their blocks meet."""
    blocks = F.ceil(F.count("*") / block).cast("int")
    sizes = rows.groupBy("dim").agg(blocks.alias("rows_in")).join(anchors.groupBy("dim").agg(blocks.alias("anchors_in")), "dim")
    sizes = written(sizes, "blocks")
    own = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = rows.join(sizes, "dim").withColumn("r", own("rows_in", 1)).withColumn("a", every("anchors_in"))
    a = anchors.join(sizes, "dim").withColumn("a", own("anchors_in", 2)).withColumn("r", every("rows_in"))
    drop = lambda df: df.drop("rows_in", "anchors_in")
    return drop(r), drop(a)


def _met(laid: tuple[DataFrame, DataFrame], best, schema: str) -> DataFrame:
    """`best(ids, labels, anchors' columns, scores of a few anchors)` over all pairs of blocks."""
    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("vec_id")
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            av, rv = matrix(anchors), matrix(rows)
            longest = anchors["square"].to_numpy().max() * rows["square"].to_numpy().max()
            primes = primes_for(int(longest**0.5 * (1 + 1e-9)) + 1)
            ra, rr = [residues(av, p) for p in primes], [residues(rv, p) for p in primes]
            names, own = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
            more = anchors["positives"].to_pylist() if "positives" in anchors.column_names else None
            for at in range(0, len(av), ANCHORS):
                some = [x[at:at + ANCHORS] for x in ra]
                found = np.empty((len(some[0]), len(rv)), dtype=np.int64)
                for s in range(0, len(rv), STRIP):
                    found[:, s:s + STRIP] = scores(some, [x[s:s + STRIP] for x in rr], primes)
                for i, line in enumerate(found, at):
                    out += best(ids, labels, names[i], own[i], more and more[i], line)
        return pa.Table.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(schema.count(",") + 1)],
                                    names=[f.split()[0] for f in schema.split(", ")])

    rows, anchors = laid
    return anchors.groupBy("dim", "a", "r").cogroup(rows.groupBy("dim", "a", "r")).applyInArrow(meet, schema)


def _first(places: np.ndarray, line: np.ndarray, most: int) -> np.ndarray:
    """Of `places` (by vec_id) the `most` with the highest scores, best first, ties by vec_id."""
    s = line[places]
    if len(s) > 4 * most:
        enough = np.partition(s, len(s) - most)[len(s) - most]
        places, s = places[s >= enough], s[s >= enough]
    return places[np.argsort(-s, kind="stable")[:most]]


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` is a condition on vec_id, `label` an expression over vec_id and label. A
    negative of a positive with score p scores from `low` to `high` hundredths of p.
    """
    rows = written(usable(vectors, F.col("label") if label is None else label), "whole-rows")
    anchors = written(rows.where(is_anchor), "anchors")
    laid = _laid(rows, anchors, block)

    def alike(ids, labels, name, own, _, line):
        places = np.flatnonzero((labels == own) & (ids != name))
        return [(name, ids[j], line[j]) for j in _first(places, line, positives)]

    nearest = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    some = _met(laid, alike, "anchor_id long, vec_id long, score long")
    some = some.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= positives)
    known = some.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    known = written(known.withColumnRenamed("anchor_id", "vec_id"), "positives")

    def unlike(ids, labels, name, own, wanted, line):
        out = []
        other = labels != own
        for p in wanted:
            s = p["score"]
            places = np.flatnonzero(other & (100 * line >= low * s) & (100 * line <= high * s))
            out += [(name, p["vec_id"], ids[j], s, line[j]) for j in _first(places, line, negatives)]
        return out

    asking = laid[1].join(known, "vec_id")
    found = _met((laid[0], asking), unlike, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
