"""One document of each group of near copies: SimHash first, then an exact shingle join.

Texts are compared by the sets of their five-word shingles; a similarity (Jaccard) of
0.8 or more makes two documents copies, and copies of copies belong together. Fingerprints
of the sets that differ in at most RADIUS bits (`simhash`, by exact bands and bit-sliced
comparison) propose the first links, which are verified on the sets. A similarity of 0.8
puts fingerprints further apart than any radius that scales, so what these links leave
open is settled exactly:

Shingles have one order, from rare to frequent. Two sets at 0.8 share at least four fifths of
the larger one, so the first fifth of each (and one more) have a shingle in common: what
shares none of these is never a copy, and everything that does is settled on the actual
sets, unless both are joined already. No link goes unproved, and none is left out.

A shingle's documents are first held against the one that shares most with others, for
STARS rounds; a document so compared leaves the shingle, and shingles whose documents
are joined drop out. Pairs that are then open are compared in tasks, by an upper
bound of what they can share, and verified where it allows 0.8. Shingles that have the
same document on top go to the same tasks, so that a pair is told about once, however
many shingles it shares.

Rows with a null text or no words are copies of each other. Of a group the row with the
smallest doc_id stays (null last), of repeated rows one. An empty table gives an empty
result; all columns are carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walksieve.llm import simhash
from walksieve.llm.common import raw_texts, shingle_hashes
from walksieve.llm.components import components
from walksieve.session import written

WORDS = 5
STARS = 2
SAMPLE = 16             # one document of so many is counted for the order of shingles
SAMPLED = 5000          # or so many documents, if that is more
FREQUENT = 200_000      # shingles ordered by frequency; the others come before them
CELLS = 128             # least number of counts of a set's shingles by hash, for the bound
MOST_CELLS = 8192       # larger sets have a count for each two to four of their shingles, up to so many
FULL = 65535
CHUNK = 4096            # documents of one shingle that meet in one comparison
BUNDLE = 16384          # documents of many shingles that one call handles
RADIUS = 3              # bits in which fingerprints of proposed links may differ


def _cells(s: np.ndarray) -> bytes:
    """Shingles by the low bits of their hash; the more shingles, the more bits."""
    size = min(max(CELLS, 1 << (len(s) // 4).bit_length()), MOST_CELLS)
    return np.minimum(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size), FULL).astype("<u2").tobytes()


def _folded(cells: np.ndarray, size: int) -> np.ndarray:
    """Rows of counts over fewer cells; a full cell stays full."""
    if cells.shape[1] == size:
        return cells
    cells = cells.reshape(len(cells), -1, size)
    return np.where((cells == FULL).any(axis=1), FULL, np.minimum(cells.sum(axis=1, dtype=np.int64), FULL)).astype(np.uint16)


def _can_be_alike(x: np.ndarray, y: np.ndarray, n) -> np.ndarray:
    """Whether counts x and y (rows), of n shingles in all, allow 0.8; a full cell tells nothing."""
    size = min(x.shape[1], y.shape[1])
    low = np.minimum(_folded(x, size), _folded(y, size))
    return (9 * low.sum(axis=1, dtype=np.int64) >= 4 * n) | (low == FULL).any(axis=1)


def _shingles(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in ascending order, and the rank of each (1: the rarest).

    Any order of shingles gives the same result; this one gives few comparisons.
    """
    def listed(batches):
        for batch in batches:
            sets = [_shingles(t) for t in raw_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], names=["s"])

    every = max(1, min(SAMPLE, docs.count() // SAMPLED))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").mapInArrow(listed, "s long")
    often = some.groupBy("s").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas()
    s, n = often["s"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.lexsort((s, n))
    rank = np.empty(len(s), dtype=np.int64)
    rank[order] = np.arange(1, len(s) + 1)
    by_value = np.argsort(s)
    return s[by_value], rank[by_value]


def _prefixes(keyed: DataFrame, frequent: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """doc_id, h, node (names the set), n (its size), prefix, cells, fp (its fingerprint)."""
    def make(batches):
        for batch in batches:
            nodes, sizes, heads, cells, prints = [], [], [], [], []
            for text in raw_texts(batch.column(1)):
                s = _shingles(text)
                nodes.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True))
                sizes.append(len(s))
                cells.append(_cells(s))
                prints.append(simhash.majority(s))
                if len(frequent) and len(s):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    s = s[np.argsort(np.where(frequent[at] == s, ranks[at], 0), kind="stable")]
                heads.append(s[:len(s) - (4 * len(s) + 4) // 5 + 1].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in heads]))).astype(np.int32)
            listed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*heads, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), listed, pa.array(cells, pa.binary()), pa.array(prints, pa.binary())],
                                             names=["doc_id", "h", "node", "n", "prefix", "cells", "fp"])

    return keyed.mapInArrow(make, "doc_id long, h long, node long, n long, prefix array<bigint>, cells binary, fp binary")


def _sets(rows: DataFrame) -> DataFrame:
    """node and the sorted hashes of its text's different shingles."""
    def make(batches):
        for batch in batches:
            sets = [_shingles(t) for t in raw_texts(batch.column(1))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["node", "set"])

    return rows.select("node", "text").mapInArrow(make, "node long, set array<bigint>")


def _allowed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that can be at 0.8 by their sizes and cells."""
    def some(batches):
        for batch in batches:
            x, y = ([np.frombuffer(c, "<u2") for c in batch.column(k).to_pylist()] for k in (2, 3))
            n, good = batch.column(4).to_numpy(), np.zeros(batch.num_rows, dtype=bool)
            sizes = np.array([(len(c), len(d)) for c, d in zip(x, y)]).reshape(-1, 2)
            for size in np.unique(sizes, axis=0):
                at = np.flatnonzero((sizes == size).all(axis=1))
                for few in np.array_split(at, 1 + len(at) * int(size.max()) // 10**7):
                    good[few] = _can_be_alike(np.stack([x[i] for i in few]), np.stack([y[i] for i in few]), n[few]) if len(few) else False
            yield batch.select([0, 1]).filter(pa.array(good))

    a, b = (known.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("cells").alias(f"c{k}")) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return both.select("a", "b", "ca", "cb", (F.col("na") + F.col("nb")).alias("n")).mapInArrow(some, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are at 0.8 or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _dealt(entries: DataFrame) -> DataFrame:
    """bundle, run, side, node, root: what is compared together.

    A shingle with more than CHUNK documents is cut into chunks by hash, and each pair of
    chunks is a run of its own. Side 0 is compared within itself, side 1 with side 2.
    A bundle has the runs of shingles with the same top document, several such, or a
    part of them if they are many.
    """
    k = F.ceil(F.col("m") / CHUNK).cast("int")
    each = entries.groupBy("s").agg(F.count("*").alias("m"), F.max(F.struct("often", "node")).alias("t")).select("s", F.col("t.node").alias("top"), "m", k.alias("k"))
    each = written(each, "shingle-tops")
    pieces = each.groupBy("top").agg(F.ceil(F.sum(F.col("m") * F.col("k")) / BUNDLE).alias("pieces"))
    bundles = 1 + (each.agg(F.sum(F.col("m") * F.col("k"))).first()[0] or 0) // BUNDLE
    cut = entries.join(each.join(pieces, "top"), "s").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), "k").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    run = F.xxhash64("s", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    bundle = F.pmod(F.xxhash64("top", F.pmod(run, "pieces")), F.lit(bundles))
    return cut.select(bundle.alias("bundle"), run.alias("run"), side.cast("int").alias("side"), "node", "root")


def _possible(met: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: the pairs of different roots that meet and can be at 0.8 by their cells."""
    def pairs(met, known):
        import pandas as pd

        met, known = met.sort_values(["run", "side", "node"], kind="stable"), known.sort_values("node")
        run, side, node, root = (met[c].to_numpy() for c in ("run", "side", "node", "root"))
        of = np.searchsorted(known["node"].to_numpy(), node)
        counts = [np.frombuffer(c, "<u2") for c in known["cells"]]
        # sets of about one size have as many cells; rows of one number of cells are one matrix
        width = np.array([len(c) for c in counts], dtype=np.int64)
        tables = {w: np.stack([c for c in counts if len(c) == w]) for w in np.unique(width).tolist()}
        place = np.zeros(len(width), dtype=np.int64)
        for w in tables:
            place[width == w] = np.arange(int((width == w).sum()))
        n, width, place = known["n"].to_numpy()[of], width[of], place[of]
        last = np.searchsorted(run, run, "right")
        own = np.unique(run, return_inverse=True)[1]
        second = np.searchsorted(run, run, "left") + np.bincount(own, side == 1).astype(np.int64)[own]
        found = [np.empty((0, 2), dtype=np.int64)]
        for i in np.flatnonzero(side != 2):
            j = np.arange(i + 1 if side[i] == 0 else second[i], last[i])
            j = j[(root[j] != root[i]) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))]
            mine = tables[int(width[i])][place[i]][None, :]
            for w in np.unique(width[j]).tolist():
                some = j[width[j] == w]
                some = some[_can_be_alike(tables[w][place[some]], mine, n[some] + n[i])]
                found.append(np.stack((np.maximum(node[some], node[i]), np.minimum(node[some], node[i])), axis=1))
        found = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    told = written(met.select("bundle", "node").distinct(), "bundle-nodes").join(known, "node").select("bundle", "node", "n", "cells")
    return met.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInPandas(pairs, "a long, b long").distinct()


def _open(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The entries, with their roots, of shingles whose documents are not all joined."""
    if roots is not None:
        entries = entries.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = entries.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("s")
    return written(entries.join(several, "s").select("s", "node", "often", "root"), "shingles-open")


def _proposed(classes: DataFrame) -> DataFrame:
    """a, b: links between sets whose fingerprints are within RADIUS, directly or over others."""
    alike = written(classes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprint-classes")
    same = classes.select("fp", F.col("node").alias("a")).join(alike.withColumnRenamed("node", "b"), "fp").where("a <> b").select("a", "b")
    return simhash.linked(alike, simhash.Shape(radius=RADIUS)).select("a", "b").unionByName(same)


class _Links:
    """Verified links so far, and the sets that were read for them."""

    def __init__(self, classes: DataFrame, docs: DataFrame):
        self.classes, self.known = classes, classes.select("node", "n", "cells")
        self.texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
        self.held: DataFrame | None = None
        self.sets: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> DataFrame | None:
        """Adds the links among `pairs`; returns the roots of all, if any came new."""
        pairs = written(pairs, "links-open")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        ends = written(ends if self.sets is None else ends.join(self.sets, "node", "left_anti"), "nodes-met")
        if not ends.isEmpty():
            named = ends.join(self.classes, "node").select("node", F.col("who.doc_id").alias("__id"), F.col("who.h").alias("__h"))
            rows = self.texts.join(named, self.texts["doc_id"].eqNullSafe(named["__id"]) & (self.texts["h"] == named["__h"]))
            more = written(_sets(rows).dropDuplicates(["node"]), "shingle-sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
        if self.sets is None:
            return None
        new = written(_verified(pairs, self.sets), "links-held")
        if new.isEmpty():
            return None
        self.held = new if self.held is None else self.held.unionByName(new)
        return written(components(self.held), "roots")


def _links(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """node, root of all nodes that links at 0.8 or more connect, directly or over others."""
    links = _Links(classes, docs)
    roots = links.verify(_allowed(_proposed(classes).distinct(), links.known))
    heads = classes.select(F.explode("prefix").alias("s"), "node")
    several = heads.groupBy("s").agg(F.count("*").alias("m")).where("m > 1")
    shared = written(heads.join(several, "s"), "shingles-shared")
    often = shared.groupBy("node").agg(F.sum("m").alias("often"))
    entries = _open(shared.join(often, "node").select("s", "node", "often", F.col("node").alias("root")), roots)
    for _ in range(STARS):
        if entries.isEmpty():
            return roots
        top = written(entries.groupBy("s").agg(F.max(F.struct("often", "node", "root")).alias("top")).select("s", F.col("top.node").alias("top"), F.col("top.root").alias("top_root")), "shingle-tops")
        met = entries.join(top, "s").where("node <> top")
        new = links.verify(_allowed(met.where("root <> top_root").select(F.greatest("node", "top").alias("a"), F.least("node", "top").alias("b")).distinct(), links.known))
        roots = roots if new is None else new
        entries = _open(met.select("s", "node", "often", "root"), roots)
    if entries.isEmpty():
        return roots
    new = links.verify(_possible(written(_dealt(entries), "dealt"), links.known))
    return roots if new is None else new


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without those that are copies of a kept one."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    prints = _prefixes(keyed, *_frequent(keyed))
    who = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "h")
    classes = written(prints.groupBy("node").agg(F.min(who).alias("who"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("cells").alias("cells"), F.first("fp").alias("fp")), "set-classes")
    roots = _links(classes, docs)
    rooted = classes.select("node", "who", F.col("node").alias("root"))
    if roots is not None:
        rooted = classes.select("node", "who").join(roots, "node", "left").select("who", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("who").alias("who")).select("who.doc_id", "who.h")
    named = keyed.select("doc_id", "h")
    rows = named.join(kept, named["doc_id"].eqNullSafe(kept["doc_id"]) & (named["h"] == kept["h"])).groupBy(named["doc_id"], named["h"]).agg(F.count("*").alias("n"))
    kept = written(rows.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), (F.col("n") > 1).alias("__again")), "kept")
    on = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h"))
    carry = lambda df: df.select(*[F.col(f"`{c}`") for c in docs.columns])
    out = carry(docs.join(kept.where("NOT __again"), on))
    again = kept.where("__again")
    if not again.isEmpty():
        out = out.unionByName(carry(docs.join(again, on).dropDuplicates(["__id", "__h"])))
    return out
