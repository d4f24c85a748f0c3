"""SimHash fingerprints and near-duplicate classes by bit-sliced comparison.

A fingerprint's bit is 1 if it is set in more than half of the shingles' hashes.
Fingerprints that agree on a band of bits meet, and are compared over vertical bit
planes (`bitslice`). With one band more than the radius the search is exact: two
fingerprints within the radius agree on at least one band. For wide radii, bands of
sampled bits find the links with a known probability.

Nulls and texts without words have the all-zero fingerprint and link like others.
Repeated rows get equal results; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walksieve.llm import bitslice
from walksieve.llm.common import documents, mixed, raw_texts, shingle_hashes
from walksieve.llm.components import components
from walksieve.session import written


@dataclass(frozen=True)
class Shape:
    """How texts become fingerprints, and when two of them link."""

    words: int = 3              # words of a shingle
    size: int = 1               # 64-bit words of a fingerprint
    repeats: bool = True        # a repeated shingle counts as often as it occurs
    radius: int = 2
    sampled: int = 0            # bands of sampled bits; 0: radius + 1 exact bands
    sampled_bits: int = 12
    chunk: int = 4096           # fingerprints of one band value that meet in one comparison
    bundle: int = 16384         # fingerprints of many band values that one call handles


def majority(hashes: np.ndarray) -> bytes:
    """The 64 bits that are set in more than half of the hashes, highest first; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprint(text: bytes | None, shape: Shape) -> bytes:
    """The fingerprint of one whole text, highest bit first."""
    hashes = shingle_hashes(text, shape.words)
    if not len(hashes):
        return bytes(8 * shape.size)
    if not shape.repeats:
        hashes = np.unique(hashes)
    out = []
    for k in range(shape.size):
        own = hashes if k == 0 else mixed(hashes, k)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(own), 65536):
            part = own[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
        out.append(np.packbits(2 * ones > len(own)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shape: Shape = Shape(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and `fp` (binary) of every row; its whole text is read."""
    named = documents(docs, *keys, "text")

    def make(batches):
        for batch in batches:
            column = [fingerprint(t, shape) for t in raw_texts(batch.column(len(keys)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(column, pa.binary())], names=[*keys, "fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    return named.mapInArrow(make, f"{fields}, fp binary")


def _band_columns(shape: Shape) -> list[np.ndarray]:
    """The bit positions of each band."""
    bits = 64 * shape.size
    if not shape.sampled:
        return np.array_split(np.arange(bits), shape.radius + 1)
    picks = np.random.default_rng(20)
    return [np.sort(picks.choice(bits, shape.sampled_bits, replace=False)) for _ in range(shape.sampled)]


def _banded(classes: DataFrame, shape: Shape) -> DataFrame:
    """node, fp, band, value: one row per fingerprint and band."""
    columns = _band_columns(shape)

    def make(batches):
        for batch in batches:
            fps = batch.column(1).to_pylist()
            bits = bitslice.bits_of(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1))
            values = np.stack([bits[:, c].astype(np.int64) @ (1 << np.arange(len(c), dtype=np.int64)) for c in columns], axis=1)
            listed = pa.ListArray.from_arrays(np.arange(len(fps) + 1, dtype=np.int32) * len(columns), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=["node", "fp", "values"])

    made = classes.select("node", "fp").mapInArrow(make, "node long, fp binary, values array<bigint>")
    return made.select("node", "fp", F.posexplode("values").alias("band", "value"))


def _met(banded: DataFrame, shape: Shape, rows: int) -> DataFrame:
    """bundle, run, side, node, fp: what is compared together.

    A band value with more than `chunk` fingerprints is cut into chunks by hash, and
    each pair of chunks is a run of its own. Side 0 is compared within itself,
    side 1 with side 2.
    """
    hot = written(banded.groupBy("band", "value").agg(F.count("*").alias("n")).where(F.col("n") > shape.chunk), "hot-bands")
    cut = banded.join(hot, ["band", "value"], "left")
    cut = cut.withColumn("k", F.ceil(F.coalesce("n", F.lit(1)) / shape.chunk).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), "k").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    run = F.xxhash64("band", "value", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    copies = hot.agg(F.sum(F.col("n") * F.ceil(F.col("n") / shape.chunk))).first()[0] or 0
    bundles = 1 + (rows + copies) // shape.bundle
    return cut.select(F.pmod(run, F.lit(bundles)).alias("bundle"), run.alias("run"), side.cast("int").alias("side"), "node", "fp")


def _entries(run: np.ndarray, side: np.ndarray):
    """Lanes of the fingerprints, and the entries to compare; rows are sorted by (run, side)."""
    lane_side = side != 1
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(starts, len(run)))
    which = np.repeat(np.arange(len(starts)), sizes)
    laned = np.bincount(which, lane_side, len(starts)).astype(np.int64)
    words = (laned + 63) // 64
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    order = np.cumsum(lane_side) - 1
    before = np.concatenate(([0], np.cumsum(laned)[:-1]))
    lanes = np.where(lane_side, first[which] * 64 + order - before[which], -1)
    # a row of side 0 meets the lanes after its own; a row of side 1 all lanes of the run
    from_word = np.where(side == 0, lanes // 64, first[which])
    count = np.where(side == 2, 0, first[which] + words[which] - from_word)
    rows = np.repeat(np.arange(len(run)), count)
    word = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(from_word, count)
    valid = np.full(int(words.sum()), bitslice.FULL)
    part = laned % 64
    short = part > 0
    valid[(first + words - 1)[short]] = (np.uint64(1) << part[short].astype(np.uint64)) - np.uint64(1)
    mask = valid[word]
    own = (side[rows] == 0) & (word == lanes[rows] // 64)
    upto = (np.uint64(2) << (lanes[rows][own] % 64).astype(np.uint64)) - np.uint64(1)   # shifting all out leaves 0 - 1
    mask[own] &= ~upto
    return lanes, int(words.sum()), rows, word, mask


def _compared(met: DataFrame, shape: Shape, nearest: int) -> DataFrame:
    """a, b, distance: links that connect all that is linked, or the nearest few of each node."""

    def links(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["run", "side", "node"], kind="stable")
        run, side, node = pdf["run"].to_numpy(), pdf["side"].to_numpy(), pdf["node"].to_numpy()
        bits = bitslice.bits_of(np.frombuffer(b"".join(pdf["fp"]), np.uint8).reshape(len(pdf), -1))
        lanes, words, rows, word, mask = _entries(run, side)
        some = mask != 0
        planes = bitslice.planes_of(bits[lanes >= 0], lanes[lanes >= 0], words)
        at_lane = np.full(words * 64, -1)
        at_lane[lanes[lanes >= 0]] = np.flatnonzero(lanes >= 0)
        labels = np.arange(len(pdf))
        best = np.empty((0, 3), dtype=np.int64)
        for row, lane, distance in bitslice.near(bits, planes, rows[some], word[some], mask[some], shape.radius):
            other = at_lane[lane]
            if not nearest:
                labels = bitslice.joined_labels(labels, row, other)
                continue
            found = np.stack((np.append(row, other), np.append(distance, distance), np.append(other, row)), axis=1)
            best = np.concatenate((best, found))
            best = best[np.lexsort((best[:, 2], best[:, 1], best[:, 0]))]
            begins = np.searchsorted(best[:, 0], best[:, 0])
            best = best[np.arange(len(best)) - begins < nearest]
        if not nearest:
            of = np.flatnonzero(labels != np.arange(len(labels)))
            best = np.stack((of, np.zeros(len(of), dtype=np.int64), labels[of]), axis=1)
        return pd.DataFrame({"a": node[best[:, 0]], "b": node[best[:, 2]], "distance": best[:, 1]})

    return met.groupBy("bundle").applyInPandas(links, "a long, b long, distance long")


def classes_of(prints: DataFrame, shape: Shape) -> DataFrame:
    """node, fp, doc_id, copies: one row per different fingerprint, with its smallest doc_id."""
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if shape.size == 1 else F.xxhash64("fp")
    return prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("node", node)


def linked(classes: DataFrame, shape: Shape, nearest: int = 0) -> DataFrame:
    """a, b, distance between nodes of `classes` (a written table).

    With `nearest` 0 the links connect exactly the pairs within the radius, directly
    or over others. Otherwise each node's nearest few per band are given.
    """
    bands = shape.sampled or shape.radius + 1
    banded = _banded(classes, shape)
    return _compared(_met(banded, shape, classes.count() * bands), shape, nearest)


def near_duplicates(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row.

    component_id is the smallest doc_id that links reach, the row's own included.
    A null doc_id never names a component unless all of its members are null.
    """
    prints = written(fingerprints(docs, shape), "fingerprints")
    classes = written(classes_of(prints, shape), "fingerprint-classes")
    roots = written(components(linked(classes, shape)), "roots")
    rooted = classes.join(roots, "node", "left").select("fp", "doc_id", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = written(rooted.join(named, "root").select("fp", "component_id"), "components")
    return prints.join(label, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
