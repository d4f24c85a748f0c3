"""Blocks of alike faces, and which of them can hold a pair within a cosine.

Faces of a walk are measured by their angles to a few pivots, faces spread over
the walk. They are laid out by nearest pivot and angle to it and cut into blocks, and a
block keeps the range of its angles to every pivot. Angles on the sphere keep the
triangle inequality, so two faces differ by at least as much as their angles to
any pivot do: blocks (and strips of them, within a task) whose ranges lie further apart
than the threshold's angle hold no pair that reaches it. Nothing else is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walksieve.functions.ordinals import sorted_ordinal
from walksieve.functions.vectors import matrix, numbers
from walksieve.session import written

PIVOTS = 8
SLACK = 1e-6        # radians: more than rounding can move an angle
STRIP = 512


def _angles(batches):
    for batch in batches:
        v = matrix(batch.column(batch.num_columns - 2))
        out = []
        for at in range(0, len(v), 1024):
            rows = v[at:at + 1024]
            pivots = batch.column(batch.num_columns - 1).slice(at, 1024).to_pylist()
            # the batch's rows have few different walks
            p = np.asarray(pivots, dtype=np.float64) if len({len(x) for x in pivots}) == 1 else None
            cos = np.einsum("nd,npd->np", rows, p) if p is not None else [np.asarray(x, dtype=np.float64) @ r for x, r in zip(pivots, rows)]
            out += [np.arccos(np.clip(c, -1, 1)).tolist() for c in cos]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))],
                                         names=[*batch.schema.names[:-1], "angles"])


def laid_out(faces: DataFrame, size: int) -> DataFrame:
    """`faces` (with walk_id, face_idx, embedding last) plus angles, pos and block, as a written table.

    `pos` is the place in the layout, `block` pos by `size`.
    """
    step = faces.groupBy("walk_id").agg(F.expr(f"(max(face_idx) + {PIVOTS}) div {PIVOTS}").alias("_step"))
    far = faces.join(step, "walk_id").filter("face_idx % _step = 0")
    pivots = far.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("face_idx", "embedding"))).alias("_p"))
    pivots = written(pivots.select("walk_id", F.transform("_p", lambda p: p["embedding"]).alias("_p")), "pivots")
    asked = faces.join(pivots, "walk_id").select(*faces.columns, "_p")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in faces.schema.fields)
    measured = asked.mapInArrow(_angles, f"{fields}, angles array<double>")
    near = F.array_min("angles")
    placed = sorted_ordinal(measured, ["walk_id"], [F.array_position("angles", near), near, F.col("face_idx")], "pos")
    return written(placed.withColumn("block", F.floor(F.col("pos") / size).cast("int")), "laid-out")


def near_parts(rows: DataFrame, tau: Column, size: int, busy: Column | None = None, other: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Neighbouring blocks of the rows put together again, and the pairs of parts that can hold a pair.

    `rows` come from :func:`laid_out`, of which some may be gone; `tau` is one value per walk.
    With `busy` and `other`, conditions on rows, only pairs of parts count of which one has
    busy rows and the other (or itself) other ones. Returns (walk_id, block, part) and
    (walk_id, pa, pb) with pa <= pb.
    """
    left = rows.groupBy("walk_id", "block").agg(
        F.count(F.lit(1)).alias("_n"), F.max(tau).alias("_tau"),
        F.max(F.lit(True) if busy is None else busy).alias("_busy"), F.max(F.lit(True) if other is None else other).alias("_other"),
        *[f(F.get("angles", F.lit(k))).alias(f"{n}{k}") for k in range(PIVOTS) for n, f in (("_low", F.min), ("_high", F.max))])
    upto = F.sum("_n").over(Window.partitionBy("walk_id").orderBy("block"))
    left = written(left.withColumn("part", F.floor((upto - 1) / size).cast("int")), "block-ranges")
    whole = left.groupBy("walk_id", "part").agg(
        F.max("_tau").alias("_tau"), F.max("_busy").alias("_busy"), F.max("_other").alias("_other"),
        F.array(*[F.min(f"_low{k}") for k in range(PIVOTS)]).alias("_low"), F.array(*[F.max(f"_high{k}") for k in range(PIVOTS)]).alias("_high"))
    a, b = (whole.select("walk_id", *[F.col(c).alias(f"{c}_{s}") for c in ("part", "_tau", "_busy", "_other", "_low", "_high")]) for s in "ab")
    reach = F.acos(F.least(F.greatest(F.col("_tau_a"), F.lit(-1.0)), F.lit(1.0))) + SLACK
    close = lambda low, high: F.forall(F.zip_with(low, high, lambda x, y: F.coalesce(x - y <= reach, F.lit(True))), lambda ok: ok)
    pairs = (a.join(b, "walk_id").filter("part_a <= part_b")
             .filter(F.expr("_busy_a AND _other_b OR _busy_b AND _other_a"))
             .filter(close(F.col("_low_a"), F.col("_high_b")) & close(F.col("_low_b"), F.col("_high_a"))))
    return left.select("walk_id", "block", "part"), pairs.select("walk_id", F.col("part_a").alias("_pa"), F.col("part_b").alias("_pb"))


def meeting(rows: DataFrame, parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Copies of the rows so that each pair of parts shares (_pa, _pb); `_b` is a row's own part."""
    each = pairs.select("walk_id", "_pa", "_pb", F.explode(F.array_distinct(F.array("_pa", "_pb"))).alias("_b"))
    placed = rows.join(parts.withColumnRenamed("part", "_b"), ["walk_id", "block"])
    return placed.join(written(each, "meetings"), ["walk_id", "_b"])


def strips(table: pa.Table, rows: np.ndarray, cols: np.ndarray, tau: float):
    """(rows, cols) index arrays, strip by strip, without strips that are too far apart."""
    pos, angles = numbers(table["pos"]), matrix(table["angles"])
    rows, cols = rows[np.argsort(pos[rows])], cols[np.argsort(pos[cols])]
    reach = np.arccos(np.clip(tau, -1, 1)) + SLACK
    pieces = [cols[at:at + STRIP] for at in range(0, len(cols), STRIP)]
    if not len(rows) or not pieces:
        return
    low, high = (np.array([f(angles[p], axis=0) for p in pieces]) for f in (np.min, np.max))
    for at in range(0, len(rows), STRIP):
        own = rows[at:at + STRIP]
        a = angles[own]
        near = ((low - a.max(axis=0) <= reach) & (a.min(axis=0) - high <= reach)).all(axis=1)
        if near.any():
            yield own, np.concatenate([p for p, n in zip(pieces, near) if n])
