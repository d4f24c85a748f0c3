"""Near-duplicate removal, sharpest face first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walksieve.functions.vectors import matrix, numbers
from walksieve.operators.pairs import BLOCK, STRIP
from walksieve.operators.regions import laid_out, meeting, near_parts, strips
from walksieve.params import Dedup
from walksieve.session import written

_NONE = -2.0      # below any cosine


def _settle(table):
    """The sequential rule over one bounded set of faces: which stay, who absorbs whom.

    Returns the rows in visiting order, a kept flag, and the anchor and cosine
    of the absorbed ones.
    """
    order = np.lexsort((numbers(table["face_idx"]), -numbers(table["sharpness"])))
    table = table.take(pa.array(order))
    v = matrix(table["embedding"])
    pano, face = numbers(table["pano_idx"]), numbers(table["face_idx"])
    n = len(order)
    tau = table["tau"][0].as_py() if n else 0.0
    kept = np.zeros(n, dtype=bool)
    best, who = np.full(n, np.nan), np.full(n, -1, dtype=np.int64)
    for at in range(0, n, STRIP):
        until = min(at + STRIP, n)
        cos = v[at:until] @ v[:until].T
        for i in range(at, until):
            rivals = np.flatnonzero(kept[:i] & (pano[:i] != pano[i]))
            if len(rivals):
                row = cos[i - at, rivals]
                j = int(np.argmax(row))          # the earliest kept among equals
                if row[j] >= tau:
                    best[i], who[i] = row[j], face[rivals[j]]
                    continue
            kept[i] = True
    return table, kept, pa.array(who.astype(np.int32), mask=who < 0), pa.array(best, mask=who < 0)


def _settle_walk(table):
    """A whole short walk."""
    rows, kept, anchor, cosine = _settle(table)
    return pa.table({"walk_id": rows["walk_id"], "face_idx": rows["face_idx"],
                     "kept": pa.array(kept), "anchor": anchor, "cosine": cosine})


OPEN, WAITING, KEPT, ABSORBED = range(4)


def _visits(table) -> np.ndarray:
    """Each row's place in visiting order among the rows of the table."""
    place = np.empty(len(table), dtype=np.int64)
    place[np.lexsort((numbers(table["face_idx"]), -numbers(table["sharpness"])))] = np.arange(len(table))
    return place


def _sides(key, table, rows: np.ndarray, cols: np.ndarray):
    """Strips of the products between two parts: `rows` and `cols` are masks of who takes which side."""
    part, tau = numbers(table["_b"]), table["tau"][0].as_py()
    here, there = key[-2].as_py(), key[-1].as_py()
    v = matrix(table["embedding"])
    pano, visit = numbers(table["pano_idx"]), _visits(table)
    for x, y in {(here, there), (there, here)}:
        for r, c in strips(table, np.flatnonzero(rows & (part == x)), np.flatnonzero(cols & (part == y)), tau):
            c = c[np.argsort(visit[c])]
            cos = v[r] @ v[c].T
            reach = (cos >= tau) & (pano[r][:, None] != pano[c][None, :]) & (visit[c][None, :] < visit[r][:, None])
            yield r, c, cos, reach


def _search(key, table):
    """For each open face: is an earlier similar one kept, and which is the first that is not settled."""
    state, face, sharp = numbers(table["state"]), numbers(table["face_idx"]), numbers(table["sharpness"])
    out = [np.empty((3, 0), dtype=np.int64)]
    for r, c, _, reach in _sides(key, table, state == OPEN, state != ABSORBED):
        kept = state[c] == KEPT
        hit, waits = (reach & kept).any(axis=1), reach & ~kept
        first = np.where(waits.any(axis=1), c[waits.argmax(axis=1)], -1)
        some = hit | (first >= 0)
        out.append(np.stack((r[some], hit[some], first[some])))
    row, hit, first = np.concatenate(out, axis=1)
    none = first < 0
    return pa.table({
        "walk_id": table["walk_id"].take(pa.array(row)), "face_idx": pa.array(face[row]), "hit": pa.array(hit.astype(bool)),
        "sharpness": pa.array(sharp[first], mask=none), "first": pa.array(face[first], mask=none)})


def _closest(key, table):
    """For each absorbed face its best earlier kept one, the earliest among equals."""
    state, face, sharp = numbers(table["state"]), numbers(table["face_idx"]), numbers(table["sharpness"])
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for r, c, cos, reach in _sides(key, table, state == ABSORBED, state == KEPT):
        cos = np.where(reach, cos, _NONE)
        j = cos.argmax(axis=1)
        some = reach.any(axis=1)
        out.append((r[some], c[j][some], cos[np.arange(len(r)), j][some]))
    row, who, best = (np.concatenate(x) for x in zip(*out))
    return pa.table({"walk_id": table["walk_id"].take(pa.array(row)), "face_idx": pa.array(face[row]), "anchor": pa.array(face[who]),
                     "sharpness": pa.array(sharp[who]), "cosine": pa.array(best)})


def greedy_dedup(faces: DataFrame, tau: float | Column | DataFrame, block: int = BLOCK) -> DataFrame:
    """Which faces stay, and which face absorbed each of the others.

    Faces are visited by falling sharpness, then capture order. A face whose
    best cosine against the kept faces of other panoramas reaches `tau` is
    absorbed by that one (the earliest kept among equals); otherwise it stays.
    `tau` is one number, a column of `faces`, or a table of walk_id and tau;
    walks missing from the table are left out. Returns walk_id, face_idx, kept,
    anchor, cosine.

    A walk of at most `block` faces is settled in one task. Longer walks go in
    rounds, see :func:`parallel_rounds`.
    """
    def leveled(part: DataFrame) -> DataFrame:
        if isinstance(tau, DataFrame):
            part = part.join(tau.select("walk_id", F.col("tau").alias("_tau")), "walk_id")
            level = F.col("_tau")
        else:
            level = F.lit(float(tau)) if isinstance(tau, (int, float)) else tau
        return part.select(
            "walk_id", F.col("face_idx").cast("int").alias("face_idx"),
            F.col("pano_idx").cast("int").alias("pano_idx"),
            F.col("sharpness").cast("double").alias("sharpness"),
            level.cast("double").alias("tau"), "embedding")

    walk_type = faces.schema["walk_id"].dataType.simpleString()
    schema = f"walk_id {walk_type}, face_idx int, kept boolean, anchor int, cosine double"
    # indices are unique and start at 0: without one of `block` or more a walk is short
    longer = faces.filter(F.col("face_idx") >= block)
    if longer.isEmpty():
        return leveled(faces).groupBy("walk_id").applyInArrow(_settle_walk, schema)
    long_walks = written(longer.select("walk_id").distinct(), "long-walks")
    short = leveled(faces.join(long_walks, "walk_id", "left_anti"))
    return parallel_rounds(leveled(faces.join(long_walks, "walk_id", "left_semi")), block)[0] \
        .unionByName(short.groupBy("walk_id").applyInArrow(_settle_walk, schema))


def parallel_rounds(slim: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Selection in long walks, all at once, and the rounds it took.

    A face is settled as soon as what comes before it allows: it stays if none of its
    earlier similar faces is left, and goes if one of them stays. In a round every open
    face looks, block by block in parallel, for a kept earlier one and else for the first
    earlier one that is not settled; it then waits for that one alone and looks again only
    if that one is absorbed. In random order the number of rounds grows with the logarithm
    of the faces, however many of them stay. Blocks hold alike faces (`regions`), so pairs of blocks
    without a similar pair never meet, and what is settled as absorbed leaves the later
    rounds. Vectors are laid out once; a round writes a narrow table of states. The
    anchors are found in the end, by the products of absorbed with kept faces.
    """
    face = ["walk_id", "face_idx"]
    walk_type = slim.schema["walk_id"].dataType.simpleString()
    base = laid_out(slim.select("walk_id", "face_idx", "pano_idx", "sharpness", "tau", "embedding"), block)

    def met(state, rows, work, schema):
        found = base.join(state, face)
        parts, pairs = near_parts(found, F.col("tau"), block, *rows)
        wide = meeting(found, parts, pairs).drop("block")
        return wide.groupBy("walk_id", "_pa", "_pb").applyInArrow(work, schema)

    now = written(base.select(*face, F.lit(OPEN).alias("state"), F.lit(None).cast("int").alias("first")), "states")
    rounds = 0
    while not now.filter(F.col("state") < KEPT).isEmpty():
        rounds += 1
        told = now.filter(F.col("state") >= KEPT).select("walk_id", F.col("face_idx").alias("first"), F.col("state").alias("_then"))
        now = now.join(told, ["walk_id", "first"], "left").select(
            *face, "first", F.when((F.col("state") == WAITING) & (F.col("_then") == KEPT), ABSORBED)
            .when((F.col("state") == WAITING) & (F.col("_then") == ABSORBED), OPEN).otherwise(F.col("state")).alias("state"))
        if now.filter(F.col("state") == OPEN).isEmpty():
            now = written(now, "states")
            continue
        found = met(now.filter(F.col("state") != ABSORBED).select(*face, "state"), (F.col("state") == OPEN, F.lit(True)), _search,
                    f"walk_id {walk_type}, face_idx int, hit boolean, sharpness double, first int")
        found = found.groupBy(*face).agg(F.max("hit").alias("_hit"), F.max(F.when(F.col("first").isNotNull(), F.struct("sharpness", (-F.col("first")).alias("_f")))).alias("_first"))
        found = found.select(*face, "_hit", (-F.col("_first._f")).alias("_first"))
        asked = now.filter(F.col("state") == OPEN).select(*face).join(found, face, "left").select(
            *face, F.col("_first").alias("first"), F.when(F.col("_hit"), ABSORBED).when(F.col("_first").isNotNull(), WAITING).otherwise(KEPT).alias("state"))
        now = written(now.filter(F.col("state") != OPEN).select(*face, "first", "state").unionByName(asked), "states")
    closest = met(now.select(*face, "state"), (F.col("state") == ABSORBED, F.col("state") == KEPT), _closest,
                  f"walk_id {walk_type}, face_idx int, anchor int, sharpness double, cosine double")
    order = F.struct("cosine", "sharpness", (-F.col("anchor")).alias("_a"))
    closest = closest.groupBy(*face).agg(F.max_by(F.struct("anchor", "cosine"), order).alias("_c"))
    kept = now.filter(F.col("state") == KEPT).select(*face, F.lit(True).alias("kept"), F.lit(None).cast("int").alias("anchor"), F.lit(None).cast("double").alias("cosine"))
    return kept.unionByName(closest.select(*face, F.lit(False).alias("kept"), "_c.anchor", "_c.cosine")), rounds


class _Counted:
    """How many of each rank are in a window, as a counted tree: a step costs the logarithm of the ranks."""

    def __init__(self, ranks: int):
        self.size = 1 << max(1, ranks - 1).bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, rank: int, more: int) -> None:
        at = rank + self.size
        while at:
            self.tree[at] += more
            at >>= 1

    def place(self, k: int) -> int:
        """The rank of the k-th smallest, from 0."""
        at, tree = 1, self.tree
        while at < self.size:
            at *= 2
            if tree[at] <= k:
                k -= tree[at]
                at += 1
        return at - self.size


def sliding_median(t: np.ndarray, value: np.ndarray, span: float) -> np.ndarray:
    """Median of the values within `span` of each row's time; rows are in order of time.

    A missing value counts for nothing; where all are missing the median is NaN.
    """
    known = np.flatnonzero(~np.isnan(value))
    ranked, rank = np.unique(value[known], return_inverse=True)
    counted, place = _Counted(len(ranked) or 1), np.full(len(t), -1)
    place[known] = rank
    begins, ends = np.searchsorted(t, t - span, "left").tolist(), np.searchsorted(t, t + span, "right").tolist()
    place, out, low, high, n = place.tolist(), np.full(len(t), np.nan), 0, 0, 0
    for i, (begin, end) in enumerate(zip(begins, ends)):
        while high < end:
            if place[high] >= 0:
                counted.add(place[high], 1)
                n += 1
            high += 1
        while low < begin:
            if place[low] >= 0:
                counted.add(place[low], -1)
                n -= 1
            low += 1
        if n:
            middle = ranked[counted.place((n - 1) // 2)]
            out[i] = middle if n % 2 else 0.5 * middle + 0.5 * ranked[counted.place(n // 2)]
    return out


def heading_ratio(faces: DataFrame, span: float) -> DataFrame:
    """Adds `ratio`: sharpness over the median of its heading within `span` seconds.

    1.0 where that median is not positive. Walks are cut into stretches of
    time; a face is copied into the stretches its span reaches, so a window
    never covers a whole walk. In a stretch the window slides over the sorted faces,
    each of which enters and leaves a counted tree once.
    """
    width = 4.0 * span
    reach = F.sequence(F.floor((F.col("t_sec") - span) / width),
                       F.floor((F.col("t_sec") + span) / width))
    slim = (faces.select("walk_id", "face_idx", "yaw", F.col("t_sec").cast("double").alias("t_sec"),
                         F.col("sharpness").cast("double").alias("sharpness"))
            .withColumn("_slot", F.explode(reach)))
    def usual(table):
        t = numbers(table["t_sec"])
        order = np.argsort(t, kind="stable")
        middle = np.empty(len(t))
        middle[order] = sliding_median(t[order], table["sharpness"].to_numpy()[order], span)
        home = np.floor(t / width) == numbers(table["_slot"])
        out = table.select(["walk_id", "face_idx", "sharpness"]).append_column("_usual", pa.array(middle, mask=np.isnan(middle)))
        return out.filter(pa.array(home))

    walk, index = (slim.schema[c].dataType.simpleString() for c in ("walk_id", "face_idx"))
    near = slim.groupBy("walk_id", "yaw", "_slot").applyInArrow(usual, f"walk_id {walk}, face_idx {index}, sharpness double, _usual double")
    return near.select(
        "walk_id", "face_idx",
        F.when(F.col("_usual") > 0, F.col("sharpness") / F.col("_usual")).otherwise(1.0)
        .alias("ratio"))


def drop_solo(result: DataFrame, ratio: DataFrame, floor: float) -> DataFrame:
    """Removes kept faces that absorbed nothing and are smeared (`ratio` under `floor`).

    Adds `solo`, true for the faces removed here.
    """
    if floor <= 0:
        return result.withColumn("solo", F.lit(False))
    busy = (result.filter("anchor IS NOT NULL").groupBy("walk_id", "anchor").agg(F.lit(1).alias("_busy"))
            .withColumnRenamed("anchor", "face_idx"))
    alone = (result.filter("kept").select("walk_id", "face_idx")
             .join(busy, ["walk_id", "face_idx"], "left_anti")
             .join(ratio.filter(F.col("ratio") < floor), ["walk_id", "face_idx"])
             .select("walk_id", "face_idx", F.lit(True).alias("solo")))
    return (result.join(alone, ["walk_id", "face_idx"], "left")
            .withColumn("solo", F.coalesce("solo", F.lit(False)))
            .withColumn("kept", F.col("kept") & ~F.col("solo")))


def _sweep_walk(taus: list[float], floor: float):
    levels = np.array(taus)

    def sweep(table):
        """The sequential rule over one short walk, at all thresholds from one product."""
        table = table.take(pa.array(np.lexsort((numbers(table["face_idx"]), -numbers(table["sharpness"])))))
        v, pano, n = matrix(table["embedding"]), numbers(table["pano_idx"]), len(table)
        smeared = numbers(table["ratio"]) < floor
        kept, busy = np.zeros((len(levels), n), dtype=bool), np.zeros((len(levels), n), dtype=bool)
        for at in range(0, n, STRIP):
            until = min(at + STRIP, n)
            cos = v[at:until] @ v[:until].T
            # what reaches the lowest threshold serves the higher ones too
            cos[(cos < levels.min()) | (pano[at:until, None] == pano[None, :until])] = _NONE
            for i in range(at, until):
                near = np.flatnonzero(cos[i - at, :i] > _NONE)
                c = np.where(kept[:, near], cos[i - at, near][None, :], _NONE)
                reach = (c >= levels[:, None]).any(axis=1)
                kept[:, i] = ~reach
                if reach.any():
                    busy[np.flatnonzero(reach), near[c[reach].argmax(axis=1)]] = True
        solo = kept & ~busy & smeared[None, :] & (floor > 0)
        counts = lambda x: pa.array(x.sum(axis=1))
        return pa.table({"walk_id": pa.array([table["walk_id"][0].as_py()] * len(levels), table.schema.field("walk_id").type),
                         "tau": pa.array(levels), "kept": counts(kept & ~solo), "absorbed": counts(~kept), "solo": counts(solo)})

    return sweep


def threshold_sweep(faces: DataFrame, taus: list[float], dedup: Dedup = Dedup(), block: int = BLOCK) -> DataFrame:
    """What each of a few thresholds would leave: walk_id, tau, kept, absorbed, solo.

    Equal to a selection for each threshold. A walk of at most `block` faces is
    swept in one task: its products are taken once, and what reaches the lowest
    threshold serves all. Longer walks are laid out and selected once per threshold.
    """
    if not taus:
        raise ValueError("a sweep needs a threshold")
    face = ["walk_id", "face_idx"]
    taus = sorted({float(t) for t in taus})
    ratio = heading_ratio(faces, dedup.solo_span)
    slim = faces.select("walk_id", F.col("face_idx").cast("int").alias("face_idx"), F.col("pano_idx").cast("int").alias("pano_idx"),
                        F.col("sharpness").cast("double").alias("sharpness"), "embedding")
    schema = f"walk_id {faces.schema['walk_id'].dataType.simpleString()}, tau double, kept long, absorbed long, solo long"
    sweep = _sweep_walk(taus, dedup.solo_floor)
    longer = faces.filter(F.col("face_idx") >= block)
    if longer.isEmpty():
        return slim.join(ratio, face).groupBy("walk_id").applyInArrow(sweep, schema)
    long_walks = written(longer.select("walk_id").distinct(), "long-walks")
    out = slim.join(long_walks, "walk_id", "left_anti").join(ratio, face).groupBy("walk_id").applyInArrow(sweep, schema)
    rows, ratio = faces.join(long_walks, "walk_id", "left_semi"), written(ratio.join(long_walks, "walk_id", "left_semi"), "ratios")
    for tau in taus:
        chosen = drop_solo(written(greedy_dedup(rows, tau, block), "selected"), ratio, dedup.solo_floor)
        out = out.unionByName(chosen.groupBy("walk_id").agg(
            F.lit(tau).alias("tau"), F.count_if("kept").alias("kept"), F.count_if(F.col("anchor").isNotNull()).alias("absorbed"), F.count_if("solo").alias("solo")))
    return out


def threshold_rule(walks: DataFrame, records: DataFrame) -> DataFrame:
    """The threshold each walk selects with: walk_id, rule, tau, problem.

    `walks` has walk_id, rule and tau (the fixed value). `problem` says why a
    calibrated walk has no threshold.
    """
    found = records.select("walk_id", F.col("tau").alias("_measured"), F.lit(True).alias("_found"))
    fixed = F.col("rule") != "calibrated"
    return (walks.select("walk_id", "rule", "tau").join(found, "walk_id", "left")
            .select("walk_id", "rule",
                    F.when(fixed, F.col("tau")).otherwise(F.col("_measured")).alias("tau"),
                    F.when(fixed, F.lit(""))
                    .when(F.col("_found").isNull(), F.lit("no calibration record"))
                    .when(F.col("_measured").isNull(), F.lit("too few far pairs"))
                    .otherwise(F.lit("")).alias("problem")))


def select_faces(faces: DataFrame, thresholds: DataFrame, dedup: Dedup = Dedup(),
                 block: int = BLOCK) -> DataFrame:
    """Manifest columns for every face of the walks that have a threshold.

    `thresholds`: walk_id, tau. Adds kept, anchor, cosine and solo to the face
    columns; the vector is left out.
    """
    levels = written(thresholds.filter("tau IS NOT NULL").select("walk_id", "tau"), "levels")
    # read three times below; the products behind it are taken once
    result = written(greedy_dedup(faces, levels, block), "selected")
    ratio = heading_ratio(faces, dedup.solo_span)
    chosen = drop_solo(result, ratio, dedup.solo_floor)
    return (faces.select("walk_id", "face_idx", "pano_idx", "t_sec", "yaw", "path", "sharpness")
            .join(chosen, ["walk_id", "face_idx"]))
