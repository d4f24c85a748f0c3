"""Class masks of the kept faces: making, summing up and reading them.

A mask row has walk_id, path, height, width and `mask`, one class id per byte.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walksieve.operators.images import grey, image_parts, pixels
from walksieve.params import CLASSES_SHOWN, MIN_MARGIN, MIN_SHARE

Segmenter = Callable[[list[np.ndarray]], np.ndarray]


def band_segmenter(step: int = 64) -> Callable[[], Segmenter]:
    """A deterministic stand-in for a model: the class is the grey level over `step`."""
    def load() -> Segmenter:
        return lambda images: np.stack([grey(im).astype(np.int64) // step for im in images])
    return load


def segment_kept(images: DataFrame, manifest: DataFrame, factory: Callable[[], Segmenter],
                 batch: int = 4) -> DataFrame:
    """Masks of the kept faces only. Class ids must fit a byte."""
    kept = images.join(manifest.filter("kept").select("walk_id", "path"),
                       ["walk_id", "path"], "left_semi")

    @F.pandas_udf(T.BinaryType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for data, height, width, channels in parts:
            frames = [pixels(d, h, w, c) for d, h, w, c in zip(data, height, width, channels)]
            rgb = [f if f.ndim == 2 else f[..., 2::-1] for f in frames]
            out = []
            for at in range(0, len(rgb), batch):
                ids = np.asarray(model(rgb[at:at + batch]))
                if ids.size and ids.max() >= 256:
                    raise ValueError(f"class id {int(ids.max())} does not fit an 8-bit mask")
                out.extend(m.astype(np.uint8).tobytes() for m in ids)
            yield pd.Series(out)

    return kept.select("walk_id", "path", F.col("image.height").alias("height"),
                       F.col("image.width").alias("width"),
                       run(*image_parts(F.col("image"))).alias("mask"))


def mask_counts(mask: Column) -> Column:
    """Per mask: array of (class_id, pixels, first pixel) of the classes in it."""
    @F.pandas_udf("array<struct<class_id:int,pixels:long,first:long>>")
    def count(masks: pd.Series) -> pd.Series:
        out = []
        for m in masks:
            ids, first, n = np.unique(np.frombuffer(m, dtype=np.uint8),
                                      return_index=True, return_counts=True)
            out.append([{"class_id": int(i), "pixels": int(c), "first": int(f)}
                        for i, c, f in zip(ids, n, first)])
        return pd.Series(out)

    return count(mask)


def class_shares(masks: DataFrame, labels: DataFrame, floor: float = MIN_SHARE) -> DataFrame:
    """Share of each class in each frame: walk_id, path, rank, class_id, class, share.

    Classes under `floor` of the frame are left out; the largest is rank 1 and
    ties go to the class seen first. A class without a label shows its number.
    `labels` (class_id, label) is the model's fixed vocabulary.
    """
    found = masks.select("walk_id", "path", mask_counts(F.col("mask")).alias("_c"))
    total = F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + c["pixels"])
    big = F.filter("_c", lambda c: c["pixels"] / F.col("_total") >= floor)
    ordered = F.array_sort(F.transform(big, lambda c: F.struct(
        (-c["pixels"]).alias("less"), c["first"].alias("first"), c["class_id"].alias("class_id"))))
    rows = (found.withColumn("_total", total)
            .select("walk_id", "path", "_total", F.posexplode(ordered).alias("_r", "_s")))
    return (rows.select("walk_id", "path", (F.col("_r") + 1).alias("rank"),
                        F.col("_s.class_id").alias("class_id"),
                        F.bround(-F.col("_s.less") / F.col("_total"), 4).alias("share"))
            .join(labels.select(F.col("class_id").cast("int"), "label"), "class_id", "left")
            .select("walk_id", "path", "rank", "class_id",
                    F.coalesce("label", F.col("class_id").cast("string")).alias("class"), "share"))


def used_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per walk: the named class ids that occur in its masks."""
    return (masks.select("walk_id", F.explode(mask_counts(F.col("mask"))).alias("_c"))
            .select("walk_id", "_c.class_id").distinct()
            .join(labels.select(F.col("class_id").cast("int"), "label"), "class_id")
            .select("walk_id", "class_id", "label"))


def current_shares(shares: DataFrame, manifest: DataFrame) -> DataFrame:
    """Shares of faces that are still kept; a new selection outdates the others."""
    return shares.join(manifest.filter("kept").select("walk_id", "path"),
                       ["walk_id", "path"], "left_semi")


def class_mix(shares: DataFrame, frames: DataFrame, top: int = CLASSES_SHOWN) -> DataFrame:
    """Mean share of each class over all segmented frames of a walk, largest first.

    Shares have four decimals and are added as whole numbers, so that the order of
    the rows cannot decide between equal totals; ties go to the class name.

    `frames` (walk_id, path) are the segmented frames, with or without shares.
    """
    counts = frames.groupBy("walk_id").agg(F.count(F.lit(1)).alias("_frames"))
    totals = shares.groupBy("walk_id", "class").agg(F.sum(F.bround(F.col("share") * 10_000).cast("long")).alias("_sum"))
    place = Window.partitionBy("walk_id").orderBy(F.desc("_sum"), F.asc("class"))
    return (totals.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
            .join(counts, "walk_id")
            .select("walk_id", "rank", "class", F.bround(F.col("_sum") / (F.col("_frames") * 10_000), 3).alias("share")))


def prompt_spans(classes: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """The text prompt of a class list and where each class lies in it."""
    starts, at = [], 0
    for name in classes:
        starts.append(at)
        at += len(name + ". ")
    return "".join(f"{c}. " for c in classes).strip(), \
        [(s, s + len(c)) for s, c in zip(starts, classes)]


def class_tokens(classes: list[str], offsets: list[tuple[int, int]]) -> list[list[int]]:
    """Token positions inside each class's span; empty tokens belong to none."""
    found = []
    for name, (low, high) in zip(classes, prompt_spans(classes)[1]):
        inside = [i for i, (a, b) in enumerate(offsets) if b > a and low <= a and b <= high]
        if not inside:
            raise ValueError(f"{name!r} has no token; use fewer or shorter classes")
        found.append(inside)
    return found


def name_detections(detections: DataFrame, tokens: list[list[int]], threshold: float,
                    margin: float = MIN_MARGIN) -> DataFrame:
    """Detections with a clear class: adds class_id, score and corner box.

    `detections` has `logits` (one per token), cx, cy, w, h as shares of the
    frame, and the frame's width and height. A class scores the mean sigmoid of
    its own tokens; the winner must pass `threshold` and lead by `margin`.
    """
    prob = F.transform("logits", lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x.cast("double"))))
    scored = detections.withColumn("_p", prob)
    means = [sum((F.element_at("_p", t + 1) for t in ids[1:]), F.element_at("_p", ids[0] + 1))
             / float(len(ids)) for ids in tokens]
    best = F.sort_array(F.array(*[F.struct(m.alias("score"), F.lit(-(i + 1)).alias("neg_id"))
                                  for i, m in enumerate(means)]), asc=False)
    runner_up = F.element_at("_best", 2)["score"] if len(tokens) > 1 else F.lit(0.0)
    return (scored.withColumn("_best", best)
            .withColumn("score", F.col("_best")[0]["score"])
            .withColumn("class_id", -F.col("_best")[0]["neg_id"])
            .filter((F.col("score") > threshold) & (F.col("score") - runner_up >= margin))
            .withColumn("x0", (F.col("cx") - F.col("w") / 2) * F.col("width"))
            .withColumn("y0", (F.col("cy") - F.col("h") / 2) * F.col("height"))
            .withColumn("x1", (F.col("cx") + F.col("w") / 2) * F.col("width"))
            .withColumn("y1", (F.col("cy") + F.col("h") / 2) * F.col("height"))
            .drop("_p", "_best"))


STRIPE = 64       # mask rows painted together


def composite(masks: DataFrame) -> DataFrame:
    """Paints a frame's instance masks into one class mask, largest first.

    Input rows: frame_id, det_idx, class_id, score, height, width, mask (0/1
    bytes). Equal areas are painted by rising score, then input order; pixels
    nothing covers are class 0. Frames are painted in stripes of rows, so a task
    holds one stripe of a frame's masks; a detector answers a fixed number of
    queries per frame, which bounds their number. Returns frame_id, stripe,
    width, top, mask.
    """
    @F.pandas_udf(T.LongType())
    def area(mask: pd.Series) -> pd.Series:
        return mask.map(lambda m: int(np.count_nonzero(np.frombuffer(m, dtype=np.uint8)))).astype("int64")

    stripe = F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / STRIPE).cast("int")))
    start = F.col("stripe") * STRIPE * F.col("width") + 1
    striped = (masks.withColumn("area", area(F.col("mask"))).withColumn("stripe", stripe)
               .select("frame_id", "stripe", "width", "det_idx", "class_id", "score", "area",
                       F.substring(F.col("mask"), start.cast("int"),
                                   F.lit(STRIPE) * F.col("width")).alias("mask"),
                       (F.col("stripe") * STRIPE).alias("top")))
    frame_type = masks.schema["frame_id"].dataType.simpleString()

    def paint(table):
        rows = table.to_pydict()
        order = sorted(range(len(table)), key=lambda i: (-rows["area"][i], rows["score"][i], rows["det_idx"][i]))
        canvas = np.zeros(len(rows["mask"][0]), dtype=np.uint8)
        for i in order:
            canvas[np.frombuffer(rows["mask"][i], dtype=np.uint8) != 0] = rows["class_id"][i]
        return pa.table({"frame_id": table["frame_id"][:1], "stripe": table["stripe"][:1],
                         "width": table["width"][:1], "top": table["top"][:1],
                         "mask": pa.array([canvas.tobytes()], pa.binary())})

    return (striped.groupBy("frame_id", "stripe")
            .applyInArrow(paint, f"frame_id {frame_type}, stripe int, width int, top int, mask binary"))


def boundaries(masks: DataFrame) -> DataFrame:
    """Adds `edges`, 1 where a 4-neighbour has another class, and `edge_pixels`.

    The border of the frame is not an edge by itself.
    """
    @F.pandas_udf("edges binary, edge_pixels long")
    def mark(mask: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        out, counts = [], []
        for m, h, w in zip(mask, height, width):
            ids = np.frombuffer(m, dtype=np.uint8).reshape(h, w)
            edge = np.zeros((h, w), dtype=bool)
            across, down = ids[:, 1:] != ids[:, :-1], ids[1:] != ids[:-1]
            edge[:, 1:] |= across
            edge[:, :-1] |= across
            edge[1:] |= down
            edge[:-1] |= down
            out.append(edge.astype(np.uint8).tobytes())
            counts.append(int(edge.sum()))
        return pd.DataFrame({"edges": out, "edge_pixels": counts})

    return (masks.withColumn("_e", mark(F.col("mask"), F.col("height"), F.col("width")))
            .select(*masks.columns, "_e.edges", "_e.edge_pixels"))


def segmentation_view(shares: DataFrame, frames: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per masked face with its time and heading, 0 where unknown.

    Adds `classes`, the shares in falling order. Sort by walk_id, t_sec, yaw.
    """
    listed = shares.groupBy("walk_id", "path").agg(F.array_sort(F.collect_list(
        F.struct("rank", "class", "share"))).alias("classes"))
    place = manifest.select("walk_id", "path", F.col("t_sec").alias("_t"), F.col("yaw").alias("_y"))
    return (frames.select("walk_id", "path").join(place, ["walk_id", "path"], "left")
            .join(listed, ["walk_id", "path"], "left")
            .select("walk_id", F.col("path").alias("face"),
                    F.coalesce("_t", F.lit(0.0)).alias("t_sec"),
                    F.coalesce("_y", F.lit(0)).alias("yaw"), "classes"))
