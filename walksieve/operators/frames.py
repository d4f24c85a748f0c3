"""Frames and panoramas: decimation, completeness, index, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walksieve.functions.ordinals import integer_ordinal
from walksieve.functions.quantiles import exact_quantiles
from walksieve.params import Gate


def frame_step(native_fps: Column, target_fps: float) -> Column:
    """Frames between two exported ones; never under 1, so never upsamples."""
    return F.greatest(F.lit(1), F.bround(native_fps / F.lit(float(target_fps))).cast("int"))


def decimate(recordings: DataFrame, target_fps: float = 2.0) -> DataFrame:
    """One row per frame to export: walk_id, frame_no, t_sec.

    The last frame of a recording is left out, so that every exported frame
    has a successor; a one-frame recording exports frame 0.
    """
    last = F.greatest(F.col("frames") - 1, F.lit(1)) - 1
    numbers = F.sequence(F.lit(0).cast("long"), last.cast("long"),
                         frame_step(F.col("fps"), target_fps).cast("long"))
    return (recordings.select("walk_id", "fps", F.explode(numbers).alias("frame_no"))
            .select("walk_id", "frame_no", (F.col("frame_no") / F.col("fps")).alias("t_sec")))


def completeness(requested: DataFrame, landed: DataFrame) -> DataFrame:
    """Per walk: requested, landed, wanted (both) and stale frames, and whether complete."""
    marked = lambda df, asked, have: df.select(
        "walk_id", "frame_no", F.lit(asked).alias("_asked"), F.lit(have).alias("_have"))
    frames = (marked(requested, True, False).unionByName(marked(landed, False, True))
              .groupBy("walk_id", "frame_no")
              .agg(F.max("_asked").alias("_asked"), F.max("_have").alias("_have")))
    return (frames.groupBy("walk_id")
            .agg(F.count_if("_asked").alias("requested"), F.count_if("_have").alias("landed"),
                 F.count_if(F.col("_asked") & F.col("_have")).alias("wanted"),
                 F.count_if(F.col("_have") & ~F.col("_asked")).alias("stale"))
            .withColumn("complete", (F.col("requested") > 0)
                        & (F.col("wanted") == F.col("requested"))))


def drop_stale(landed: DataFrame, requested: DataFrame) -> DataFrame:
    """Landed frames that were asked for."""
    return landed.join(requested.select("walk_id", "frame_no").distinct(),
                       ["walk_id", "frame_no"], "left_semi")


def pano_index(landed: DataFrame, fps: float | Column) -> DataFrame:
    """Dense panorama index per walk, in frame order, with its source time."""
    native = F.lit(float(fps)) if isinstance(fps, (int, float)) else fps
    return (integer_ordinal(landed, ["walk_id"], "frame_no", "pano_idx")
            .withColumn("pano_idx", F.col("pano_idx").cast("int"))
            .withColumn("t_sec", F.col("frame_no") / native))


def missing_panos(index: DataFrame, images: DataFrame) -> DataFrame:
    """Per walk: indexed panoramas whose image is gone, and the first of them."""
    return (index.join(images.select("walk_id", "pano_idx").distinct(),
                       ["walk_id", "pano_idx"], "left_anti")
            .groupBy("walk_id").agg(F.count(F.lit(1)).alias("missing"),
                                    F.min("pano_idx").alias("first_missing")))


def gate_floors(scores: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """The score a panorama needs, one row per walk: walk_id, floor."""
    if not 0.0 <= gate.dead < 1.0:
        raise ValueError("dead is a fraction of the walk median, in [0, 1)")
    medians = exact_quantiles(scores, ["walk_id"], "score", {"median": 0.5})
    return medians.select("walk_id", (F.col("median") * gate.dead).alias("floor"))


def above_floor(panos: DataFrame, floors: DataFrame) -> DataFrame:
    """Panoramas whose `score` reaches their walk's floor."""
    return (panos.join(floors.select("walk_id", F.col("floor").alias("_floor")), "walk_id")
            .filter(F.col("score") >= F.col("_floor")).drop("_floor"))


def legible(panos: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """Panoramas whose `score` reaches `gate.dead` of the walk's median score."""
    return above_floor(panos, gate_floors(panos, gate))


def emptied_walks(walks: DataFrame, kept: DataFrame) -> DataFrame:
    """Walks of which no panorama is left; a run of them cannot go on."""
    return walks.join(kept.select("walk_id").distinct(), "walk_id", "left_anti")


def surviving_panos(panos: DataFrame, manifest: DataFrame) -> DataFrame:
    """Panoramas that the manifest names."""
    return panos.join(manifest.select("walk_id", "pano_idx").distinct(),
                      ["walk_id", "pano_idx"], "left_semi")


def intake_missing(intake: DataFrame) -> DataFrame:
    """Adds `missing`: the required fields left blank, in form order."""
    blanks = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(c))
              for c in ("site", "building", "floor", "stage", "operator")]
    blanks.append(F.when(F.col("mount_height_cm").isNull(), F.lit("mount height")))
    return (intake.withColumn("missing", F.concat_ws(", ", *blanks))
            .withColumn("accepted", F.col("missing") == ""))
