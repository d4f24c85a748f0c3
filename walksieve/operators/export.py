"""The annotation set of reviewed walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walksieve.functions.text import export_name, fixed, join_present, slug
from walksieve.operators.review import effective_picks, review_counts
from walksieve.params import CLASSES_SHOWN

# fixed values: columns of the export manifest, in order
EXPORT_COLUMNS = ("file", "walk", "site", "building", "stage", "shot_date", "t_sec", "yaw",
                  "pano_idx", "source_face", "pick_idx", "overridden", "classes")


def name_prefix() -> Column:
    return join_present("_", slug(F.col("site")), slug(F.col("building")),
                        F.col("walk_id").cast("string"))


def class_text(shares: DataFrame, shown: int = CLASSES_SHOWN) -> DataFrame:
    """Per face: "wall 0.58; floor 0.10", the largest shares first."""
    entry = F.struct("rank", F.concat_ws(" ", "class", fixed(F.col("share"), 2)).alias("text"))
    return (shares.filter(F.col("rank") <= shown).groupBy("walk_id", "path")
            .agg(F.array_sort(F.collect_list(entry)).alias("_e"))
            .select("walk_id", F.col("path").alias("source_face"),
                    F.array_join(F.transform("_e", lambda e: e["text"]), "; ").alias("classes")))


def export_manifest(manifest: DataFrame, state: DataFrame, walks: DataFrame,
                    shares: DataFrame) -> DataFrame:
    """One row per shipped frame. Order by walk, pano_idx and yaw for a stable file."""
    meta = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("site", "building", "stage", "shot_date")]
    rows = (effective_picks(manifest, state)
            .join(walks.select("walk_id", *meta), "walk_id", "left")
            .join(class_text(shares), ["walk_id", "source_face"], "left"))
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("site", "building", "stage", "shot_date")]
    return rows.select(
        F.concat(F.lit("frames/"), export_name(name_prefix(), F.col("t_sec"), F.col("yaw"))).alias("file"),
        F.col("walk_id").cast("string").alias("walk"), *blank,
        F.round("t_sec", 1).alias("t_sec"), "yaw", "pano_idx", "source_face", "pick_idx",
        F.col("overridden").cast("int").alias("overridden"),
        F.coalesce("classes", F.lit("")).alias("classes"))


def frame_payload(frames: DataFrame, walks: DataFrame, settings: DataFrame) -> DataFrame:
    """The JSON that travels with each shipped frame: file, payload.

    `settings`: walk_id and `settings`, a struct of the walk's parameters.
    """
    meta = [c for c in walks.columns if c != "walk_id"]
    about = walks.select(F.col("walk_id").cast("string").alias("walk"), F.struct(*meta).alias("meta"))
    used = settings.select(F.col("walk_id").cast("string").alias("walk"), "settings")
    body = F.to_json(F.struct(
        "walk", "meta", "settings", "t_sec", "yaw", "pano_idx", "source_face",
        (F.col("overridden") == 1).alias("overridden")))
    return (frames.select("file", "walk", "t_sec", "yaw", "pano_idx", "source_face", "overridden")
            .join(about, "walk", "left").join(used, "walk", "left")
            .select("file", "walk", body.alias("payload")))


def export_walk_summary(manifest: DataFrame, state: DataFrame, walks: DataFrame,
                        segmented: DataFrame) -> DataFrame:
    """Per walk with a manifest: frames, dropped, overridden, segmented, site, building."""
    frames = (effective_picks(manifest, state).groupBy("walk_id")
              .agg(F.count(F.lit(1)).alias("frames")))
    masked = segmented.select("walk_id").distinct().withColumn("_masked", F.lit(True))
    return (manifest.select("walk_id").distinct()
            .join(frames, "walk_id", "left").join(review_counts(manifest, state), "walk_id", "left")
            .join(walks.select("walk_id", "site", "building"), "walk_id", "left")
            .join(masked, "walk_id", "left")
            .select("walk_id", F.coalesce("site", F.lit("")).alias("site"),
                    F.coalesce("building", F.lit("")).alias("building"),
                    *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("frames", "dropped", "overridden")],
                    F.col("_masked").isNotNull().alias("segmented")))


def write_export(frames: DataFrame, payloads: DataFrame, log: DataFrame, summary: DataFrame,
                 path: str) -> None:
    """Writes the set under `path`; the same review writes the same rows in the same order."""
    ordered = frames.select(*EXPORT_COLUMNS).repartitionByRange("walk", "pano_idx", "yaw") \
        .sortWithinPartitions("walk", "pano_idx", "yaw")
    ordered.write.mode("overwrite").option("header", True).csv(f"{path}/manifest")
    payloads.repartitionByRange("walk", "file").sortWithinPartitions("walk", "file") \
        .write.mode("overwrite").json(f"{path}/frames")
    log.repartitionByRange("walk_id", "id").sortWithinPartitions("walk_id", "id") \
        .write.mode("overwrite").json(f"{path}/decisions")
    summary.write.mode("overwrite").json(f"{path}/walks")
