"""Recordings from a listing of camera files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walksieve.functions.text import shot_stamp

FRONT, BACK = "_00_", "_10_"    # fixed marks in the names of a two-file recording


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of the files under `path`; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length", "modificationTime")
            .withColumn("name", F.element_at(F.split("path", "/"), -1)))


def circles_per_frame(width: Column, height: Column) -> Column:
    """2 when both lens circles lie side by side in one frame."""
    return F.when(width >= height * 1.5, 2).otherwise(1)


def recording_catalogue(files: DataFrame) -> DataFrame:
    """One row per recording with its lens files, circles, shot time and problem.

    `files`: recording_id, file_no, name, width, height, and the form values
    shot_date and shot_time, which win over the stamp in the name. The front
    lens is the file marked as such, else the first one.
    """
    front = F.col("name").contains(FRONT)
    listed = files.groupBy("recording_id").agg(
        F.min_by(F.struct("name", "width", "height", "shot_date", "shot_time"),
                 F.struct((~front).alias("other"), F.col("file_no"))).alias("_f"),
        F.count(F.lit(1)).alias("files"), F.max(front).alias("_has_front"),
        F.max(F.col("name").contains(BACK)).alias("_has_back"),
        F.collect_set("name").alias("_names"))        # a recording's own few files
    video = F.col("_f.name")
    sibling = F.replace(video, F.lit(FRONT), F.lit(BACK))
    there = video.contains(FRONT) & F.array_contains("_names", sibling)
    rows = (listed.withColumn("back_lens", F.when(there, sibling))
            .withColumn("circles", circles_per_frame(F.col("_f.width"), F.col("_f.height"))))
    stamp = shot_stamp(video)
    problem = (F.when(F.col("_has_back") & ~F.col("_has_front"), "back lens only")
               .when((F.col("circles") == 1) & (F.col("files") < 2), "one lens of a pair")
               .otherwise(""))
    given = lambda c: F.coalesce(F.col(f"_f.{c}"), F.lit(""))
    return rows.select(
        "recording_id", video.alias("video"), "back_lens", "files", "circles",
        (F.col("circles") * F.when(F.col("back_lens").isNotNull(), 2).otherwise(1)).alias("lenses"),
        F.when(given("shot_date") != "", given("shot_date"))
        .otherwise(F.substring(stamp, 1, 10)).alias("shot_date"),
        F.when(given("shot_time") != "", given("shot_time"))
        .otherwise(F.substring(stamp, 12, 5)).alias("shot_time"),
        problem.alias("problem"))
