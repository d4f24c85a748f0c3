"""Image scans that leave out torn and unreadable files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walksieve.params import MIN_JPEG_BYTES


def whole_jpeg(content: Column) -> Column:
    """Long enough and ending with the end-of-image marker."""
    end = F.substring(content, F.length(content) - 1, F.lit(2))
    return (F.length(content) >= MIN_JPEG_BYTES) & (F.hex(end) == "FFD9")


def whole_frames(files: DataFrame) -> DataFrame:
    """Rows whose `content` is a complete frame."""
    return files.filter(whole_jpeg(F.col("content")))


def torn_frames(files: DataFrame) -> DataFrame:
    return files.filter(~whole_jpeg(F.col("content")))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded frames under `path` that landed whole: `image` structs."""
    landed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)
              .filter(whole_jpeg(F.col("content"))).select(_plain(F.col("path")).alias("_path")))
    decoded = spark.read.format("image").option("pathGlobFilter", "*.jpg").load(path)
    return (decoded.filter("image.height > 0")
            .join(landed, _plain(F.col("image.origin")) == F.col("_path"), "left_semi"))


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """Frames that end well but do not decode: their names, to be made again."""
    decoded = spark.read.format("image").option("pathGlobFilter", "*.jpg").load(path)
    return decoded.filter("image.height <= 0").select(
        F.element_at(F.split("image.origin", "/"), -1).alias("name"))


def _plain(path: Column) -> Column:
    """Paths come as file:/x or file:///x depending on the reader."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")
