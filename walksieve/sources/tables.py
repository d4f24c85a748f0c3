"""Stage tables of a fleet: manifest, vectors, calibration, runs, failures.

Inside the engine these are Parquet in full precision. The rounded text forms
are edges for people and other tools.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walksieve.functions.text import fixed

# fixed values: columns of the manifest file, in order
MANIFEST_COLUMNS = ("pano_idx", "t_sec", "yaw", "path", "kept", "anchor", "cosine", "sharpness")

RECORD_SCHEMA = (
    "tau double, false_merge_pct double, far_seconds double, samples int, "
    "pairs array<struct<cosine:double,pano:int,yaw:int,t_sec:double,face:string,neighbour:string>>, "
    "far struct<n:long,median:double,p95:double,p99:double,max:double,cosines:array<double>>, "
    "reference struct<median:double,p05:double,min:double,n:long>, "
    "healthy boolean, reference_error string, gap_seconds double")

RUN_SCHEMA = ("at string, entered string, backbone string, tau double, rule string, "
              "reference double, pairs long, far_pairs long, far_p99 double, "
              "false_merge_pct double, faces long, anchors long, absorbed long, solo long, "
              "seconds map<string,double>")


def manifest_text(manifest: DataFrame) -> DataFrame:
    """The manifest as text: 1, 4 and 2 decimals, '' for no anchor, kept as 0 or 1."""
    number = lambda column, places: F.coalesce(fixed(F.col(column).cast("double"), places), F.lit(""))
    return manifest.select(
        "walk_id", "face_idx", F.col("pano_idx").cast("string").alias("pano_idx"),
        number("t_sec", 1).alias("t_sec"), F.col("yaw").cast("string").alias("yaw"), "path",
        F.col("kept").cast("int").cast("string").alias("kept"),
        F.coalesce(F.col("anchor").cast("string"), F.lit("")).alias("anchor"),
        number("cosine", 4).alias("cosine"), number("sharpness", 2).alias("sharpness"))


def manifest_typed(text: DataFrame) -> DataFrame:
    """The inverse of :func:`manifest_text`, with the rounded numbers."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return text.select(
        "walk_id", F.col("face_idx").cast("int"), F.col("pano_idx").cast("int"),
        F.col("t_sec").cast("double"), F.col("yaw").cast("int"), "path",
        (F.col("kept") == "1").alias("kept"), filled("anchor").cast("int").alias("anchor"),
        filled("cosine").cast("double").alias("cosine"), F.col("sharpness").cast("double"))


def write_manifest_csv(manifest: DataFrame, path: str) -> None:
    """CSV files in capture order; long walks span several files."""
    text = manifest_text(manifest)
    (text.repartitionByRange("walk_id", "face_idx").sortWithinPartitions("walk_id", "face_idx")
     .write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path))


def read_manifest_csv(spark: SparkSession, path: str, walk_type: str = "long") -> DataFrame:
    schema = f"walk_id {walk_type}, face_idx int, " + ", ".join(f"{c} string" for c in MANIFEST_COLUMNS)
    text = spark.read.schema(schema).option("header", True).csv(path)
    return manifest_typed(text.fillna("", ["anchor", "cosine"]))


def vector_alignment(manifest: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per walk: faces, vectors, faces without a vector, vectors without a face."""
    faces = manifest.select("walk_id", "face_idx", F.lit(1).alias("_f"))
    have = vectors.select("walk_id", "face_idx", F.lit(1).alias("_v"))
    both = faces.join(have, ["walk_id", "face_idx"], "full_outer")
    return (both.groupBy("walk_id").agg(
                F.count("_f").alias("faces"), F.count("_v").alias("vectors"),
                F.count_if(F.col("_v").isNull()).alias("without_vector"),
                F.count_if(F.col("_f").isNull()).alias("without_face"))
            .withColumn("aligned", (F.col("without_vector") == 0) & (F.col("without_face") == 0)))


def with_vectors(manifest: DataFrame, vectors: DataFrame) -> DataFrame:
    """The manifest with each face's vector; a face without one fails the job."""
    keyed = vectors.select("walk_id", "face_idx", "embedding")
    joined = manifest.join(keyed, ["walk_id", "face_idx"], "left")
    named = F.concat(F.lit("no vector for face "), F.col("face_idx").cast("string"),
                     F.lit(" of walk "), F.col("walk_id").cast("string"))
    return joined.withColumn("embedding", F.coalesce(
        "embedding", F.raise_error(named).cast("array<float>")))


def record_json(records: DataFrame) -> DataFrame:
    return records.select("walk_id", F.to_json(F.struct(
        *[c for c in records.columns if c != "walk_id"])).alias("json"))


def read_record_json(text: DataFrame) -> DataFrame:
    """Calibration records from (walk_id, json); anything but an object is no record."""
    parsed = text.withColumn("_r", parse_object(F.col("json"), RECORD_SCHEMA))
    return parsed.filter("_r IS NOT NULL").select("walk_id", "_r.*")


def parse_object(text: Column, schema: str) -> Column:
    """A JSON object by schema; NULL for missing, torn or other JSON."""
    read = F.from_json(text, f"{schema}, _corrupt string",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return F.when(F.trim(text).startswith("{") & read["_corrupt"].isNull(), read)


def parse_runs(lines: DataFrame, schema: str = RUN_SCHEMA) -> DataFrame:
    """Adds `parsed` to run-log lines (walk_id, seq, line); NULL for torn ones."""
    return lines.withColumn("parsed", parse_object(F.col("line"), schema))


def run_line(rows: DataFrame) -> DataFrame:
    """Run records as log lines: walk_id, line."""
    return rows.select("walk_id", F.to_json(F.struct(
        *[c for c in rows.columns if c != "walk_id"])).alias("line"))


def append(table: DataFrame, path: str) -> None:
    """Append-only logs: decisions, runs, progress, failures."""
    table.write.mode("append").parquet(path)


def replace_walks(table: DataFrame, path: str) -> None:
    """Overwrites only the walks in `table`; others under `path` stay."""
    (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("walk_id").parquet(path))
