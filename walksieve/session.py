"""Session settings and durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "walksieve") -> SparkSession:
    """A single-machine session for tests and the bench.

    On a cluster the session comes from spark-submit; only the checkpoint
    folder and the adaptive settings below matter there.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The session's ``spark.checkpoint.dir`` names it. A machine-local folder is
    only made up for a local master; anywhere else a missing setting is an
    error, because executors could not read each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"walksieve-{spark.sparkContext.applicationId}")
    os.makedirs(folder, exist_ok=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the written copy.

    Used where later steps must see one fixed result (ordinals, selection
    rounds). The copy survives the loss of executors.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a short table to the shared folder and read it back.

    The planner then knows its size, so a join with it is broadcast exactly
    when it is small enough, before the other side is shuffled.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
