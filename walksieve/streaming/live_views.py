"""Review state and job board as streams.

Both are per-key aggregates that do not depend on arrival order, so late rows
need no watermark and state grows with the keys, not with the log. Each
micro-batch writes only the keys it changed; a replayed batch overwrites its
own part, so a restart counts nothing twice.

Parts are kept in levels: whenever a level has `fan` of them, they are merged into one
part of the next level, which has each key once. So the parts of a view grow with
the logarithm of its batches, and a row is rewritten once per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from walksieve.operators.review import replay_columns
from walksieve.sources.parts import Parts

FAN = 8


def review_state(decisions: DataFrame) -> DataFrame:
    """Streaming or batch: walk_id, anchor, pick, dropped."""
    return decisions.groupBy("walk_id", "anchor").agg(*replay_columns())


def stage_board(progress: DataFrame) -> DataFrame:
    """Latest status of every stage of every job, with the events seen."""
    return progress.groupBy("job", "stage").agg(
        F.max_by("status", "seq").alias("status"), F.max("seq").alias("last_seq"),
        F.count(F.lit(1)).alias("events"))


def newest_counts(progress: DataFrame, counts: Column | None = None) -> DataFrame:
    """Every count that a job has told, with its newest value: job, name, value, last_seq.

    `counts` (the column of that name if not given) is a map from names to numbers; of
    equal seq the greater value holds. One row per count rather than a map per job, so
    that it is one aggregate and can be kept as a stream.
    """
    told = progress.select("job", "seq", F.explode(F.col("counts") if counts is None else counts).alias("name", "value"))
    return told.groupBy("job", "name").agg(F.max(F.struct("seq", "value")).alias("_last")) \
        .select("job", "name", F.col("_last.value").alias("value"), F.col("_last.seq").alias("last_seq"))


def job_counts(newest: DataFrame) -> DataFrame:
    """The counts of a job as one map: job, counts. For stored or batch rows of `newest_counts`."""
    entries = F.array_sort(F.collect_list(F.struct("name", "value")))
    return newest.groupBy("job").agg(F.map_from_entries(entries).alias("counts"))


def _of_each_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the greatest batch per key, with its batch."""
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    last = F.max_by(F.struct(*values), F.col("batch")).alias("_v")
    return rows.groupBy(*keys).agg(last, F.max("batch").alias("batch")).select(*keys, "_v.*", "batch")


def maintain(view: DataFrame, keys: list[str], path: str, checkpoint: str, available_now: bool = True,
             fan: int = FAN) -> StreamingQuery:
    """Starts keeping `view` under `path`, one part of changes per batch, merged level by level."""
    if fan < 2:
        raise ValueError("a level needs two parts to be merged")
    parts = Parts(view.sparkSession, path)

    def store(changes: DataFrame, batch: int) -> None:
        parts.add(changes.withColumn("batch", F.lit(batch).cast("long")), batch)
        compact(parts, keys, fan)

    writer = (view.writeStream.outputMode("update").foreachBatch(store)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def compact(parts: Parts, keys: list[str], fan: int = FAN) -> None:
    """Merges every level that is full, from the lowest up.

    A merge holds from the moment its note is written; one that died is done again by the
    replayed batch, under the same name. A batch that is replayed after its merge is not
    written again.
    """
    parts.sweep()
    level = 0
    while True:
        live = parts.live()
        full = [p for p in live if p.level == level]
        if len(full) >= fan:
            parts.merge(full, _of_each_key(parts.read(full), keys), max(h for p in full for h in p.holds))
        elif all(p.level <= level for p in live):
            return
        level += 1


def read_view(view: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The newest row of every key written by :func:`maintain`."""
    schema = StructType([*view.schema.fields, StructField("batch", LongType())])
    stored = Parts(view.sparkSession, path).read(schema=schema)
    if stored is None:
        stored = view.sparkSession.createDataFrame([], schema)
    return _of_each_key(stored, keys).select(*view.columns)
