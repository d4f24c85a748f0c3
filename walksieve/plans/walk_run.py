"""A run over many walks, entered at any stage after the stitch.

Each stage ends in a Parquet table under the run's folder. A run entered lower
down reads the tables above it and recomputes the rest, so a changed threshold
never touches images or vectors.

Image rows are large and stay where they are read: scoring, projection and
embedding are maps over them, and what is sorted, joined or numbered is a table
of keys. The gate is applied to the images by the walk's floor, one row per walk
in a written table, whose size Spark knows when it plans the join; scoring again
is cheaper than moving pixels.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from walksieve.functions.ordinals import integer_ordinal
from walksieve.operators import calibration, frames, images, segmentation, selection
from walksieve.operators.fleet import latest_failures, run_rows, settings_text
from walksieve.operators.pairs import BLOCK
from walksieve.params import STAGES, WalkParams
from walksieve.session import written
from walksieve.sources.parts import Files, Numbers, Part, Parts
from walksieve.sources.tables import run_line


@dataclass(frozen=True)
class Inputs:
    """What a run reads from outside. `panos` (walk_id, pano_idx, t_sec, image)
    is needed down to the faces, `neighbours` (walk_id, frame_no, yaw, image)
    down to calibration."""
    panos: DataFrame | None = None
    neighbours: DataFrame | None = None
    native_fps: float = 30.0


class StageTables:
    """The Parquet tables of a fleet under one folder, kept per walk.

    A write takes the next number of the fleet as its version: its rows become a part of
    the table, and the table's version log notes which walks they stand for. Reading takes
    each walk's newest version and opens only the parts that hold one, so a write replaces
    the walks it names and no others, rewrites nothing, and a run that fails half-way leaves
    every walk with what it had. Logs are only appended to.

    `forget` is one short write that all readers honour: what a walk had before is gone from
    every table and log at once, and later runs of it count. `compact` then takes outdated and
    forgotten rows off the disk, rewriting only the parts that hold some.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.numbers = Numbers(spark, f"{self.folder}/_numbers")
        self.gone = Parts(spark, f"{self.folder}/_forgotten")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _rows(self, name: str) -> Parts:
        return Parts(self.spark, f"{self.path(name)}/rows")

    def _versions(self, name: str) -> Parts:
        return Parts(self.spark, f"{self.path(name)}/versions")

    def _log(self, name: str) -> Parts:
        return Parts(self.spark, f"{self.path(name)}/log")

    def _unforgotten(self, rows: DataFrame) -> DataFrame:
        """Rows (walk_id, version, ...) written after their walk was last forgotten."""
        gone = self.gone.read()
        if gone is None or "walk_id" not in rows.columns:
            return rows
        last = gone.groupBy("walk_id").agg(F.max("version").alias("_gone"))
        return rows.join(last, "walk_id", "left").filter("_gone IS NULL OR version > _gone").drop("_gone")

    def _newest(self, name: str) -> DataFrame:
        """walk_id, version: what counts of a table, one row per walk."""
        entries = self._versions(name).read()
        if entries is None:
            raise ValueError(f"the store has no table {name!r}")
        return self._newest_of(entries)

    def parts_of(self, name: str, newest: DataFrame) -> list[Part]:
        """The parts that hold versions of `newest` (one at least, for the columns)."""
        held = {r[0] for r in newest.select("version").distinct().collect()}    # one value per write
        live = self._rows(name).live()
        return [p for p in live if held.intersection(p.holds)] or live[:1]

    def read(self, name: str, walks: DataFrame | None = None, wide: bool = False) -> DataFrame:
        """The current rows of all walks, or of those in `walks`.

        For `wide` rows (images) the list of versions is written first: the planner then
        knows its size and sends it to the rows rather than the rows to it.
        """
        newest = self._newest(name)
        if walks is not None:
            newest = newest.join(walks.select("walk_id").distinct(), "walk_id", "left_semi")
        if wide:
            newest = written(newest, "newest")
        rows = self._rows(name).read(self.parts_of(name, newest))
        return rows.join(newest, ["walk_id", "version"], "left_semi").drop("version")

    def write(self, name: str, table: DataFrame, walks: DataFrame | None = None) -> DataFrame:
        """Replaces the rows of `walks` (of the walks in `table` if not given) and returns the new ones."""
        version = self.numbers.take()
        marked = F.lit(version).cast("long").alias("version")
        parts = self._rows(name)
        parts.add(table.select("*", marked), version)
        rows = self.spark.read.parquet(f"{parts.folder}/part-{version:012d}")
        told = (rows if walks is None else walks).select("walk_id").distinct()
        self._versions(name).add(told.select("walk_id", marked), version)
        return rows.drop("version")

    def counted(self, name: str, table: DataFrame, walks: DataFrame | None = None,
                of: Column | None = None) -> tuple[DataFrame, int]:
        """As `write`, with the number of rows (those where `of` is true), which the job that
        writes them takes on its way."""
        seen = Observation()
        which = F.lit(True) if of is None else of
        rows = self.write(name, table.observe(seen, F.count_if(which).alias("rows")), walks)
        return rows, seen.get.get("rows", 0)

    def has(self, name: str) -> bool:
        return bool(self._versions(name).live())

    def logged(self, name: str) -> bool:
        return bool(self._log(name).live())

    def log(self, name: str) -> DataFrame:
        rows = self._log(name).read()
        if rows is None:
            raise ValueError(f"the store has no log {name!r}")
        return self._unforgotten(rows).drop("version")

    def append(self, name: str, table: DataFrame) -> None:
        number = self.numbers.take()
        self._log(name).add(table.withColumn("version", F.lit(number).cast("long")), number)

    def forget(self, walks: DataFrame) -> None:
        """From now on nothing written before of `walks` (walk_id) is read."""
        number = self.numbers.take()
        self.gone.add(walks.select("walk_id", F.lit(number).cast("long").alias("version")).distinct(), number)

    def compact(self, most: int = 64) -> dict[str, int]:
        """Takes outdated and forgotten rows off the disk; returns the parts rewritten per table.

        Of a stage table only parts with such rows are rewritten, and the smallest ones beyond
        `most`; its version log becomes one row per walk. A log is rewritten where forgotten
        walks are in it or it has more than `most` parts. Forgotten walk_ids stay noted, so
        that a write begun before does not bring a walk back.
        """
        done = {}
        for name in Files(self.spark, self.folder).names():
            if name.startswith("_"):
                continue
            if self.has(name):
                done[name] = self._compact_table(name, most)
            elif self._log(name).live():
                done[name] = self._compact_log(name, most)
        self.numbers.trim()
        return done

    def _beyond(self, parts: Parts, most: int, noted: set[int] | None = None) -> list[Part]:
        """The smallest parts, if there are more than `most`. A part whose version is not
        `noted` yet belongs to a write that is still going on and is left alone."""
        live = [p for p in parts.live() if noted is None or p.level or noted.issuperset(p.holds)]
        if len(live) <= most:
            return []
        return sorted(live, key=lambda p: parts.files.size(p.name))[:len(live) - most + 1]

    def _compact_table(self, name: str, most: int) -> int:
        rows, log = self._rows(name), self._versions(name)
        noted = log.live()
        entries = written(log.read(noted), "entries")
        newest = written(self._newest_of(entries), "newest")
        known = {r[0] for r in entries.select("version").distinct().collect()}
        outdated = {r[0] for r in entries.join(newest, ["walk_id", "version"], "left_anti").select("version").distinct().collect()}
        chosen = {p.name: p for p in rows.live() if outdated.intersection(p.holds)} | {p.name: p for p in self._beyond(rows, most, known)}
        if chosen:
            kept = rows.read(list(chosen.values())).join(newest, ["walk_id", "version"], "left_semi")
            rows.merge(list(chosen.values()), kept, self.numbers.take())
        if outdated or len(noted) > most:
            log.merge(noted, newest, self.numbers.take())
        return len(chosen)

    def _newest_of(self, entries: DataFrame) -> DataFrame:
        return self._unforgotten(entries.groupBy("walk_id").agg(F.max("version").alias("version")))

    def _compact_log(self, name: str, most: int) -> int:
        log, gone = self._log(name), self.gone.read()
        chosen = {p.name: p for p in self._beyond(log, most)}
        rows = log.read()
        if gone is not None and "walk_id" in rows.columns:
            last = gone.groupBy("walk_id").agg(F.max("version").alias("_gone"))
            stale = {r[0] for r in rows.join(last, "walk_id").filter("version <= _gone").select("version").distinct().collect()}
            chosen |= {p.name: p for p in log.live() if stale.intersection(p.holds)}
        if chosen:
            log.merge(list(chosen.values()), self._unforgotten(log.read(list(chosen.values()))), self.numbers.take())
        return len(chosen)


class Progress:
    """Tells a callback about stages and keeps what it told.

    `tell(stage, status, count)` is called with 'running' and 'done'; `count` is the
    number of rows a stage came to, if it has one.
    """

    def __init__(self, tell: Callable[[str, str, int | None], None] | None = None):
        self.tell = tell or (lambda stage, status, count: None)
        self.told: list[tuple[str, str, float]] = []

    def __call__(self, stage: str, status: str, count: int | None = None) -> None:
        self.told.append((stage, status, time.monotonic()))
        self.tell(stage, status, count)

    def seconds(self) -> Column:
        """Stage durations as a map column: from the last start to the end that followed."""
        begun, took = {}, {}
        for stage, status, at in self.told:
            if status == "running":
                begun[stage] = at
            elif stage in begun:
                took[stage] = round(at - begun[stage], 1)
        return F.create_map(*[F.lit(x) for item in took.items() for x in item]).cast("map<string,double>")


def progress_log(tables: StageTables, job: str) -> Callable[[str, str, int | None], None]:
    """A progress callback that appends to the fleet's progress log."""
    def note(stage: str, status: str, count: int | None) -> None:
        tables.append("progress", tables.spark.range(1).select(
            F.lit(job).alias("job"), F.lit(stage).alias("stage"), F.lit(status).alias("status"),
            F.lit(count).cast("long").alias("count"),
            F.lit(time.time_ns()).alias("seq"), F.current_timestamp().alias("at")))
    return note


def number_faces(faces: DataFrame) -> DataFrame:
    """Dense face_idx per walk: panorama order, then heading."""
    key = F.col("pano_idx").cast("long") * 360 + F.col("yaw")
    return integer_ordinal(faces.withColumn("_key", key), ["walk_id"], "_key", "face_idx") \
        .withColumn("face_idx", F.col("face_idx").cast("int")).drop("_key")


def run_walks(tables: StageTables, inputs: Inputs, params: WalkParams,
              embedder: Callable, segmenter: Callable | None = None, first: str = "gate",
              block: int = BLOCK, progress: Callable[[str, str, int | None], None] | None = None,
              walks: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Runs walks from stage `first` and returns one run record per walk.

    While the run goes on its walks have a job sentinel with the stage they entered at; a run
    that dies leaves it, which `fleet.stalled_runs` finds in the `inventory`. `labels`
    (class_id, label) is the segmentation model's vocabulary.

    The walks are those of `walks` (walk_id) if given, else of the panoramas where the
    run needs them, else all. Others keep their tables. Walks that cannot go on
    (nothing left after the gate, a blank picture, no threshold) are noted in the
    failure log, keep what they had before, and the others carry on.
    """
    if first not in STAGES or first == "stitch":
        raise ValueError(f"a run cannot be entered at {first!r}")
    enters = lambda stage: STAGES.index(first) <= STAGES.index(stage)
    told = Progress(progress)
    for stage in STAGES[:STAGES.index(first)]:
        told(stage, "done")
    panos = inputs.panos
    if panos is not None and walks is not None:
        panos = panos.join(walks.select("walk_id").distinct(), "walk_id", "left_semi")
    if enters("faces"):
        if panos is None:
            raise ValueError(f"a run from {first} needs the panoramas")
        going = written((panos if walks is None else walks).select("walk_id").distinct(), "walks")
        begin_job(tables, going, first)
        scored = panos.withColumn("score", images.pano_sharpness(F.col("image"), params.gate))
        if enters("gate"):
            told("gate", "running")
            scores = tables.write("scores", scored.select("walk_id", "pano_idx", "t_sec", "score"), going)
            floors = tables.write("gate_floors", frames.gate_floors(scores, params.gate), going)
            sharp, sharp_rows = tables.counted("sharp", frames.above_floor(scores, floors), going)
            emptied = frames.emptied_walks(scores.select("walk_id").distinct(), sharp)
            note_failures(tables, emptied.withColumn("message", F.lit("no panorama passed the gate")), "gate")
            told("gate", "done", sharp_rows)
        told("faces", "running")
        kept = frames.above_floor(scored, tables.read("gate_floors", going))
        pictures = tables.write("face_images", images.render_faces(kept, params.faces))
        faces, face_rows = tables.counted("faces", number_faces(pictures.drop("image")))
        told("faces", "done", face_rows)
    else:
        faces = tables.read("faces", walks)
        going = written(faces.select("walk_id").distinct(), "walks")
        begin_job(tables, going, first)
    begun = going
    going = written(faces.select("walk_id").distinct(), "walks")
    if going.isEmpty():
        end_job(tables, begun)
        raise RuntimeError("the run has no faces: the gate left none")
    if enters("embed"):
        told("embed", "running")
        embedded = images.embed_images(tables.read("face_images", going, wide=True).select("walk_id", "path", "image"),
                                       embedder, params.embed.batch_size).drop("image")
        # vectors without an image are short: one copy serves the check and the table
        embedded = written(embedded, "embedded")
        blank = written(embedded.filter("problem <> ''").groupBy("walk_id").agg(F.min("problem").alias("message")), "blank")
        note_failures(tables, blank, "embed")
        going = written(going.join(blank, "walk_id", "left_anti"), "walks")
        _, made = tables.counted("vectors", faces.join(going, "walk_id", "left_semi").select("walk_id", "face_idx", "path")
                            .join(embedded.drop("problem"), ["walk_id", "path"])
                            .withColumn("model", F.lit(params.embed.model_name)), going)
        told("embed", "done", made)
    if enters("calibrate"):
        if inputs.neighbours is None:
            raise ValueError(f"a run from {first} needs the frames after the sampled ones")
        told("calibrate", "running")
        near = inputs.neighbours.join(going, "walk_id", "left_semi")
        if "embedding" not in near.columns:
            # only the frames that are compared are worth embedding
            asked = calibration.reference_frames(faces, inputs.native_fps, params.calib.samples)
            near = near.join(asked, ["walk_id", "frame_no"], "left_semi")
            near = images.embed_images(near, embedder, params.embed.batch_size).filter("problem = ''").drop("problem")
        tables.write("calibration", calibration.calibrate(
            faces_with_vectors(tables, going), near, inputs.native_fps, params.calib, block)
            .withColumn("model", F.lit(params.embed.model_name)), going)
        told("calibrate", "done")
    done = reselect(tables, params, segmenter, first, block, told, going, labels)
    end_job(tables, begun)
    return done


def begin_job(tables: StageTables, walks: DataFrame, stage: str) -> None:
    """The job sentinel of `walks`: the stage they enter at."""
    tables.write("jobs", walks.select("walk_id", F.lit(stage).alias("job_stage"), F.current_timestamp().alias("at")), walks)


def end_job(tables: StageTables, walks: DataFrame) -> None:
    """Clears the sentinel, for walks that failed as well: their failure is noted."""
    tables.write("jobs", walks.limit(0).select("walk_id", F.lit("").alias("job_stage"), F.current_timestamp().alias("at")), walks)


def inventory(tables: StageTables, recordings: DataFrame, panos: DataFrame) -> DataFrame:
    """What `fleet.stalled_runs` reads: one row per walk with a recording, a sentinel or a manifest.

    `recordings`: walk_id of walks whose video is there; `panos`: walk_id of stitched panoramas.
    """
    def held(name: str) -> DataFrame | None:
        return tables.read(name) if tables.has(name) else None

    def noted(rows: DataFrame | None, flag: str) -> DataFrame | None:
        return None if rows is None else rows.select("walk_id", F.lit(flag).alias("flag"), F.lit(None).cast("string").alias("stage"))

    jobs = held("jobs")
    facts = [noted(recordings, "has_source"), noted(panos, "has_panos"), noted(held("manifest"), "has_manifest"),
             None if jobs is None else jobs.select("walk_id", F.lit("job").alias("flag"), F.col("job_stage").alias("stage")),
             noted(latest_failures(tables.log("failures")), "has_failure") if tables.logged("failures") else None]
    rows = reduce(DataFrame.unionByName, [f for f in facts if f is not None])
    flags = [F.coalesce(F.bool_or(F.col("flag") == f), F.lit(False)).alias(f)
             for f in ("has_source", "has_manifest", "has_failure", "has_panos")]
    return rows.groupBy("walk_id").agg(F.max("stage").alias("job_stage"), *flags)


def faces_with_vectors(tables: StageTables, walks: DataFrame | None = None) -> DataFrame:
    vectors = tables.read("vectors", walks).select("walk_id", "face_idx", "embedding")
    return tables.read("faces", walks).join(vectors, ["walk_id", "face_idx"])


def note_failures(tables: StageTables, failed: DataFrame, stage: str) -> None:
    """Appends (walk_id, message) to the failure log."""
    tables.append("failures", failed.select(
        "walk_id", F.lit(time.time_ns()).alias("seq"), F.lit("failed").alias("kind"),
        F.lit(stage).alias("stage"), "message"))


def requantile(tables: StageTables, params: WalkParams, walks: DataFrame | None = None) -> DataFrame:
    """Answers a new false-merge budget from the stored sketches; returns the new records.

    Walks without a sketch keep their record, since only a new calibration helps them.
    """
    records = tables.read("calibration", walks)
    models = records.select("walk_id", "model")
    again = calibration.requantile(records.drop("model"), params.calib.false_merge_pct)
    return tables.write("calibration", again.join(models, "walk_id"))


def settings_rows(walks: DataFrame, params: WalkParams) -> DataFrame:
    """walk_id, section, field, value (JSON text): what `fleet.rerun_plan` reads as stored."""
    pairs = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("section", "field", "value"), (*name.split("."), text))])
             for name, text in settings_text(params).items()]
    return walks.select("walk_id", F.explode(F.array(*pairs)).alias("s")).select("walk_id", "s.*")


def run_entries(tables: StageTables, inputs: Inputs, entries: DataFrame, params: WalkParams, embedder: Callable,
                segmenter: Callable | None = None, block: int = BLOCK,
                progress: Callable[[str, str, int | None], None] | None = None,
                labels: DataFrame | None = None) -> DataFrame | None:
    """Runs walks that enter at different stages: `entries` is walk_id, enter_at.

    That is what a re-run plan (`first_stage`) or a retry plan asks for; 'start' and
    'stitch' enter at the gate, once the panoramas are there. Walks of one stage run
    together, so there are at most as many runs as stages. Returns the run records.
    """
    at = F.when(F.col("enter_at").isin("start", "stitch"), "gate").otherwise(F.col("enter_at"))
    asked = written(entries.filter("enter_at IS NOT NULL").select("walk_id", at.alias("enter_at")), "entries")
    stages = {r[0] for r in asked.select("enter_at").distinct().collect()}
    done = None
    for first in (s for s in STAGES if s in stages):
        walks = asked.filter(F.col("enter_at") == first).select("walk_id")
        ran = reselect(tables, params, segmenter, first, block, Progress(progress), walks, labels) if first in ("select", "segment") else \
            run_walks(tables, inputs, params, embedder, segmenter, first, block, progress, walks, labels)
        done = ran if done is None else done.unionByName(ran)
    return done


def unfit_walks(vectors: DataFrame, records: DataFrame) -> DataFrame:
    """Walks whose vectors are of another model than their calibration: walk_id, message."""
    made = vectors.select("walk_id", "model").distinct()
    other = made.join(records.select("walk_id", F.col("model").alias("_then")), "walk_id").filter("model <> _then")
    return other.groupBy("walk_id").agg(F.concat(F.lit("calibrated with "), F.min("_then"), F.lit(", vectors of "), F.min("model")).alias("message"))


def reselect(tables: StageTables, params: WalkParams, segmenter: Callable | None = None,
             entered: str = "select", block: int = BLOCK, progress: Progress | None = None,
             walks: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Selection, masks and the run record, from stored faces, vectors and calibration.

    Only walks that have a threshold are selected anew; the others are noted as failed
    and keep the set they had.
    """
    told = progress or Progress()
    told("select", "running")
    records = tables.read("calibration", walks)
    asked = tables.read("vectors", walks).select("walk_id").distinct()
    if params.dedup.rule != "fixed":
        unfit = written(unfit_walks(tables.read("vectors", walks), records), "unfit")
        note_failures(tables, unfit, "select")
        asked = asked.join(unfit, "walk_id", "left_anti")
    asked = asked.select("walk_id", F.lit(params.dedup.rule).alias("rule"), F.lit(params.dedup.tau).alias("tau"))
    thresholds = written(selection.threshold_rule(asked, records), "thresholds")
    note_failures(tables, thresholds.filter("problem <> ''").withColumnRenamed("problem", "message"), "select")
    able = thresholds.filter("problem = ''").select("walk_id")
    manifest, kept = tables.counted("manifest", selection.select_faces(
        faces_with_vectors(tables, able), thresholds, params.dedup, block), of=F.col("kept"))
    told("select", "done", kept)
    # masks belong to the set they were made for: without a segmenter the walks have none
    if params.segment.enabled and segmenter is not None:
        told("segment", "running")
        masks, masked = tables.counted("masks", segmentation.segment_kept(
            tables.read("face_images", able, wide=True).select("walk_id", "path", "image"), manifest, segmenter), able)
        told("segment", "done", masked)
    else:
        masks = tables.write("masks", manifest.limit(0).select(
            "walk_id", "path", F.lit(0).alias("height"), F.lit(0).alias("width"), F.lit(b"").alias("mask")), able)
    vocabulary = manifest.limit(0).select(F.lit(0).alias("class_id"), F.lit("").alias("label")) if labels is None else labels
    model = F.lit(params.segment.model_name).alias("model")
    tables.write("shares", segmentation.class_shares(masks, vocabulary).select("*", model), able)
    tables.write("labels", segmentation.used_labels(masks, vocabulary).select("*", model), able)
    segmented = masks.groupBy("walk_id").agg(F.count(F.lit(1)).alias("segmented"))
    run = time.time_ns()
    rows = (run_rows(manifest, records, thresholds, params.embed.model_name, entered)
            .withColumn("seconds", told.seconds())
            .withColumn("at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
            .join(segmented, "walk_id", "left").withColumn("segmented", F.coalesce("segmented", F.lit(0))))
    latest = tables.write("last_run", rows)
    tables.write("settings", settings_rows(able, params))
    tables.append("runs", run_line(latest.drop("segmented")).withColumn("seq", F.lit(run)))
    tables.append("failures", latest.select(
        "walk_id", F.lit(time.time_ns()).alias("seq"), F.lit("finished").alias("kind"),
        F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("message")))
    return latest
