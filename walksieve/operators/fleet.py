"""Runs over many walks: counts, history, re-run plans, recovery, stage states."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walksieve.functions.ordinals import previous_row
from walksieve.operators.review import review_counts
from walksieve.params import (BACKBONE_SIZE, MAX_PROMPT_CLASSES, RUNS_KEPT, SECTION_STAGE,
                              SEGMENTER_KIND, STAGES, WalkParams)


def stage_no(stage: Column) -> Column:
    """Place of a stage in the run, 1-based; 0 for other names."""
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage).cast("int")


# ---- counts --------------------------------------------------------------

def selection_summary(manifest: DataFrame) -> DataFrame:
    """Per walk: faces, anchors, absorbed (all others, solos included) and solo."""
    return manifest.groupBy("walk_id").agg(
        F.count(F.lit(1)).alias("faces"), F.count_if("kept").alias("anchors"),
        F.count_if(~F.col("kept")).alias("absorbed"), F.count_if("solo").alias("solo"))


def run_rows(manifest: DataFrame, records: DataFrame, thresholds: DataFrame, backbone: str,
             entered: str) -> DataFrame:
    """One run record per walk, as logged after a selection.

    `thresholds`: walk_id, rule, tau.
    """
    facts = records.select(
        "walk_id", F.col("reference.median").alias("reference"), F.col("reference.n").alias("pairs"),
        F.col("far.n").alias("far_pairs"), F.col("far.p99").alias("far_p99"), "false_merge_pct")
    return (selection_summary(manifest).join(thresholds.select("walk_id", "rule", "tau"), "walk_id")
            .join(facts, "walk_id", "left")
            .withColumn("backbone", F.lit(backbone)).withColumn("entered", F.lit(entered)))


def stage_counts(recordings: DataFrame, panos: DataFrame, manifest: DataFrame, state: DataFrame,
                 records: DataFrame, segmented: DataFrame, mix: DataFrame,
                 last_runs: DataFrame) -> DataFrame:
    """The funnel of each walk in `recordings`, one row per walk.

    `segmented`: walk_id, path. `mix`: the few top classes of a walk, from
    `class_mix`. `last_runs`: walk_id, solo of the newest run.
    """
    faces = manifest.groupBy("walk_id").agg(
        F.count(F.lit(1)).alias("faces"), F.count_if("kept").alias("anchors"))
    sharp = (manifest.select("walk_id", "pano_idx").distinct()
             .groupBy("walk_id").agg(F.count(F.lit(1)).alias("sharp")))
    calibrated = records.select(
        "walk_id", F.col("reference.n").alias("pairs"), F.col("reference.median").alias("reference"),
        F.col("far.n").alias("far_pairs"), F.col("tau").alias("calib_tau"))
    parts = [faces, sharp, calibrated,
             panos.groupBy("walk_id").agg(F.count(F.lit(1)).alias("panos")),
             segmented.groupBy("walk_id").agg(F.count(F.lit(1)).alias("segmented")),
             mix.groupBy("walk_id").agg(F.array_sort(F.collect_list(
                 F.struct("rank", "class", "share"))).alias("class_mix")),
             review_counts(manifest, state), last_runs.select("walk_id", "solo")]
    joined = recordings.select("walk_id", "frames", "seconds", "lenses", F.when(
        F.col("width").isNotNull(), F.concat_ws("x", "width", "height")).otherwise("").alias("source"))
    for part in parts:
        joined = joined.join(part, "walk_id", "left")
    counts = ["panos", "sharp", "faces", "pairs", "far_pairs", "segmented", "anchors", "solo",
              "dropped", "overridden"]
    return joined.select(
        "walk_id", "frames", "seconds", "source", "lenses",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("reference", F.lit(0.0)).alias("reference"),
        F.coalesce("calib_tau", F.lit(0.0)).alias("calib_tau"),
        F.coalesce("class_mix", F.array().cast("array<struct<rank:int,class:string,share:double>>"))
        .alias("class_mix"),
    ).withColumn("absorbed", F.col("faces") - F.col("anchors")) \
        .withColumn("kept", F.col("anchors") - F.col("dropped"))


# ---- progress log --------------------------------------------------------

def stage_durations(progress: DataFrame) -> DataFrame:
    """Finished stages with their wall time: job, stage, seq, seconds.

    `progress`: job, stage, status, seq (unique integer), at. A stage counts
    from its last `running` to the next `done`; a `done` without a start gives
    nothing.
    """
    marks = progress.filter(F.col("status").isin("running", "done"))
    paired = previous_row(marks.select("job", "stage", "status", "seq", "at"),
                          ["job", "stage"], "seq", ["status", "at"])
    spent = F.timestamp_diff("MICROSECOND", F.col("previous.at"), F.col("at"))
    return (paired.filter((F.col("status") == "done") & (F.col("previous.status") == "running"))
            .select("job", "stage", "seq", F.round(spent / 1e6, 1).alias("seconds")))


def stage_seconds(durations: DataFrame) -> DataFrame:
    """The latest duration of each stage of a job."""
    return durations.groupBy("job", "stage").agg(F.max_by("seconds", "seq").alias("seconds"))


def run_history(runs: DataFrame, limit: int = RUNS_KEPT, keep: int = RUNS_KEPT) -> DataFrame:
    """The newest lines of each walk's run log: adds `recency`, 1 for the newest.

    Only the last `keep` lines exist; `limit` of them are returned. Blank lines
    are not kept. Torn lines (`parsed` NULL) take a place but are not returned.
    """
    newest = Window.partitionBy("walk_id").orderBy(F.desc("seq"))
    lines = runs.filter(F.trim("line") != "")
    return (lines.withColumn("_line", F.row_number().over(newest)).filter(F.col("_line") <= keep)
            .filter("parsed IS NOT NULL")
            .withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= limit)
            .drop("_line"))


def latest_failures(log: DataFrame) -> DataFrame:
    """Open failures: walk_id, stage, message, seq.

    `log`: walk_id, seq, kind ('failed' or 'finished'), stage, message. A later
    failure replaces an earlier one and a finished run clears it.
    """
    newest = F.max_by(F.struct("kind", "stage", "message", "seq"), F.col("seq")).alias("_last")
    return (log.groupBy("walk_id").agg(newest).filter(F.col("_last.kind") == "failed")
            .select("walk_id", "_last.stage", "_last.message", "_last.seq"))


# ---- re-running ----------------------------------------------------------

#: How each setting's JSON text is read.
NUMBERS = {"gate.dead", "faces.fov_deg", "calib.far_seconds", "calib.false_merge_pct", "segment.threshold",
           "dedup.tau", "dedup.solo_floor", "dedup.solo_span"}
WHOLE_NUMBERS = {"faces.size", "embed.batch_size", "calib.samples"}
NUMBER_LISTS = {"gate.band", "faces.yaws"}
NAMES = {"dedup.rule", "embed.model_name", "segment.model_name"}
NAME_LISTS = {"segment.classes"}
SWITCHES = {"segment.enabled"}
_JSON_NUMBER = r"^\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"


def read_setting(at: Column, text: Column) -> Column:
    """A setting's JSON text as one typed value; every part is NULL if it has another type."""
    number = F.when(text.rlike(_JSON_NUMBER), text.try_cast("double"))
    number = F.when(at.isin(*NUMBERS) | (at.isin(*WHOLE_NUMBERS) & (number == F.floor(number))), number)
    wrapped = F.concat(F.lit('{"v":'), text, F.lit("}"))
    quoted = F.trim(text).startswith('"')
    whole = F.from_json(text, "array<double>")
    return F.struct(
        number.alias("number"),
        F.when(at.isin(*NUMBER_LISTS), whole).alias("numbers"),
        F.when(at.isin(*NAMES) & quoted, F.get_json_object(wrapped, "$.v")).alias("name"),
        F.when(at.isin(*NAME_LISTS), F.filter(F.from_json(text, "array<string>"), lambda c: F.trim(c) != "")).alias("names"),
        F.when(at.isin(*SWITCHES), F.trim(text).try_cast("boolean")).alias("switch"))


def value_allowed(at: Column, read: Column) -> Column:
    """Whether a value read by :func:`read_setting` is in range."""
    number, numbers, names = read["number"], read["numbers"], read["names"]
    # fixed values: bounds of each numeric setting (low, low included, high, high included)
    bounds = {
        "gate.dead": (0.0, True, 1.0, False),
        "faces.fov_deg": (10.0, False, 180.0, False),
        "faces.size": (64.0, True, 4096.0, True),
        "embed.batch_size": (1.0, True, 64.0, True),
        "calib.samples": (2.0, True, 200.0, True),
        "calib.far_seconds": (2.0, True, 600.0, True),
        "calib.false_merge_pct": (0.0, False, 50.0, True),
        "segment.threshold": (0.0, False, 1.0, False),
        "dedup.tau": (0.0, False, 1.0, False),
        "dedup.solo_floor": (0.0, True, 1.0, False),
        "dedup.solo_span": (0.0, False, float("inf"), False),
    }
    named = {
        "dedup.rule": ("fixed", "calibrated"),
        "embed.model_name": tuple(BACKBONE_SIZE),
        "segment.model_name": tuple(SEGMENTER_KIND),
    }
    case = F.when(F.lit(False), F.lit(False))
    for key, (low, low_in, high, high_in) in bounds.items():
        above = number >= low if low_in else number > low
        below = number <= high if high_in else number < high
        case = case.when(at == key, above & below)
    for key, allowed in named.items():
        case = case.when(at == key, read["name"].isin(*allowed))
    case = case.when(at == "gate.band", (F.size(numbers) == 2) & (numbers[0] >= 0)
                     & (numbers[0] < numbers[1]) & (numbers[1] <= 1))
    case = case.when(at == "faces.yaws", (F.size(numbers) > 0)
                     & (F.size(F.array_distinct(numbers)) == F.size(numbers))
                     & F.forall(numbers, lambda y: (y >= 0) & (y < 360) & (y == F.floor(y))))
    case = case.when(at == "segment.classes", (F.size(names) > 0)
                     & (F.size(names) <= MAX_PROMPT_CLASSES))
    case = case.when(at == "segment.enabled", read["switch"].isNotNull())
    return F.coalesce(case, F.lit(False))     # anything else is an unknown setting


def setting_allowed(section: Column, field: Column, value: Column) -> Column:
    """Whether a patched value, given as JSON text, is in range."""
    at = F.concat_ws(".", section, field)
    return value_allowed(at, read_setting(at, value))


def settings_text(params: WalkParams) -> dict[str, str]:
    """JSON text of every setting that can be patched, by section.field."""
    return {f"{section}.{name}": json.dumps(value) for section, values in params.to_dict().items()
            if section in SECTION_STAGE for name, value in values.items()}


def rerun_plan(stored: DataFrame, patches: DataFrame, has_sketch: DataFrame) -> DataFrame:
    """What each settings request leads to.

    `stored`: walk_id, section, field, value; a setting that is not stored has its
    default. `patches`: request_id, walk_id, section, field, value. `has_sketch`:
    walk_id of walks whose calibration record can answer a new budget. Values are
    JSON text and are compared as what they say: 110 is 110.0, and white space in a
    list is no change. Columns: request_id, walk_id, outcome (rejected, unchanged,
    inline or queued), first_stage, changed, needs_video.

    The stored settings are joined by merging: they are often made by exploding a walk's
    row, which the planner takes for as small as before and would broadcast.
    """
    stage_of = F.element_at(F.create_map(*[F.lit(x) for kv in SECTION_STAGE.items() for x in kv]),
                            F.col("section"))
    default = F.create_map(*[F.lit(x) for kv in settings_text(WalkParams()).items() for x in kv])
    current = stored.select("walk_id", "section", "field", F.col("value").alias("_stored"))
    name = F.concat_ws(".", "section", "field")
    rows = (patches.filter("value IS NOT NULL")
            .join(current.hint("merge"), ["walk_id", "section", "field"], "left")
            .withColumn("_name", name)
            .withColumn("_asked", read_setting(F.col("_name"), F.col("value")))
            .withColumn("_now", read_setting(F.col("_name"), F.coalesce("_stored", F.try_element_at(default, F.col("_name")))))
            .withColumn("_ok", value_allowed(F.col("_name"), F.col("_asked")))
            .withColumn("_changed", ~F.col("_asked").eqNullSafe(F.col("_now"))))
    requests = rows.groupBy("request_id", "walk_id").agg(       # a request names each setting once
        F.min("_ok").alias("_ok"),
        F.array_sort(F.collect_set(F.when(F.col("_changed"), F.col("_name")))).alias("_names"),
        F.min(F.when(F.col("_changed"), stage_no(stage_of))).alias("_first"))
    sketch = has_sketch.select("walk_id", F.lit(True).alias("_sketch")).distinct()
    budget_only = F.col("_names") == F.array(F.lit("calib.false_merge_pct"))
    first = F.when(budget_only & F.coalesce("_sketch", F.lit(False)), stage_no(F.lit("select"))) \
        .otherwise(F.col("_first"))
    outcome = (F.when(~F.col("_ok"), "rejected").when(F.col("_first").isNull(), "unchanged")
               .when(F.col("_at") == order_no("select"), "inline").otherwise("queued"))
    live = F.col("outcome").isin("inline", "queued")
    return (requests.join(sketch, "walk_id", "left").withColumn("_at", first)
            .withColumn("outcome", outcome)
            .select("request_id", "walk_id", "outcome",
                    F.when(live, F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("_at")))
                    .alias("first_stage"),
                    F.when(live, F.concat_ws(",", "_names")).otherwise("").alias("changed"),
                    (live & (F.col("_at") <= order_no("calibrate"))).alias("needs_video")))


def order_no(stage: str) -> int:
    return STAGES.index(stage) + 1


def stalled_runs(inventory: DataFrame) -> DataFrame:
    """Walks whose run died without a record: walk_id, stage, cause.

    `inventory`: walk_id, job_stage (NULL without a sentinel, '' for a fresh
    run), has_source, has_manifest, has_failure, has_panos.
    """
    entry = F.when(F.col("has_panos"), F.lit("gate")).otherwise(F.lit("stitch"))
    sentinel = F.col("job_stage").isNotNull()
    silent = F.col("has_source") & ~F.col("has_manifest") & ~F.col("has_failure")
    return inventory.filter(sentinel | silent).select(
        "walk_id",
        F.when(sentinel & (F.col("job_stage") != ""), F.col("job_stage")).otherwise(entry).alias("stage"),
        F.when(sentinel, F.lit("unfinished job")).otherwise(F.lit("no outcome")).alias("cause"))


def retry_plan(failures: DataFrame, recordings: DataFrame) -> DataFrame:
    """Where each failed walk goes in again; a walk without its video cannot.

    `recordings`: walk_id of walks whose video is there. `enter_at` is 'start'
    for a run from the beginning.
    """
    stage = F.coalesce("stage", F.lit(""))
    known = (stage_no(stage) > 0) & (stage != "stitch")
    video = recordings.select("walk_id", F.lit(True).alias("_video")).distinct()
    return (failures.join(video, "walk_id", "left")
            .select("walk_id", stage.alias("failed_stage"),
                    F.when(F.col("_video").isNotNull(),
                           F.when(known, stage).otherwise(F.lit("start"))).alias("enter_at"),
                    F.col("_video").isNull().alias("video_missing")))


def stage_states(walks: DataFrame) -> DataFrame:
    """State of every stage of every walk: walk_id, stage_no, stage, state.

    `walks`: walk_id, faces, failed_stage (NULL without a failure).
    """
    shown = ["video", *STAGES, "review"]
    broke = F.coalesce(stage_no(F.col("failed_stage")), F.lit(0))
    at = stage_no(F.col("stage"))
    unfinished = F.col("faces") == 0
    state = (F.when(F.col("stage") == "video", "done")
             .when(~unfinished, "done")
             .when(F.col("stage") == "review", "queued")
             .when(broke == 0, "queued")
             .when(at < broke, "done").when(at == broke, "error").otherwise("queued"))
    return (walks.select("walk_id", "faces", "failed_stage", F.posexplode(
                F.array(*[F.lit(s) for s in shown])).alias("stage_no", "stage"))
            .select("walk_id", "stage_no", "stage", state.alias("state")))
