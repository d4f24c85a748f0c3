"""One query per operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from walksieve.operators import (calibration, export, fleet, frames, images, metadata, pairs,
                                 review, segmentation, selection, summaries)
from walksieve.functions import text
from walksieve.functions.vectors import l2_normalise, norm
from walksieve.params import Calib, Dedup, Faces, Gate, Segment, WalkParams
from walksieve.plans.walk_run import Inputs, StageTables, run_walks
from walksieve.plans.walk_run import requantile as requantile_stored
from walksieve.plans.walk_run import reselect as reselect_stored
from walksieve.session import cut, scratch_path
from walksieve.sources import recordings as rec, tables
from walksieve.sources.images import whole_frames
from walksieve.streaming import live_views

Query = Callable[[SparkSession, str], DataFrame]
_stages: dict[tuple[str, str, str], DataFrame] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage table: computed once per session and folder, then read back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        _stages[key] = cut(build())
    return _stages[key]


def records(spark, d) -> DataFrame:
    return stage(spark, d, "records", lambda: calibration.calibrate(
        I.faces(spark, d), I.neighbours(spark, d), I.FPS))


def thresholds(spark, d) -> DataFrame:
    return records(spark, d).select("walk_id", F.lit("calibrated").alias("rule"), "tau")


def manifest(spark, d) -> DataFrame:
    return stage(spark, d, "manifest", lambda: selection.select_faces(
        I.faces(spark, d), thresholds(spark, d)))


def state(spark, d) -> DataFrame:
    return review.replay(I.decisions(spark, d))


def current_shares(spark, d) -> DataFrame:
    shares = segmentation.class_shares(I.masks(spark, d), I.labels(spark))
    return segmentation.current_shares(shares, manifest(spark, d))


def segmented(spark, d) -> DataFrame:
    """Frames with a mask: the kept faces."""
    return manifest(spark, d).filter("kept").select("walk_id", "path")


def r4(*names: str):
    return [F.round(n, 4).alias(n) for n in names]


# ---- sources and sinks ---------------------------------------------------

def recording_catalogue(spark, d):
    return rec.recording_catalogue(I.camera_files(spark, d))


def torn_frames(spark, d):
    files = I.frame_files(spark, d)
    return whole_frames(files).select("doc_id", F.length("content").alias("bytes"))


def pano_index(spark, d):
    return frames.pano_index(I.landed_frames(spark, d), I.FPS).select(
        "walk_id", "frame_no", "pano_idx", *r4("t_sec"))


def missing_panos(spark, d):
    index = frames.pano_index(I.landed_frames(spark, d), I.FPS)
    return frames.missing_panos(index, index.filter("event_type <> 'error'"))


def manifest_file(spark, d):
    return tables.manifest_text(manifest(spark, d))


def manifest_read_back(spark, d):
    return tables.manifest_typed(tables.manifest_text(manifest(spark, d)))


def vector_alignment(spark, d):
    vectors = I.keyed_vectors(spark, d).filter(F.col("embedding")[0] <= 0.25)
    return tables.vector_alignment(manifest(spark, d), vectors)


def run_history(spark, d):
    runs = tables.parse_runs(I.run_lines(spark, d), "faces long, anchors long, solo long")
    return fleet.run_history(runs).select(
        "walk_id", "seq", "recency", "parsed.faces", "parsed.anchors", "parsed.solo")


def segmentation_labels(spark, d):
    kept = I.masks(spark, d).join(segmented(spark, d), ["walk_id", "path"], "left_semi")
    return segmentation.used_labels(kept, I.labels(spark))


def segmentation_record(spark, d):
    return current_shares(spark, d)


def override_log(spark, d):
    return review.override_log(I.decisions(spark, d))


def failure_state(spark, d):
    return fleet.latest_failures(I.failure_log(spark, d))


def export_rows(spark, d):
    return export.export_manifest(manifest(spark, d), state(spark, d), I.walks(spark, d),
                                  current_shares(spark, d))


def export_walk_summary(spark, d):
    return export.export_walk_summary(manifest(spark, d), state(spark, d), I.walks(spark, d),
                                      segmented(spark, d))


def export_payload(spark, d):
    used = thresholds(spark, d).select("walk_id", F.struct("rule", "tau").alias("settings"))
    meta = I.walks(spark, d).select("walk_id", "site", "building", "mount_height_cm")
    payload = export.frame_payload(export_rows(spark, d), meta, used)
    field = lambda p: F.get_json_object("payload", f"$.{p}")
    return payload.select("file", "walk", field("meta.site").alias("site"),
                          field("settings.rule").alias("rule"), field("source_face").alias("source_face"),
                          field("yaw").cast("int").alias("yaw"), field("overridden").alias("overridden"))


# ---- filters and projections ---------------------------------------------

def frame_decimation(spark, d):
    return frames.decimate(I.recordings(spark, d)).select("walk_id", "frame_no", *r4("t_sec"))


def stitch_completeness(spark, d):
    return frames.completeness(frames.decimate(I.recordings(spark, d)), I.landed_stills(spark, d))


def landed_wanted(spark, d):
    kept = frames.drop_stale(I.landed_stills(spark, d), frames.decimate(I.recordings(spark, d)))
    return kept.groupBy("walk_id", "frame_no").agg(F.count(F.lit(1)).alias("copies"))


def legibility_gate(spark, d):
    return frames.legible(I.scored_panos(spark, d))


def surviving_panos(spark, d):
    return frames.surviving_panos(I.scored_panos(spark, d), manifest(spark, d))


def borderline_members(spark, d):
    # every third walk has a fixed rule, every seventh no threshold at all
    in_force = thresholds(spark, d).filter("walk_id % 7 <> 6").withColumn("tau", F.when(F.col("walk_id") % 3 == 1, 0.2).otherwise(F.col("tau")))
    return review.borderline_members(manifest(spark, d), state(spark, d), in_force).select(
        "walk_id", "anchor_idx", "face_idx", "is_anchor", *r4("relative"), "borderline")


def low_reference_pairs(spark, d):
    # far cosines of these vectors lie well under the reference; its median stands in for tau
    strict = records(spark, d).withColumn("tau", F.col("reference.median"))
    return calibration.low_reference_pairs(strict).select("walk_id", "pano", "yaw", "face", "cosine")


def intake_missing(spark, d):
    return frames.intake_missing(I.intake(spark, d)).select("walk_id", "missing", "accepted")


def display_labels(spark, d):
    names = F.array(*[F.lit(n) for n in (
        "vit_base_patch16_dinov3.lvd1689m", "vit_small_patch14_clip_384.x", "resnet50",
        "nvidia/segformer-b4-finetuned-ade-512-512", "facebook/mask2former-swin-large-ade-semantic")])
    pick = F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))
    return I.events(spark, d).select(
        "event_id", text.backbone_label(pick).alias("backbone"), text.segmenter_label(pick).alias("segmenter"),
        text.clock_text(F.col("value")).alias("clock"), text.slug(F.col("props")).alias("slug"))


# ---- images ---------------------------------------------------------------

def sharpness(spark, d):
    rows = I.images(spark, d)
    # times the squared number of pixels, the variance of whole numbers is a whole number
    whole = lambda score, n: F.round(score * (n * n)).cast("long")
    return rows.select("walk_id", "face_idx",
                       whole(images.sharpness(F.col("image")), 64).alias("sharpness"),
                       whole(images.pano_sharpness(F.col("image")), 32).alias("band_sharpness"))


def face_projection(spark, d):
    shown = images.render_faces(I.equirects(spark, d), Faces(size=8))
    return shown.select("walk_id", "pano_idx", "yaw", "path", F.hex("image.data").alias("pixels"))


def embed_faces(spark, d):
    rows = images.embed_images(I.images(spark, d), images.grid_embedder(4))
    return rows.select("walk_id", "face_idx", *[F.round(F.col("embedding")[i].cast("double"), 4).alias(f"v{i}")
                                                for i in (0, 5, 15)])


def l2_normalise_vectors(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1.0))
    unit = I.table(spark, d, "embeddings").select("vec_id", l2_normalise(scaled).alias("v"))
    return unit.select("vec_id", F.round(norm(F.col("v")), 4).alias("length"),
                       F.round(F.col("v")[0].cast("double"), 4).alias("v0"))


def thumbnails(spark, d):
    due = images.stale_thumbs(I.strips(spark, d), I.thumbs(spark, d))
    return images.thumbnails(due).select(
        "name", F.col("image.height").alias("height"), F.hex("image.data").alias("pixels"))


def segment_kept(spark, d):
    made = segmentation.segment_kept(I.images(spark, d), manifest(spark, d), segmentation.band_segmenter())
    return made.select("walk_id", "path", F.hex("mask").alias("mask"))


def detection_labels(spark, d):
    tokens = segmentation.class_tokens(I.CLASSES, I.OFFSETS)
    return segmentation.name_detections(I.detections(spark, d), tokens, 0.6).select(
        "frame_id", "det_idx", "class_id", *r4("score", "x0", "y0", "x1", "y1"))


def mask_composite(spark, d):
    return segmentation.composite(I.instance_masks(spark, d)).select(
        "frame_id", F.hex("mask").alias("mask"))


def mask_boundaries(spark, d):
    return segmentation.boundaries(I.masks(spark, d)).select(
        "walk_id", "path", "edge_pixels", F.hex("edges").alias("edges"))


# ---- joins ------------------------------------------------------------------

def far_pairs(spark, d):
    cells = pairs.far_histogram(I.faces(spark, d), Calib().far_seconds)
    return cells.select("walk_id", "yaw", (F.col("bin") / pairs.BINS).alias("cosine"), "pairs")


def reference_pairs(spark, d):
    return calibration.reference_pairs(I.faces(spark, d), I.neighbours(spark, d), I.FPS, 10)


def similarity_edges(spark, d):
    leveled = I.faces(spark, d).join(records(spark, d).select("walk_id", "tau"), "walk_id")
    return pairs.similar_neighbours(leveled, F.col("tau")).select(
        "walk_id", "face_idx", "neighbours", *r4("best_cosine"), "best_face")


def resolve_pick(spark, d):
    return review.resolve_picks(manifest(spark, d), state(spark, d))


def effective_picks(spark, d):
    return review.effective_picks(manifest(spark, d), state(spark, d))


def validate_decisions(spark, d):
    return review.validate(I.raw_decisions(spark, d), manifest(spark, d))


def review_groups(spark, d):
    return review.in_review_order(review.review_groups(manifest(spark, d), state(spark, d))).select(
        "walk_id", "anchor_idx", "face_idx", "is_anchor", *r4("cosine"), "pick_idx", "dropped")


def segmentation_view(spark, d):
    # every masked face, also where the share rows are of the kept ones
    every = I.masks(spark, d).select("walk_id", "path")
    seen = segmentation.segmentation_view(current_shares(spark, d), every, manifest(spark, d).filter("kept"))
    return seen.select("walk_id", "face", "t_sec", "yaw", F.coalesce(F.concat_ws(
        ";", F.transform("classes", lambda c: c["class"])), F.lit("")).alias("classes"))


def walk_list(spark, d):
    listed = review.walk_list(I.walks(spark, d), manifest(spark, d), state(spark, d),
                              fleet.latest_failures(I.failure_log(spark, d)))
    return listed.select("walk_id", "site", "faces", "kept", "ready", "failed_stage")


# ---- aggregates ---------------------------------------------------------------

def calibrated_tau(spark, d):
    rows = I.faces(spark, d)
    hist = cut(pairs.far_histogram(rows, Calib().far_seconds))
    return calibration.far_quantiles(rows, hist).select("walk_id", "n", "tau")


def calibration_record(spark, d):
    return records(spark, d).select(
        "walk_id", "tau", "false_merge_pct", "healthy", F.size("pairs").alias("pairs"),
        F.col("far.n").alias("far_n"), F.col("far.median").alias("far_median"),
        F.col("far.p95").alias("far_p95"), F.col("far.p99").alias("far_p99"),
        F.col("far.max").alias("far_max"), F.size("far.cosines").alias("sketch"),
        F.col("reference.n").alias("ref_n"), F.col("reference.median").alias("ref_median"),
        F.col("reference.p05").alias("ref_p05"), F.col("reference.min").alias("ref_min"))


def record_round_trip(spark, d):
    back = tables.read_record_json(tables.record_json(records(spark, d)))
    return back.select("walk_id", "tau", F.col("far.n").alias("far_n"), F.size("pairs").alias("pairs"))


def far_sketch(spark, d):
    hist = pairs.far_histogram(I.faces(spark, d), Calib().far_seconds)
    return calibration.far_sketch(hist, keep=100)


def merged_thresholds(spark, d):
    """Thresholds of every heading of a walk, of walks and of the fleet, from merged sketches."""
    size = 4096
    hist = pairs.far_histogram(I.faces(spark, d), Calib().far_seconds)
    parts = cut(summaries.far_summary(hist, ("walk_id", "yaw"), size))
    levels = [parts, summaries.merged(parts, ("walk_id",), size).withColumn("yaw", F.lit(None).cast("int")),
              summaries.merged(parts, (), size).withColumns({"walk_id": F.lit(None).cast("long"), "yaw": F.lit(None).cast("int")})]
    return summaries.summary_quantiles(levels[0].unionByName(levels[1]).unionByName(levels[2]))


def requantile(spark, d):
    return calibration.requantile(records(spark, d), 2.0).select(
        "walk_id", "tau", F.col("far.n").alias("far_n"), F.col("far.p99").alias("far_p99"))


def class_shares(spark, d):
    return segmentation.class_shares(I.masks(spark, d), I.labels(spark))


def class_mix(spark, d):
    return segmentation.class_mix(current_shares(spark, d), segmented(spark, d))


def stage_counts(spark, d):
    runs = tables.parse_runs(I.run_lines(spark, d), "faces long, anchors long, solo long")
    last = fleet.run_history(runs, limit=1).select("walk_id", "parsed.solo")
    counts = fleet.stage_counts(
        I.recordings(spark, d), I.scored_panos(spark, d), manifest(spark, d), state(spark, d),
        records(spark, d), segmented(spark, d), class_mix(spark, d), last)
    return counts.withColumn("class_mix", F.array_join(F.transform("class_mix", lambda c: c["class"]), ","))


def review_counts(spark, d):
    return review.review_counts(manifest(spark, d), state(spark, d))


def selection_summary(spark, d):
    rows = fleet.run_rows(manifest(spark, d), records(spark, d), thresholds(spark, d), "grid", "gate")
    return rows.select("walk_id", "rule", "tau", "faces", "anchors", "absorbed", "solo", "reference",
                       "pairs", "far_pairs", "far_p99", "false_merge_pct", "backbone", "entered")


# ---- windows --------------------------------------------------------------------

def heading_ratio(spark, d):
    return selection.heading_ratio(I.faces(spark, d), Dedup().solo_span).select(
        "walk_id", "face_idx", *r4("ratio"))


def sample_panos(spark, d):
    return calibration.sample_panos(I.scored_panos(spark, d), Calib().samples)


def decision_replay(spark, d):
    return state(spark, d)


def stage_durations(spark, d):
    return fleet.stage_durations(I.progress(spark, d))


def stage_seconds(spark, d):
    return fleet.stage_seconds(fleet.stage_durations(I.progress(spark, d)))


# ---- selection --------------------------------------------------------------------

def greedy_dedup(spark, d):
    return selection.greedy_dedup(I.faces(spark, d), records(spark, d).select("walk_id", "tau")).select(
        "walk_id", "face_idx", "kept", "anchor", *r4("cosine"))


def solo_drop(spark, d):
    return manifest(spark, d).filter("solo").select("walk_id", "face_idx", "path")


def select(spark, d):
    """Calibrates and selects from the vectors alone."""
    rows = I.faces(spark, d)
    hist = cut(pairs.far_histogram(rows, Calib().far_seconds))
    levels = calibration.far_quantiles(rows, hist)
    return selection.select_faces(rows, levels).select(
        "walk_id", "face_idx", "pano_idx", "yaw", "path", "kept", "anchor", *r4("cosine"), "solo")


def select_fixed(spark, d):
    """The fixed rule on faces with a near copy of each."""
    rows = I.faces_and_twins(spark, d)
    levels = rows.select("walk_id").distinct().withColumn("tau", F.lit(Dedup().tau))
    return selection.select_faces(rows, levels).select(
        "walk_id", "face_idx", "path", "kept", "anchor", *r4("cosine"), "solo")


def threshold_sweep(spark, d):
    """Ten thresholds at once, around what the walks select with."""
    return selection.threshold_sweep(I.faces(spark, d), [(15 + 3 * k) / 100 for k in range(10)])


def threshold_rule(spark, d):
    asked = I.walks(spark, d).select(
        "walk_id", F.when(F.col("building") == "BUILDING", "fixed").otherwise("calibrated").alias("rule"),
        F.lit(0.94).alias("tau"))
    return selection.threshold_rule(asked, records(spark, d))


def reselect(spark, d):
    """A new budget and floor over stored vectors: no calibration, no images."""
    again = calibration.requantile(records(spark, d), 20.0)
    stored = manifest(spark, d).drop("kept", "anchor", "cosine", "solo")
    ready = tables.with_vectors(stored, I.keyed_vectors(spark, d))
    return selection.select_faces(ready, again, Dedup(solo_floor=0.3)).select(
        "walk_id", "face_idx", "kept", "anchor", *r4("cosine"), "solo")


# ---- metadata -----------------------------------------------------------------------

def meta_upsert(spark, d):
    return metadata.upsert(I.walks(spark, d), I.meta_changes(spark, d))


def meta_patch(spark, d):
    return metadata.patch(I.walks(spark, d), I.meta_changes(spark, d))


def meta_patch_missing(spark, d):
    return metadata.patch_missing(I.walks(spark, d), I.meta_changes(spark, d))


def meta_unknown_fields(spark, d):
    return metadata.unknown_fields(I.meta_changes(spark, d)).groupBy("field").agg(
        F.count(F.lit(1)).alias("changes"))


def forget_walks(spark, d):
    return metadata.forget(I.walks(spark, d), I.forgotten(spark, d)).select("walk_id", "site", "building")


def forget_decisions(spark, d):
    return metadata.forget(I.decisions(spark, d), I.forgotten(spark, d))


# ---- streams --------------------------------------------------------------------------

def _event_stream(spark, d) -> DataFrame:
    schema = I.events(spark, d).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _drained(spark, view: DataFrame, keys: list[str], label: str) -> DataFrame:
    folder = scratch_path(spark, label)
    live_views.maintain(view, keys, f"{folder}/view", f"{folder}/checkpoint").awaitTermination()
    return live_views.read_view(view, keys, f"{folder}/view")


def decision_replay_stream(spark, d):
    rows = _event_stream(spark, d)
    log = I.decisions_of(I.raw_decisions_of(rows))
    return _drained(spark, live_views.review_state(log), ["walk_id", "anchor"], "review")


def stage_board_stream(spark, d):
    board = live_views.stage_board(I.progress_rows(_event_stream(spark, d)))
    return _drained(spark, board, ["job", "stage"], "board")


def job_counts_stream(spark, d):
    """The newest of every count that jobs tell, kept as a stream; one row per count."""
    told = I.progress_rows(_event_stream(spark, d))
    kept = _drained(spark, live_views.newest_counts(told), ["job", "name"], "counts")
    return live_views.job_counts(kept).select("job", F.explode("counts").alias("name", "value"))


# ---- fleet -------------------------------------------------------------------------------

def rerun_plan(spark, d):
    return fleet.rerun_plan(I.stored_settings(spark, d), I.settings_requests(spark, d),
                            I.sketched_walks(spark, d))


def stalled_runs(spark, d):
    return fleet.stalled_runs(I.inventory(spark, d))


def retry_plan(spark, d):
    present = I.table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("walk_id"))
    return fleet.retry_plan(fleet.latest_failures(I.failure_log(spark, d)), present)


def stage_states(spark, d):
    return fleet.stage_states(walk_list(spark, d).select("walk_id", "faces", "failed_stage"))


def walk_run(spark, d):
    """The whole chain from panoramas to run records, over stored stage tables."""
    panos = I.equirects(spark, d)
    # the frame after each panorama, already cut into faces and embedded
    after = images.embed_images(images.render_faces(panos, Faces(size=8)), images.grid_embedder(4))
    near = after.filter("problem = ''").select("walk_id", (F.bround(F.col("t_sec") * F.lit(I.FPS)).cast("long") + 1).alias("frame_no"),
                        "yaw", "embedding")
    params = WalkParams(faces=Faces(size=8), gate=Gate(dead=0.15), calib=Calib(far_seconds=5.0),
                        segment=Segment(enabled=True))
    stage_tables = StageTables(spark, scratch_path(spark, "walk-run"))
    rows = run_walks(stage_tables, Inputs(panos, near, I.FPS), params,
                     images.grid_embedder(4), segmentation.band_segmenter())
    return rows.select("walk_id", "faces", "anchors", "absorbed", "solo", "tau", "rule",
                       "pairs", "far_pairs", "segmented")


def walk_rerun(spark, d):
    """A fleet run, then a new rule for some walks and a new budget for others; all walks' sets."""
    panos = I.equirects(spark, d)
    after = images.embed_images(images.render_faces(panos, Faces(size=8)), images.grid_embedder(4))
    near = after.filter("problem = ''").select("walk_id", (F.bround(F.col("t_sec") * F.lit(I.FPS)).cast("long") + 1).alias("frame_no"),
                                               "yaw", "embedding")
    params = WalkParams(faces=Faces(size=8), calib=Calib(far_seconds=5.0))
    stage_tables = StageTables(spark, scratch_path(spark, "walk-rerun"))
    run_walks(stage_tables, Inputs(panos, near, I.FPS), params, images.grid_embedder(4))
    walks = panos.select("walk_id").distinct()
    reselect_stored(stage_tables, WalkParams(faces=Faces(size=8), dedup=Dedup(rule="fixed", tau=0.99)), walks=walks.filter("walk_id % 2 = 1"))
    tight = WalkParams(faces=Faces(size=8), calib=Calib(far_seconds=5.0, false_merge_pct=1.0))
    requantile_stored(stage_tables, tight, walks.filter("walk_id % 4 = 0"))
    reselect_stored(stage_tables, tight, walks=walks.filter("walk_id % 4 = 0"))
    kept = stage_tables.read("manifest").groupBy("walk_id").agg(F.count(F.lit(1)).alias("faces"), F.count_if("kept").alias("anchors"))
    return kept.join(stage_tables.read("last_run").select("walk_id", "rule", "tau", "entered"), "walk_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    recording_catalogue, torn_frames, pano_index, missing_panos, manifest_file, manifest_read_back,
    vector_alignment, run_history, segmentation_labels, segmentation_record, override_log,
    failure_state, export_walk_summary, export_payload, frame_decimation, stitch_completeness,
    landed_wanted, legibility_gate, surviving_panos, borderline_members, low_reference_pairs,
    intake_missing, display_labels, sharpness, face_projection, embed_faces, thumbnails, segment_kept,
    detection_labels, mask_composite, mask_boundaries, far_pairs, reference_pairs, similarity_edges,
    resolve_pick, effective_picks, validate_decisions, review_groups, segmentation_view, walk_list,
    calibrated_tau, calibration_record, record_round_trip, far_sketch, requantile, class_shares,
    class_mix, stage_counts, review_counts, selection_summary, heading_ratio, sample_panos,
    decision_replay, stage_durations, stage_seconds, greedy_dedup, solo_drop, select, select_fixed,
    threshold_rule, threshold_sweep, reselect, meta_upsert, meta_patch, meta_patch_missing, meta_unknown_fields,
    forget_walks, forget_decisions, decision_replay_stream, stage_board_stream,
    job_counts_stream, merged_thresholds, rerun_plan,
    stalled_runs, retry_plan, stage_states, walk_run, walk_rerun)}
QUERIES |= {"manifest": QUERIES.pop("manifest_file"), "export_manifest": export_rows,
            "l2_normalise": l2_normalise_vectors}
