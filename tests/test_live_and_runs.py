import numpy as np
import pytest
from pyspark.sql import functions as F

from walksieve.operators import images, review, segmentation
from walksieve.params import Calib, Dedup, Faces, Gate, Segment, WalkParams
from walksieve.operators import fleet
from walksieve.plans.walk_run import (Inputs, StageTables, number_faces, progress_log, requantile,
                                      reselect, run_entries, run_walks)
from walksieve.sources.parts import Parts
from walksieve.sources.tables import parse_runs
from walksieve.streaming import live_views
from tests.test_images import table

LOG = "id long, walk_id long, anchor string, action string, pick string"


def drain(view, keys, folder):
    live_views.maintain(view, keys, f"{folder}/view", f"{folder}/checkpoint").awaitTermination()
    return live_views.read_view(view, keys, f"{folder}/view")


def test_review_stream_takes_late_rows_and_restarts(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(3)), f"f{rng.integers(4)}", str(rng.choice(["pick", "drop", "restore"])), f"p{i}") for i in range(200)]
    order = rng.permutation(200)
    source = tmp_path / "log"
    source.mkdir()
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
    view = live_views.review_state(stream)
    for part in range(4):
        batch = [rows[i] for i in order[part * 50:(part + 1) * 50]]
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(str(source))
        if part % 2:        # a restart goes on from the checkpoint
            got = drain(view, ["walk_id", "anchor"], str(tmp_path))
    want = review.replay(spark.createDataFrame(rows, LOG))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_stage_board(spark, tmp_path):
    schema = "job string, stage string, status string, seq long"
    rows = [("j", "gate", "running", 1), ("j", "gate", "done", 2), ("j", "faces", "running", 3), ("k", "gate", "error", 4)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "p"))
    view = live_views.stage_board(spark.readStream.schema(schema).parquet(str(tmp_path / "p")))
    got = {(r.job, r.stage): (r.status, r.events) for r in drain(view, ["job", "stage"], str(tmp_path)).collect()}
    assert got == {("j", "gate"): ("done", 2), ("j", "faces"): ("running", 1), ("k", "gate"): ("error", 1)}


def test_counts_merge_whatever_the_order(spark, tmp_path):
    """Newest value per name, also where a count is told late, again, or with the same number."""
    rng = np.random.default_rng(4)
    rows = [(f"j{rng.integers(3)}", int(s), {f"n{k}": int(rng.integers(100)) for k in rng.choice(5, 2, replace=False)}) for s in range(120)]
    rows += [rows[5], ("j0", 200, None), ("j0", 201, {}), ("j9", 1, {"a": 1}), ("j9", 1, {"a": 7})]
    want = {}
    for job, seq, counts in sorted(rows, key=lambda r: (r[1], r[0], str(r[2]))):
        for name, value in (counts or {}).items():
            want.setdefault(job, {})[name] = value
    schema = "job string, seq long, counts map<string,long>"
    for turn in range(2):
        order = rng.permutation(len(rows))
        source = tmp_path / f"log{turn}"
        source.mkdir()
        for part in np.array_split(order, 3):
            spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(str(source))
        assert {r.job: r.counts for r in live_views.job_counts(live_views.newest_counts(spark.read.parquet(str(source)))).collect()} == want
        view = live_views.newest_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
        kept = drain(view, ["job", "name"], str(tmp_path / f"kept{turn}"))
        assert {r.job: r.counts for r in live_views.job_counts(kept).collect()} == want


def test_a_view_of_many_batches_has_few_parts(spark, tmp_path):
    """Levels of merged parts; batches that are replayed before and after their merge change nothing."""
    rng = np.random.default_rng(5)
    schema = "walk_id long, anchor string, pick string, dropped boolean, batch long"
    parts, keys, want, batches = Parts(spark, str(tmp_path / "view")), ["walk_id", "anchor"], {}, []
    for batch in range(11):
        rows = {(int(rng.integers(3)), f"f{rng.integers(4)}"): (None if rng.random() < 0.3 else f"p{batch}", bool(rng.integers(2))) for _ in range(3)}
        want |= rows
        batches.append(spark.createDataFrame([(*k, *v, batch) for k, v in rows.items()], schema).coalesce(1))
    for batch, changes in enumerate(batches):
        parts.add(changes, batch)
        if batch == 4:
            parts.add(changes, batch)
        live_views.compact(parts, keys, fan=2)
        levels = [p.level for p in parts.live()]
        assert len(set(levels)) == len(levels) == bin(batch + 1).count("1")
        if batch == 7:              # 0 to 7 are one part; an unfinished merge lies around
            parts.add(batches[6], 6)
            (tmp_path / "view" / "merged-000000000099-1").mkdir()
            assert len(parts.live()) == 1
    view = spark.createDataFrame([], schema).drop("batch")
    got = {(r.walk_id, r.anchor): (r.pick, r.dropped) for r in live_views.read_view(view, keys, str(tmp_path / "view")).collect()}
    assert got == want
    assert live_views.read_view(view, keys, str(tmp_path / "nothing")).count() == 0
    with pytest.raises(ValueError):
        live_views.maintain(view, keys, "v", "c", fan=1)


def test_counts_are_taken_while_writing(spark, tmp_path):
    """No job more than the write itself, of some rows, of none, and of those that a condition holds for."""
    tables = StageTables(spark, str(tmp_path))
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext

    def jobs(group, work):
        context.setJobGroup(group, group)
        try:
            out = work()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        return out, len(tracker.getJobIdsForGroup(group))

    rows = spark.range(1000).select((F.col("id") % 7).alias("walk_id"), "id")
    _, plain = jobs("plain", lambda: tables.write("plain", rows))
    (_, n), seen = jobs("seen", lambda: tables.counted("seen", rows))
    assert n == 1000 and seen == plain > 0
    assert tables.counted("some", rows, of=F.col("id") < 10)[1] == 10
    for empty in (rows.limit(0), rows.filter("id < 0"), rows.join(rows.filter("id < 0").select("id"), "id")):
        assert tables.counted("none", empty)[1] == 0
    assert tables.read("seen").count() == 1000


def test_faces_are_numbered_by_panorama_then_heading(spark):
    df = spark.createDataFrame([(0, p, y) for p in (2, 0) for y in (315, 45)], "walk_id long, pano_idx int, yaw int")
    got = [(r.pano_idx, r.yaw) for r in number_faces(df).orderBy("face_idx").collect()]
    assert got == [(0, 45), (0, 315), (2, 45), (2, 315)]


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(1)
    scenes = [rng.integers(0, 256, (16, 32)) for _ in range(6)]
    pics = [np.clip(scenes[i % 6] + rng.integers(-3, 4, (16, 32)), 0, 255) for i in range(24)]
    pics[5] = np.full((16, 32), 90)                       # a dead panorama
    return table(spark, pics).drop("name").cache()


def test_a_run_and_its_re_entries(spark, walk, tmp_path):
    params = WalkParams(faces=Faces(size=8), calib=Calib(far_seconds=2.0), segment=Segment(enabled=True))
    near = images.render_faces(walk, params.faces).select(
        "walk_id", (F.bround(F.col("t_sec") * 30).cast("long") + 1).alias("frame_no"), "yaw", "image")
    tables = StageTables(spark, str(tmp_path))
    run = lambda p, first="gate", inputs=Inputs(walk, near, 30.0): run_walks(
        tables, inputs, p, images.grid_embedder(4), segmentation.band_segmenter(), first,
        progress=progress_log(tables, "j")).first()
    row = run(params)
    faces = tables.read("faces")
    assert faces.select("pano_idx").distinct().count() == 23 and row.faces == 92
    assert row.segmented == row.anchors and row.reference > 0.95
    assert row.anchors + row.absorbed == row.faces
    before = tables.read("vectors").count()
    # a new threshold needs neither panoramas nor the frames after them
    fixed = WalkParams(faces=Faces(size=8), dedup=Dedup(rule="fixed", tau=0.9999))
    again = run(fixed, "select", Inputs())
    assert again.entered == "select" and again.faces == row.faces and again.anchors > row.anchors
    assert tables.read("masks").count() == 0 and tables.read("vectors").count() == before
    assert reselect(tables, params, segmentation.band_segmenter()).first().anchors == row.anchors
    history = fleet.run_history(parse_runs(tables.log("runs"))).orderBy("recency").collect()
    assert [r.parsed.entered for r in history] == ["select", "select", "gate"]
    assert set(history[2].parsed.seconds) == {"gate", "faces", "embed", "calibrate", "select", "segment"}
    done = fleet.stage_durations(tables.log("progress")).collect()
    assert {r.stage for r in done} == {"gate", "faces", "embed", "calibrate", "select", "segment"}
    assert fleet.latest_failures(tables.log("failures")).count() == 0
    # a smaller budget from the sketch raises the threshold and keeps more
    tau = tables.read("calibration").first().tau
    requantile(tables, WalkParams(calib=Calib(far_seconds=2.0, false_merge_pct=1.0)))
    assert tables.read("calibration").first().tau >= tau
    for first in ("faces", "embed", "calibrate"):
        assert run(params, first).anchors == row.anchors
    with pytest.raises(ValueError):
        run(params, "stitch")
    with pytest.raises(ValueError):
        run(params, "gate", Inputs())


def test_a_run_stores_shares_and_labels_and_clears_its_sentinel(spark, walk, tmp_path):
    params = WalkParams(faces=Faces(size=8), calib=Calib(far_seconds=2.0), segment=Segment(enabled=True))
    near = images.render_faces(walk, params.faces).select("walk_id", (F.bround(F.col("t_sec") * 30).cast("long") + 1).alias("frame_no"), "yaw", "image")
    tables = StageTables(spark, str(tmp_path))
    labels = spark.createDataFrame([(0, "dark"), (99, "unseen")], "class_id int, label string")
    row = run_walks(tables, Inputs(walk, near, 30.0), params, images.grid_embedder(4), segmentation.band_segmenter(), labels=labels).first()
    shares = tables.read("shares").collect()
    assert {r.model for r in shares} == {params.segment.model_name} and {r["class"] for r in shares} <= {"dark", "1", "2", "3"}
    assert len({r.path for r in shares}) == row.segmented == row.anchors
    assert [(r.class_id, r.label) for r in tables.read("labels").collect()] == [(0, "dark")]
    assert tables.read("jobs").count() == 0


def test_walks_that_cannot_go_on_are_noted(spark, walk, tmp_path):
    short = walk.filter("pano_idx < 3").withColumn("walk_id", F.lit(9).cast("long"))
    params = WalkParams(faces=Faces(size=8), calib=Calib(far_seconds=2.0))
    near = images.render_faces(walk, params.faces).select("walk_id", F.lit(-1).cast("long").alias("frame_no"), "yaw", "image")
    tables = StageTables(spark, str(tmp_path))
    done = run_walks(tables, Inputs(walk.unionByName(short), near, 30.0), params, images.grid_embedder(4)).collect()
    assert [r.walk_id for r in done] == [0] and done[0].pairs == 0
    failed = fleet.latest_failures(tables.log("failures")).collect()
    assert [(r.walk_id, r.stage, r.message) for r in failed] == [(9, "select", "too few far pairs")]


def test_a_run_without_faces_fails(spark, walk, tmp_path):
    with pytest.raises(RuntimeError, match="no faces"):
        run_walks(StageTables(spark, str(tmp_path)), Inputs(walk.limit(0), None, 30.0), WalkParams(faces=Faces(size=8)),
                  images.grid_embedder(4))


def test_a_run_touches_its_own_walks_only(spark, walk, tmp_path):
    """Two walks; each is run, re-selected and given a new budget while the other's rows stay equal."""
    both = walk.unionByName(walk.withColumn("walk_id", F.lit(1).cast("long"))).cache()
    params = WalkParams(faces=Faces(size=8), calib=Calib(far_seconds=2.0))
    near = images.render_faces(both, params.faces).select("walk_id", (F.bround(F.col("t_sec") * 30).cast("long") + 1).alias("frame_no"), "yaw", "image")
    tables = StageTables(spark, str(tmp_path))
    run_walks(tables, Inputs(both, near, 30.0), params, images.grid_embedder(4))
    names = ("scores", "faces", "vectors", "calibration", "manifest", "masks", "last_run")
    rows = lambda walk_id: {n: sorted(map(str, tables.read(n).filter(F.col("walk_id") == walk_id).collect())) for n in names}
    only = lambda walk_id: both.select("walk_id").distinct().filter(F.col("walk_id") == walk_id)
    first, second = rows(0), rows(1)
    assert first["manifest"] and second["manifest"] and first["calibration"]
    # a run of both restricted to one
    run_walks(tables, Inputs(both, near, 30.0), params, images.grid_embedder(4), walks=only(1))
    assert rows(0) == first
    fixed = WalkParams(faces=Faces(size=8), dedup=Dedup(rule="fixed", tau=0.9999))
    reselect(tables, fixed, walks=only(0))
    changed = rows(0)
    assert changed["manifest"] != first["manifest"] and {k: v for k, v in rows(1).items() if k != "last_run"} == {k: v for k, v in second.items() if k != "last_run"}
    requantile(tables, WalkParams(calib=Calib(far_seconds=2.0, false_merge_pct=1.0)), only(1))
    assert rows(0) == changed
    # a walk without a sketch keeps its record, one without a threshold its set
    bare = tables.read("calibration").filter("walk_id = 0").withColumn("tau", F.lit(None).cast("double")) \
        .withColumn("far", F.lit(None).cast(tables.read("calibration").schema["far"].dataType))
    tables.write("calibration", bare)
    requantile(tables, params)
    assert {r.walk_id for r in tables.read("calibration").collect()} == {0, 1}
    reselect(tables, params)
    assert rows(0)["manifest"] == changed["manifest"]
    assert {(r.walk_id, r.stage) for r in fleet.latest_failures(tables.log("failures")).collect()} == {(0, "select")}
    # settings are stored by the run, and plans made from them are acted on
    assert {(r.section, r.field, r.value) for r in tables.read("settings", only(0)).collect()} >= {("dedup", "rule", '"fixed"'), ("faces", "size", "8")}
    asked = spark.createDataFrame([(1, 0, "dedup", "tau", "0.9998"), (2, 1, "dedup", "solo_floor", "0.50")], "request_id long, walk_id long, section string, field string, value string")
    plan = fleet.rerun_plan(tables.read("settings"), asked, both.select("walk_id").limit(0))
    assert [(r.walk_id, r.outcome, r.first_stage) for r in plan.orderBy("request_id").collect()] == [(0, "inline", "select"), (1, "unchanged", None)]
    again = WalkParams(faces=Faces(size=8), dedup=Dedup(rule="fixed", tau=0.9998))
    ran = run_entries(tables, Inputs(), plan.select("walk_id", F.col("first_stage").alias("enter_at")), again, images.grid_embedder(4))
    assert [(r.walk_id, r.entered) for r in ran.collect()] == [(0, "select")]
    changed = rows(0)
    # vectors of another model than the calibration's
    tables.write("vectors", tables.read("vectors").filter("walk_id = 1").withColumn("model", F.lit("other")))
    reselect(tables, params)
    assert {r.walk_id for r in fleet.latest_failures(tables.log("failures")).collect()} == {0, 1}


def test_a_blank_picture_fails_its_walk_only(spark, walk, tmp_path):
    lit = F.lit(bytearray(bytes([90]) * 512))
    grey = walk.withColumn("walk_id", F.lit(5).cast("long")).withColumn("image", F.col("image").withField("data", lit))
    params = WalkParams(faces=Faces(size=8), gate=Gate(dead=0.0), calib=Calib(far_seconds=2.0))
    near = images.render_faces(walk.filter("pano_idx <> 5"), params.faces).select("walk_id", (F.bround(F.col("t_sec") * 30).cast("long") + 1).alias("frame_no"), "yaw", "image")
    tables = StageTables(spark, str(tmp_path))
    done = run_walks(tables, Inputs(walk.filter("pano_idx <> 5").unionByName(grey), near, 30.0), params, images.grid_embedder(4)).collect()
    assert [r.walk_id for r in done] == [0]
    assert [(r.walk_id, r.stage) for r in fleet.latest_failures(tables.log("failures")).collect()] == [(5, "embed")]
