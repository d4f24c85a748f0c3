import datetime as dt

import pytest
from pyspark.sql import functions as F

from walksieve.operators import calibration, fleet
from walksieve.params import STAGES, WalkParams
from walksieve.sources import tables


def progress(spark, *rows):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    return spark.createDataFrame([("j", st, status, i, at(s)) for i, (st, status, s) in enumerate(rows)],
                                 "job string, stage string, status string, seq long, at timestamp")


def test_durations(spark):
    log = progress(spark, ("gate", "running", 0), ("gate", "running", 5), ("faces", "running", 6), ("gate", "queued", 7),
                   ("gate", "done", 8.25), ("gate", "done", 20), ("faces", "done", 7.5), ("embed", "done", 9),
                   ("gate", "running", 30), ("gate", "done", 31))
    got = sorted((r.stage, r.seq, r.seconds) for r in fleet.stage_durations(log).collect())
    assert got == [("faces", 6, 1.5), ("gate", 4, pytest.approx(3.3, abs=0.06)), ("gate", 9, 1.0)]
    latest = {r.stage: r.seconds for r in fleet.stage_seconds(fleet.stage_durations(log)).collect()}
    assert latest == {"faces": 1.5, "gate": 1.0}


def lines(spark, texts):
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "walk_id long, seq long, line string")
    return tables.parse_runs(df, "n long")


def test_run_history(spark):
    texts = ['{"n": %d}' % i for i in range(27)]
    got = fleet.run_history(lines(spark, texts)).orderBy("recency").collect()
    assert [r.parsed.n for r in got] == list(range(26, 6, -1))
    texts[25] = '{"n": 2'
    texts[20] = "   "
    got = fleet.run_history(lines(spark, texts)).orderBy("recency").collect()
    # the torn line still takes one of the 20 places, the blank one does not
    assert [r.parsed.n for r in got] == [26, 24, 23, 22, 21] + list(range(19, 5, -1))
    assert fleet.run_history(lines(spark, texts), limit=3).count() == 3


def test_json_that_is_no_object(spark):
    df = lines(spark, ['[1]', '"x"', "null", "{", '{"n": 1} trailing', '{"n": 4}', ""])
    assert [r.parsed.n for r in df.filter("parsed IS NOT NULL").collect()][-1] == 4
    assert {r.line for r in df.filter("parsed IS NOT NULL").collect()} <= {'{"n": 4}', '{"n": 1} trailing'}
    bad = spark.createDataFrame([(0, "[]"), (1, "torn {"), (2, None)], "walk_id long, json string")
    assert tables.read_record_json(bad).count() == 0


def test_latest_failure(spark):
    log = spark.createDataFrame([(0, 1, "failed", "gate", "a"), (0, 2, "failed", "embed", "b"), (1, 1, "failed", "gate", "c"),
                                 (1, 2, "finished", None, None)], "walk_id long, seq long, kind string, stage string, message string")
    assert [(r.walk_id, r.stage, r.message) for r in fleet.latest_failures(log).collect()] == [(0, "embed", "b")]


def test_stalled(spark):
    rows = [(0, "embed", True, True, False, True), (1, "", True, False, False, True), (2, "", True, False, False, False),
            (3, None, True, False, False, True), (4, None, True, False, False, False), (5, None, True, True, False, True),
            (6, None, True, False, True, True), (7, None, False, False, False, False)]
    df = spark.createDataFrame(rows, "walk_id long, job_stage string, has_source boolean, has_manifest boolean, "
                                     "has_failure boolean, has_panos boolean")
    got = {r.walk_id: (r.stage, r.cause) for r in fleet.stalled_runs(df).collect()}
    assert got == {0: ("embed", "unfinished job"), 1: ("gate", "unfinished job"), 2: ("stitch", "unfinished job"),
                   3: ("gate", "no outcome"), 4: ("stitch", "no outcome")}


def test_retry(spark):
    failed = spark.createDataFrame([(0, "embed"), (1, "stitch"), (2, ""), (3, "gate")], "walk_id long, stage string")
    there = spark.createDataFrame([(0,), (1,), (2,)], "walk_id long")
    got = {r.walk_id: (r.enter_at, r.video_missing) for r in fleet.retry_plan(failed, there).collect()}
    assert got == {0: ("embed", False), 1: ("start", False), 2: ("start", False), 3: (None, True)}


def test_stage_states(spark):
    walks = spark.createDataFrame([(0, 10, None), (1, 0, "embed"), (2, 0, None), (3, 0, "odd"), (4, 10, "gate")],
                                  "walk_id long, faces long, failed_stage string")
    got = {}
    for r in fleet.stage_states(walks).orderBy("walk_id", "stage_no").collect():
        got.setdefault(r.walk_id, []).append(r.state)
    assert got[0] == got[4] == ["done"] * 9
    assert got[1] == ["done"] * 4 + ["error"] + ["queued"] * 4
    assert got[2] == got[3] == ["done"] + ["queued"] * 8


@pytest.mark.parametrize("setting,value,ok", [
    ("gate.dead", "0.0", True), ("gate.dead", "1.0", False), ("gate.dead", "-0.1", False), ("gate.dead", '"x"', False),
    ("gate.band", "[0,1]", True), ("gate.band", "[0.5,0.5]", False), ("gate.band", "[0.1,1.2]", False),
    ("faces.fov_deg", "10", False), ("faces.fov_deg", "179.9", True), ("faces.size", "64", True), ("faces.size", "5000", False),
    ("faces.yaws", "[0,90]", True), ("faces.yaws", "[]", False), ("faces.yaws", "[0,360]", False), ("faces.yaws", "[1,1]", False),
    ("embed.model_name", '"vit_base_patch14_dinov2.lvd142m"', True), ("embed.model_name", '"resnet"', False),
    ("embed.batch_size", "65", False), ("calib.samples", "1", False), ("calib.far_seconds", "600", True),
    ("calib.false_merge_pct", "0", False), ("calib.false_merge_pct", "50", True), ("dedup.tau", "1", False),
    ("dedup.rule", '"fixed"', True), ("dedup.rule", '"best"', False), ("dedup.solo_floor", "0", True),
    ("dedup.solo_span", "0", False), ("dedup.solo_span", "900", True), ("segment.classes", '["a"," "]', True),
    ("segment.classes", '[" "]', False), ("segment.classes", "[" + ",".join(f'"c{i}"' for i in range(41)) + "]", False),
    ("segment.enabled", "true", True), ("segment.threshold", "1", False), ("dedup.unknown", "1", False)])
def test_bounds(spark, setting, value, ok):
    section, field = setting.split(".")
    got = spark.range(1).select(fleet.setting_allowed(F.lit(section), F.lit(field), F.lit(value))).first()[0]
    assert got is ok


def plan(spark, *patch, sketch=True):
    stored = spark.createDataFrame([(0, "gate", "dead", "0.15"), (0, "calib", "false_merge_pct", "5.0"), (0, "dedup", "tau", "0.94"),
                                    (0, "embed", "batch_size", "8"), (0, "segment", "enabled", "false")],
                                   "walk_id long, section string, field string, value string")
    asked = spark.createDataFrame([(1, 0, *p) for p in patch], "request_id long, walk_id long, section string, field string, value string")
    have = spark.createDataFrame([(0,)] if sketch else [], "walk_id long")
    r = fleet.rerun_plan(stored, asked, have).first()
    return r.outcome, r.first_stage, r.changed, r.needs_video


def test_rerun_plan(spark):
    assert plan(spark, ("gate", "dead", "0.15")) == ("unchanged", None, "", False)
    assert plan(spark, ("gate", "dead", "0.2"), ("dedup", "tau", "0.9")) == ("queued", "gate", "dedup.tau,gate.dead", True)
    assert plan(spark, ("dedup", "tau", "0.9")) == ("inline", "select", "dedup.tau", False)
    assert plan(spark, ("calib", "false_merge_pct", "2.0"))[:2] == ("inline", "select")
    assert plan(spark, ("calib", "false_merge_pct", "2.0"), sketch=False) == ("queued", "calibrate", "calib.false_merge_pct", True)
    assert plan(spark, ("calib", "false_merge_pct", "2.0"), ("embed", "batch_size", "4"))[:2] == ("queued", "embed")
    assert plan(spark, ("segment", "enabled", "true")) == ("queued", "segment", "segment.enabled", False)
    assert plan(spark, ("gate", "dead", "0.15"), ("dedup", "tau", "7"))[0] == "rejected"
    # other words for the same value, and settings that are not stored
    for same in (("gate", "dead", "0.150"), ("embed", "batch_size", "8.0"), ("faces", "yaws", "[45, 135, 225, 315.0]"), ("dedup", "solo_span", "45")):
        assert plan(spark, same) == ("unchanged", None, "", False)
    assert plan(spark, ("calib", "samples", "10.5"))[0] == "rejected"
    assert plan(spark, ("gate", "dead", '"0.2"'))[0] == "rejected"


def test_stored_settings_are_never_broadcast(spark):
    """Settings exploded from a walk's row are many more than the planner thinks."""
    names = F.array(*[F.lit(n) for n in ("dead", "band", "other")])
    stored = (spark.range(20).select(F.col("id").alias("walk_id"), F.explode(names).alias("field"))
              .select("walk_id", F.lit("gate").alias("section"), "field", F.lit("0.3").alias("value")))
    asked = spark.createDataFrame([(i, i % 20, "gate", "dead", "0.3" if i < 20 else "0.2") for i in range(40)],
                                  "request_id long, walk_id long, section string, field string, value string")
    planned = fleet.rerun_plan(stored, asked, spark.range(1).select(F.col("id").alias("walk_id")))
    assert "SortMergeJoin" in planned._jdf.queryExecution().executedPlan().toString()
    assert {r.request_id: r.outcome for r in planned.collect()} == {i: "unchanged" if i < 20 else "queued" for i in range(40)}


def test_params_round_trip():
    saved = WalkParams().to_dict()
    saved["faces"]["yaws"] = list(saved["faces"]["yaws"])
    assert WalkParams.from_dict(saved) == WalkParams()
    assert WalkParams.from_dict({"dedup": {"tau": 0.8}}).dedup.tau == 0.8
    assert STAGES[0] == "stitch"


def test_alignment_and_missing_vectors(spark):
    manifest = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "walk_id long, face_idx int")
    vectors = spark.createDataFrame([(0, 0, [1.0]), (0, 2, [1.0]), (1, 0, [1.0])], "walk_id long, face_idx int, embedding array<float>")
    got = {r.walk_id: (r.faces, r.vectors, r.without_vector, r.without_face, r.aligned) for r in tables.vector_alignment(manifest, vectors).collect()}
    assert got == {0: (2, 2, 1, 1, False), 1: (1, 1, 0, 0, True)}
    with pytest.raises(Exception, match="no vector for face 1 of walk 0"):
        tables.with_vectors(manifest, vectors).collect()
