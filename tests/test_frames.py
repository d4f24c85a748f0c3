import pytest
from pyspark.sql import functions as F

from walksieve.operators import frames
from walksieve.params import Gate
from walksieve.sources import recordings


def decimated(spark, fps, n, target):
    df = spark.createDataFrame([(0, fps, n)], "walk_id long, fps double, frames long")
    return [r.frame_no for r in frames.decimate(df, target).orderBy("frame_no").collect()]


@pytest.mark.parametrize("fps,n,target,want", [
    (29.97, 300, 2.0, list(range(0, 299, 15))), (1.0, 5, 2.0, [0, 1, 2, 3]), (30.0, 1, 2.0, [0]),
    (30.0, 0, 2.0, [0]), (25.0, 40, 2.0, [0, 12, 24, 36]), (30.0, 31, 2.0, [0, 15])])
def test_decimation(spark, fps, n, target, want):
    assert decimated(spark, fps, n, target) == want


def test_completeness_and_stale(spark):
    asked = spark.createDataFrame([(0, i) for i in range(4)] + [(1, i) for i in range(3)], "walk_id long, frame_no long")
    landed = spark.createDataFrame([(0, i) for i in (0, 1, 2, 3, 7)] + [(1, 0)], "walk_id long, frame_no long")
    got = {r.walk_id: (r.requested, r.landed, r.wanted, r.stale, r.complete) for r in frames.completeness(asked, landed).collect()}
    assert got == {0: (4, 5, 4, 1, True), 1: (3, 1, 1, 0, False)}
    assert {(r.walk_id, r.frame_no) for r in frames.drop_stale(landed, asked).collect()} == \
        {(0, 0), (0, 1), (0, 2), (0, 3), (1, 0)}


def test_pano_index_is_dense(spark):
    landed = spark.createDataFrame([(0, n) for n in (45, 0, 15, 90)] + [(1, 30)], "walk_id long, frame_no long")
    got = sorted((r.walk_id, r.pano_idx, r.frame_no, r.t_sec) for r in frames.pano_index(landed, 30.0).collect())
    assert got == [(0, 0, 0, 0.0), (0, 1, 15, 0.5), (0, 2, 45, 1.5), (0, 3, 90, 3.0), (1, 0, 30, 1.0)]
    index = frames.pano_index(landed, 30.0)
    gone = frames.missing_panos(index, index.filter("pano_idx NOT IN (1, 3)"))
    assert [(r.walk_id, r.missing, r.first_missing) for r in gone.collect()] == [(0, 2, 1)]


def test_gate_drops_a_dead_stretch(spark):
    scores = [200.0] * 6 + [3.0, 2.5, 3.5, 3.0] + [200.0] * 6
    panos = spark.createDataFrame([(0, i, s) for i, s in enumerate(scores)] + [(1, 0, 5.0)], "walk_id long, pano_idx int, score double")
    got = {(r.walk_id, r.pano_idx) for r in frames.legible(panos, Gate(dead=0.15)).collect()}
    assert got == {(0, i) for i in range(16) if not 6 <= i < 10} | {(1, 0)}
    assert frames.legible(panos, Gate(dead=0.0)).count() == 17
    with pytest.raises(ValueError):
        frames.legible(panos, Gate(dead=1.0))
    walks = spark.createDataFrame([(0,), (1,), (2,)], "walk_id long")
    assert [r.walk_id for r in frames.emptied_walks(walks, panos).collect()] == [2]


def test_score_at_the_floor_is_kept(spark):
    panos = spark.createDataFrame([(0, i, s) for i, s in enumerate([100.0, 100.0, 50.0])], "walk_id long, pano_idx int, score double")
    assert frames.legible(panos, Gate(dead=0.5)).count() == 3


def test_intake(spark):
    rows = [(0, "s", "b", "f", "st", "op", 170), (1, "s", " ", None, "st", "op", None)]
    df = spark.createDataFrame(rows, "walk_id long, site string, building string, floor string, stage string, operator string, mount_height_cm int")
    got = {r.walk_id: (r.missing, r.accepted) for r in frames.intake_missing(df).collect()}
    assert got == {0: ("", True), 1: ("building, floor, mount height", False)}


@pytest.mark.parametrize("w,h,want", [(3840, 1920, 2), (5760, 2880, 2), (2880, 2880, 1), (1920, 1920, 1)])
def test_circles(spark, w, h, want):
    assert spark.range(1).select(recordings.circles_per_frame(F.lit(w), F.lit(h))).first()[0] == want


def test_catalogue(spark):
    files = spark.createDataFrame([
        (1, 0, "VID_20260728_114811_10_001.insv", 2880, 2880, "", ""), (1, 1, "VID_20260728_114811_00_001.insv", 2880, 2880, "", ""),
        (2, 0, "VID_20260728_120000_00_002.insv", 2880, 2880, "", ""),
        (3, 0, "VID_20260728_130000_10_003.insv", 2880, 2880, "", ""),
        (4, 0, "walk.insv", 5760, 2880, "2026-01-02", "09:30")],
        "recording_id long, file_no int, name string, width int, height int, shot_date string, shot_time string")
    got = {r.recording_id: r for r in recordings.recording_catalogue(files).collect()}
    assert got[1].video.endswith("_00_001.insv") and got[1].lenses == 2 and got[1].problem == ""
    assert got[2].problem == "one lens of a pair" and got[2].back_lens is None
    assert got[3].problem == "back lens only"
    assert (got[4].lenses, got[4].shot_date, got[4].shot_time) == (2, "2026-01-02", "09:30")
    assert (got[1].shot_date, got[1].shot_time) == ("2026-07-28", "11:48")
