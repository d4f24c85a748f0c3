import csv
import glob

import pytest
from pyspark.sql import functions as F

from walksieve.operators import export, metadata, review
from walksieve.sources import tables

MANIFEST = ("walk_id long, face_idx int, pano_idx int, t_sec double, yaw int, path string, kept boolean, "
            "anchor int, cosine double, sharpness double")
LOG = "id long, walk_id long, anchor string, action string, pick string"


@pytest.fixture()
def manifest(spark):
    rows = [(0, 0, 0, 12.5, 90, "a", True, None, None, 9.0), (0, 1, 1, 13.0, 90, "b", False, 0, 0.97, 5.0),
            (0, 2, 2, 14.0, 90, "c", False, 0, 0.99, 4.0), (0, 3, 3, 20.0, 45, "d", True, None, None, 0.0),
            (0, 4, 4, 21.0, 45, "e", False, None, None, 1.0)]
    return spark.createDataFrame(rows, MANIFEST)


def log(spark, *rows):
    return spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], LOG)


def test_replay(spark):
    got = {r.anchor: (r.pick, r.dropped) for r in review.replay(log(
        spark, ("a", "pick", "b"), ("a", "drop", None), ("d", "drop", None), ("d", "restore", None),
        ("x", "drop", None), ("x", "pick", "y"), ("z", "pick", "p"), ("z", "pick", "q"))).collect()}
    assert got == {"a": ("b", True), "d": (None, False), "x": ("y", False), "z": ("q", False)}


def test_replay_does_not_depend_on_order(spark):
    rows = log(spark, ("a", "pick", "b"), ("a", "drop", None), ("a", "restore", None), ("a", "pick", "c"))
    assert review.replay(rows.orderBy(F.desc("id"))).collect() == review.replay(rows).collect()


@pytest.mark.parametrize("pick,want", [("b", 1), ("a", 0), ("d", 0), ("gone", 0), (None, 0), ("e", 0)])
def test_pick_must_still_belong(spark, manifest, pick, want):
    state = review.replay(log(spark, ("a", "pick", pick)))
    assert review.resolve_picks(manifest, state).filter("anchor_idx = 0").first().pick_idx == want


def test_effective_picks_and_counts(spark, manifest):
    state = review.replay(log(spark, ("a", "pick", "c"), ("d", "drop", None), ("b", "drop", None)))
    got = review.effective_picks(manifest, state).collect()
    assert [(r.anchor_idx, r.pick_idx, r.source_face, r.overridden) for r in got] == [(0, 2, "c", True)]
    c = review.review_counts(manifest, state).first()
    assert (c.dropped, c.overridden) == (1, 1)      # a decision on a face that is no anchor does not count
    # a dropped group is not overridden too
    both = review.replay(log(spark, ("a", "pick", "c"), ("a", "drop", None)))
    c = review.review_counts(manifest, both).first()
    assert (c.dropped, c.overridden) == (1, 0)


def test_validate(spark, manifest):
    raw = spark.createDataFrame([(0, 0, 0, "pick", 1), (1, 0, 0, "pick", 0), (2, 0, 0, "pick", 3), (3, 0, 1, "drop", None),
                                 (4, 0, 0, "zoom", 1), (5, 0, 3, "drop", 9), (6, 0, 0, "pick", None), (7, 0, 99, "drop", None),
                                 (8, 0, 3, "restore", 3)],
                                "id long, walk_id long, anchor_idx int, action string, pick_idx int")
    got = {r.id: (r.reason, r.anchor, r.pick) for r in review.validate(raw, manifest).collect()}
    assert got[0] == ("", "a", "b") and got[1] == ("", "a", "a")
    assert got[2][0] == got[6][0] == "not in the group"
    assert got[3][0] == got[7][0] == "not a kept anchor" and got[4][0] == "unknown action"
    assert got[5] == ("", "d", None) and got[8] == ("", "d", None)


def test_group_order(spark, manifest):
    state = review.replay(log(spark, ("a", "pick", "b")))
    got = review.in_review_order(review.review_groups(manifest, state)).collect()
    assert [(r.anchor_idx, r.face_idx, r.pick_idx) for r in got] == [(0, 0, 1), (0, 2, 1), (0, 1, 1), (3, 3, 3)]


def test_borderline(spark, manifest):
    state = review.replay(log(spark, ("a", "pick", "b")))
    levels = spark.createDataFrame([(0, 0.96)], "walk_id long, tau double")
    got = {r.face_idx: (r.relative, r.borderline) for r in review.borderline_members(manifest, state, levels).collect()}
    assert got == {0: (1.0, False), 1: (pytest.approx(5 / 9), False), 2: (pytest.approx(4 / 9), False), 3: (0.0, False)}
    levels = levels.withColumn("tau", F.lit(0.98))
    got = {r.face_idx: r.borderline for r in review.borderline_members(manifest, state, levels).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False}          # b is near too, but it is the live pick


def test_walk_list(spark, manifest):
    walks = spark.createDataFrame([(0, "s"), (1, "t")], "walk_id long, site string")
    state = review.replay(log(spark, ("d", "drop", None)))
    failed = spark.createDataFrame([(1, "gate")], "walk_id long, stage string")
    got = {r.walk_id: (r.faces, r.kept, r.ready, r.failed_stage) for r in review.walk_list(walks, manifest, state, failed).collect()}
    assert got == {0: (5, 1, True, None), 1: (0, 0, False, "gate")}


def test_manifest_file_round_trip(spark, manifest, tmp_path):
    tables.write_manifest_csv(manifest, str(tmp_path / "m"))
    back = tables.read_manifest_csv(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.select(*manifest.columns).collect())) == sorted(map(tuple, manifest.collect()))


def export_of(spark, manifest, state):
    walks = spark.createDataFrame([(0, "Tower 2 East", "", "mep", "2026-01-02")],
                                  "walk_id long, site string, building string, stage string, shot_date string")
    shares = spark.createDataFrame([(0, "c", i + 1, i, f"k{i}", 0.5 / (i + 1)) for i in range(8)],
                                   "walk_id long, path string, rank int, class_id int, class string, share double")
    return walks, export.export_manifest(manifest, state, walks, shares)


def test_export(spark, manifest, tmp_path):
    state = review.replay(log(spark, ("a", "pick", "c")))
    walks, rows = export_of(spark, manifest, state)
    got = {r.pick_idx: r for r in rows.collect()}
    assert got[2].file == "frames/tower-2-east_0_t0014.0_y090.jpg" and got[2].overridden == 1
    assert got[2].classes == "k0 0.50; k1 0.25; k2 0.17; k3 0.12; k4 0.10; k5 0.08"
    assert got[3].classes == "" and got[3].overridden == 0
    used = spark.createDataFrame([(0, ("fixed", 0.9))], "walk_id long, settings struct<rule:string,tau:double>")
    payload = export.frame_payload(rows, walks, used)
    summary = export.export_walk_summary(manifest, state, walks, rows.limit(0).withColumn("walk_id", F.lit(0).cast("long")))
    decisions = log(spark, ("a", "pick", "c"))
    for name in ("one", "two"):
        export.write_export(rows, payload, decisions, summary, str(tmp_path / name))
    read = lambda name: [open(f).read() for f in sorted(glob.glob(str(tmp_path / name / "manifest" / "part-*")))]
    assert read("one") == read("two")
    assert '"rule":"fixed"' in payload.first().payload
    s = summary.first()
    assert (s.frames, s.dropped, s.overridden, s.segmented) == (2, 0, 1, False)


def test_empty_export_has_a_header(spark, manifest, tmp_path):
    state = review.replay(log(spark, ("a", "drop", None), ("d", "drop", None)))
    walks, rows = export_of(spark, manifest, state)
    used = spark.createDataFrame([(0, ("fixed", 0.9))], "walk_id long, settings struct<rule:string,tau:double>")
    export.write_export(rows, export.frame_payload(rows, walks, used), log(spark, ("a", "drop", None)),
                        export.export_walk_summary(manifest, state, walks, walks.limit(0)), str(tmp_path / "x"))
    lines = [row for f in glob.glob(str(tmp_path / "x" / "manifest" / "part-*")) for row in csv.reader(open(f))]
    assert lines and all(tuple(row) == export.EXPORT_COLUMNS for row in lines)


META = ("walk_id long, site string, building string, floor string, stage string, operator string, "
        "mount_height_cm int, shot_date string, shot_time string, camera string")


def test_metadata(spark):
    walks = spark.createDataFrame([(0, "s", "b", "f", "st", "op", 170, "d", "t", "c")], META)
    changes = spark.createDataFrame([(0, 1, "site", "new"), (0, 2, "site", ""), (0, 3, "mount_height_cm", "180"),
                                     (9, 4, "site", "x"), (9, 5, "colour", "red")],
                                    "walk_id long, seq long, field string, value string")
    up = {r.walk_id: r for r in metadata.upsert(walks, changes).collect()}
    assert (up[0].site, up[0].building, up[0].mount_height_cm) == ("", "b", 180)
    assert (up[9].site, up[9].building, up[9].mount_height_cm) == ("x", "", None)
    assert [r.walk_id for r in metadata.patch(walks, changes).collect()] == [0]
    assert [(r.walk_id, r.changes) for r in metadata.patch_missing(walks, changes).collect()] == [(9, 2)]
    assert [r.field for r in metadata.unknown_fields(changes).collect()] == ["colour"]
    # a change set with an unknown field is refused as a whole
    more = changes.unionByName(spark.createDataFrame([(9, 5, "floor", "3"), (9, 6, "floor", "2")], changes.schema))
    assert {r.walk_id: r.floor for r in metadata.upsert(walks, more).collect()}[9] == "2"
    assert {r.walk_id: r.floor for r in metadata.upsert(walks, more.filter("seq < 6")).collect()}[9] == ""
    assert [(r.walk_id, r.seq, r.fields) for r in metadata.refused_sets(more).collect()] == [(9, 5, ["colour"])]
    assert metadata.forget(walks, walks.select("walk_id")).count() == 0


def test_replacing_walks_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_walks(spark.createDataFrame([(0, "a"), (1, "b")], "walk_id long, v string"), path)
    tables.replace_walks(spark.createDataFrame([(1, "c")], "walk_id long, v string"), path)
    assert sorted((r.walk_id, r.v) for r in spark.read.parquet(path).collect()) == [(0, "a"), (1, "c")]
