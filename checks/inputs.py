"""Operator inputs derived from the given tables, over all of their rows.

The tables hold no walks, so each input reads one as if it were: vectors become
faces, events become log rows, orders become recordings and requests, customers
become walks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from walksieve.functions.ordinals import integer_ordinal
from walksieve.functions.text import face_name
from walksieve.functions.vectors import as_double, norm
from walksieve.params import STAGES

FPS = 29.97
CLASSES = ["concrete column", "concrete beam", "duct", "pipe"]
# where the 8 tokens of "concrete column. concrete beam. duct. pipe." lie
OFFSETS = [(0, 8), (9, 15), (15, 16), (17, 25), (26, 30), (30, 31), (32, 36), (38, 42)]
LABELS = [(0, "wall"), (1, "floor"), (2, "ceiling")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def yaw_of(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(y) for y in (45, 135, 225, 315)]), (idx % 4 + 1).cast("int"))


def name_of(idx: Column) -> Column:
    return face_name(F.floor(idx / 4), yaw_of(idx))


def keyed_vectors(spark, sf_dir) -> DataFrame:
    """embeddings with walk_id and face_idx: 100 faces make a walk."""
    return (table(spark, sf_dir, "embeddings")
            .withColumn("walk_id", F.expr("vec_id div 100"))
            .withColumn("face_idx", F.expr("cast(vec_id % 100 as int)")))


def faces(spark, sf_dir) -> DataFrame:
    pano = F.expr("cast(face_idx div 4 as int)")
    return keyed_vectors(spark, sf_dir).select(
        "walk_id", "face_idx", pano.alias("pano_idx"), (pano * F.lit(2.0)).alias("t_sec"),
        yaw_of(F.col("face_idx")).alias("yaw"), name_of(F.col("face_idx")).alias("path"),
        F.expr("1 + ((vec_id * 7919) % 997) / 10.0D").alias("sharpness"), "embedding")


def blended(spark, sf_dir, share: float) -> DataFrame:
    """Each vector with a share of the next one, at unit length; the last has no next."""
    rows = keyed_vectors(spark, sf_dir)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_n"))
    mixed = F.zip_with(as_double(F.col("embedding")), as_double(F.col("_n")),
                       lambda a, b: F.lit(1 - share) * a + F.lit(share) * b)
    unit = F.transform("_m", lambda x: x / F.col("_len"))
    return (rows.join(after, "vec_id").withColumn("_m", mixed).withColumn("_len", norm(F.col("_m")))
            .select("walk_id", "face_idx", "vec_id", F.col("embedding").alias("original"),
                    unit.alias("embedding")))


def neighbours(spark, sf_dir) -> DataFrame:
    """The frame after each face; some did not come back."""
    pano = F.expr("face_idx div 4")
    return (blended(spark, sf_dir, 0.25).filter(F.col("original")[0] <= 0.2)
            .select("walk_id", (F.bround(pano * 2.0 * F.lit(FPS)).cast("long") + 1).alias("frame_no"),
                    yaw_of(F.col("face_idx")).alias("yaw"), "embedding"))


def faces_and_twins(spark, sf_dir) -> DataFrame:
    """faces plus a near copy of each, a minute later."""
    own = faces(spark, sf_dir).withColumn("embedding", as_double(F.col("embedding")))
    copies = (own.drop("embedding").join(
        blended(spark, sf_dir, 0.02).select("walk_id", "face_idx", "embedding"), ["walk_id", "face_idx"])
        .select("walk_id", (F.col("face_idx") + 100).alias("face_idx"),
                (F.col("pano_idx") + 1000).alias("pano_idx"), (F.col("t_sec") + 60).alias("t_sec"),
                "yaw", face_name(F.col("pano_idx") + 1000, F.col("yaw")).alias("path"),
                (F.col("sharpness") / 2).alias("sharpness"), "embedding"))
    return own.unionByName(copies)


def pixel_values() -> Column:
    """64 grey levels from a vector."""
    return F.transform("embedding", lambda x: F.floor(
        (F.least(F.greatest(x.cast("double"), F.lit(-0.5)), F.lit(0.5)) + 0.5) * 255))


def to_bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def image_struct(data: Column, height: int, width: int, origin: Column) -> Column:
    return F.struct(origin.alias("origin"), F.lit(height).alias("height"), F.lit(width).alias("width"),
                    F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))


def images(spark, sf_dir) -> DataFrame:
    """An 8x8 grey image per face."""
    path = name_of(F.col("face_idx"))
    return keyed_vectors(spark, sf_dir).select(
        "walk_id", "face_idx", "vec_id", "label", path.alias("path"),
        image_struct(to_bytes(pixel_values()), 8, 8, path).alias("image"))


def masks(spark, sf_dir) -> DataFrame:
    """An 8x8 class mask per face: the grey level over 64."""
    ids = F.transform(pixel_values(), lambda p: F.floor(p / 64))
    return keyed_vectors(spark, sf_dir).select(
        "walk_id", name_of(F.col("face_idx")).alias("path"), F.lit(8).alias("height"),
        F.lit(8).alias("width"), to_bytes(ids).alias("mask"))


def labels(spark) -> DataFrame:
    named = F.array(*[F.struct(F.lit(i).alias("class_id"), F.lit(n).alias("label")) for i, n in LABELS])
    return spark.range(1).select(F.inline(named))


def equirects(spark, sf_dir) -> DataFrame:
    """8x16 panoramas: two images side by side. An odd last image stands alone over black."""
    data = to_bytes(pixel_values())
    half = keyed_vectors(spark, sf_dir).select("walk_id", "face_idx", "vec_id", data.alias("data"))
    side = lambda s: F.coalesce(F.max(F.when(F.col("vec_id") % 2 == s, F.col("data"))),
                                F.unhex(F.lit("00" * 64)))
    both = half.groupBy(F.expr("vec_id div 2").alias("pano_id")).agg(side(0).alias("a"), side(1).alias("b"))
    rows = F.concat(*[F.substring(c, r * 8 + 1, 8) for r in range(8) for c in ("a", "b")])
    return both.select(
        F.expr("pano_id div 50").alias("walk_id"), F.expr("cast(pano_id % 50 as int)").alias("pano_idx"),
        (F.expr("pano_id % 50") * 0.5).alias("t_sec"),
        image_struct(rows, 8, 16, F.col("pano_id").cast("string")).alias("image"))


def strips(spark, sf_dir) -> DataFrame:
    """512x2 pictures of 16 images each; odd ones are masks by name."""
    rows = keyed_vectors(spark, sf_dir).select("vec_id", "label", to_bytes(pixel_values()).alias("data"))
    slot = lambda s, c: F.max(F.when(F.col("vec_id") % 16 == s, F.col(c)))
    data = F.concat(*[F.coalesce(slot(s, "data"), F.unhex(F.lit("00" * 64))) for s in range(16)])
    name = F.concat(F.lit("p"), F.col("image_id").cast("string"),
                    F.when(F.col("image_id") % 2 == 1, ".png").otherwise(".jpg"))
    return (rows.groupBy(F.expr("vec_id div 16").alias("image_id"))
            .agg(data.alias("data"), slot(0, "label").alias("lead"))
            .select(F.lit(0).alias("walk_id"), name.alias("name"), F.col("image_id").alias("modified"), "lead",
                    image_struct(F.col("data"), 2, 512, name).alias("image")))


def thumbs(spark, sf_dir) -> DataFrame:
    """Thumbnails already made; those of label 3 are absent, those under 5 are old."""
    return strips(spark, sf_dir).filter("lead <> 3").select(
        "walk_id", "name", (F.col("modified") + F.when(F.col("lead") >= 5, 1).otherwise(-1)).alias("modified"))


def detections(spark, sf_dir) -> DataFrame:
    e = F.col("embedding")
    share = lambda i: (e[i].cast("double") + 1) / 2
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 4").alias("frame_id"), (F.col("vec_id") % 4).alias("det_idx"),
        F.transform(F.slice(e, 1, 8), lambda x: x.cast("double") * 10).alias("logits"),
        share(8).alias("cx"), share(9).alias("cy"), share(10).alias("w"), share(11).alias("h"),
        F.lit(1024).alias("width"), F.lit(1024).alias("height"))


def instance_masks(spark, sf_dir) -> DataFrame:
    on = F.transform(pixel_values(), lambda p: (p > 128).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 4").alias("frame_id"), (F.col("vec_id") % 4).cast("int").alias("det_idx"),
        (F.col("label") % 5 + 1).cast("int").alias("class_id"),
        F.abs(F.col("embedding")[1].cast("double")).alias("score"),
        F.lit(8).alias("height"), F.lit(8).alias("width"), to_bytes(on).alias("mask"))


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def by_type(**values) -> Column:
    case = None
    for kind, value in values.items():
        hit = F.col("event_type") == kind
        case = F.when(hit, F.lit(value)) if case is None else case.when(hit, F.lit(value))
    return case


def scored_panos(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("user_id").alias("walk_id"), "event_id",
                                        F.col("value").alias("score"))
    return integer_ordinal(rows, ["walk_id"], "event_id", "pano_idx").drop("event_id")


def landed_frames(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(F.col("user_id").alias("walk_id"),
                                        F.col("event_id").alias("frame_no"), "event_type")


def raw_decisions(spark, sf_dir) -> DataFrame:
    return raw_decisions_of(events(spark, sf_dir))


def raw_decisions_of(rows: DataFrame) -> DataFrame:
    """Decisions by face index, valid or not."""
    anchor = F.expr("cast(((event_id div 20) % 25) * 4 + user_id % 4 as int)")
    pick = (F.col("anchor_idx") + 4 * (F.col("id") % 3)) % 100
    return (rows.select(
                F.col("event_id").alias("id"), (F.col("event_id") % 20).alias("walk_id"),
                anchor.alias("anchor_idx"), "event_type",
                by_type(click="pick", error="drop", signup="restore", view="zoom",
                        purchase="pick").alias("action"))
            .withColumn("pick_idx", F.when(F.col("event_type") != "purchase", pick).cast("int"))
            .drop("event_type"))


def decisions(spark, sf_dir) -> DataFrame:
    return decisions_of(raw_decisions(spark, sf_dir))


def decisions_of(raw: DataFrame) -> DataFrame:
    """The decision log, by face name."""
    return (raw.filter(F.col("action").isin("pick", "drop", "restore") & F.col("pick_idx").isNotNull())
            .select("id", "walk_id", name_of(F.col("anchor_idx")).alias("anchor"), "action",
                    F.when(F.col("action") == "pick", name_of(F.col("pick_idx"))).alias("pick")))


def progress(spark, sf_dir) -> DataFrame:
    return progress_rows(events(spark, sf_dir))


def progress_rows(rows: DataFrame) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("event_id") % 7 + 1).cast("int"))
    return rows.select(
        F.col("user_id").alias("job"), stage.alias("stage"),
        by_type(view="running", purchase="done", error="error", click="queued",
                signup="queued").alias("status"),
        F.col("event_id").alias("seq"), F.col("ts").alias("at"),
        F.when(F.col("event_type") != "click", F.create_map(stage, F.floor(F.col("value") * 10))).alias("counts"))


def run_lines(spark, sf_dir) -> DataFrame:
    """Run-log lines: errors are torn, sign-ups are blank."""
    whole = F.format_string('{"faces": %d, "anchors": %d, "solo": %d}', F.col("event_id") % 500 + 100,
                            F.col("event_id") % 100, F.col("event_id") % 7)
    line = (F.when(F.col("event_type") == "error", F.substring(whole, 1, 20))
            .when(F.col("event_type") == "signup", F.lit("")).otherwise(whole))
    return events(spark, sf_dir).select(F.col("user_id").alias("walk_id"),
                                        F.col("event_id").alias("seq"), line.alias("line"))


def failure_log(spark, sf_dir) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("event_id") % 7 + 1).cast("int"))
    return (events(spark, sf_dir).filter(F.col("event_type").isin("error", "purchase"))
            .select(F.col("user_id").alias("walk_id"), F.col("event_id").alias("seq"),
                    by_type(error="failed", purchase="finished").alias("kind"),
                    stage.alias("stage"), F.col("props").alias("message")))


def recordings(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    fps = F.element_at(F.array(*[F.lit(f) for f in (23.976, 25.0, 29.97, 30.0, 59.94)]),
                       (key % 5 + 1).cast("int"))
    dual = key % 7 == 0
    return (table(spark, sf_dir, "orders").select(
                key.alias("walk_id"), fps.alias("fps"), (key % 97).alias("frames"),
                F.when(dual, 3840).otherwise(2880).alias("width"),
                F.when(dual, 1920).otherwise(2880).alias("height"),
                F.when(dual | (key % 3 == 0), 2).otherwise(1).alias("lenses"))
            .withColumn("seconds", F.round(F.col("frames") / F.col("fps"), 1)))


def landed_stills(spark, sf_dir) -> DataFrame:
    """Frames that came back for the recordings, wanted or not."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("walk_id"), ((F.col("l_linenumber") - 1) * 15).cast("long").alias("frame_no"))


def camera_files(spark, sf_dir) -> DataFrame:
    """One or two files per order: both lenses, the front or only the back one."""
    key = F.col("o_orderkey")
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"),
                     F.format_string("%02d%02d00", key % 24, key % 60))
    named = lambda mark: F.concat(F.lit("VID_"), stamp, F.lit(mark), key.cast("string"), F.lit(".insv"))
    kinds = (F.when(F.col("o_orderpriority") == "1-URGENT", F.array(named("_00_"), named("_10_")))
             .when(F.col("o_orderpriority") == "5-LOW", F.array(named("_10_")))
             .otherwise(F.array(named("_00_"))))
    dual = key % 7 == 0
    return (table(spark, sf_dir, "orders")
            .select("*", F.posexplode(kinds).alias("file_no", "name"))
            .select(key.alias("recording_id"), "file_no", "name",
                    F.when(dual, 3840).otherwise(2880).alias("width"),
                    F.when(dual, 1920).otherwise(2880).alias("height"),
                    F.when(F.col("o_orderstatus") == "P", "2030-01-01").otherwise("").alias("shot_date"),
                    F.lit("").alias("shot_time")))


def frame_files(spark, sf_dir) -> DataFrame:
    """Texts as file contents; those with a `quality` label end as whole frames do."""
    marked = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (table(spark, sf_dir, "documents").join(marked, "doc_id", "left")
            .select("doc_id", F.concat(F.encode("text", "UTF-8"), F.unhex(
                F.when(F.col("quality").isNotNull(), "FFD9").otherwise("FFD8"))).alias("content")))


def walks(spark, sf_dir) -> DataFrame:
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        key.alias("walk_id"), F.col("n_name").alias("site"), F.col("c_mktsegment").alias("building"),
        F.when(bal < 0, "").otherwise(F.concat(F.lit("L"), (key % 10).cast("string"))).alias("floor"),
        F.when(bal > 5000, "finishing").otherwise("structure").alias("stage"),
        F.col("c_name").alias("operator"),
        F.when(bal <= 9000, 150 + key % 100).cast("int").alias("mount_height_cm"),
        F.concat(F.lit("2024-05-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).alias("shot_date"),
        F.lit("").alias("shot_time"), F.lit("").alias("camera"))


def intake(spark, sf_dir) -> DataFrame:
    return (walks(spark, sf_dir)
            .withColumn("building", F.when(F.col("building") != "MACHINERY", F.col("building")).otherwise(""))
            .withColumn("operator", F.when(F.col("walk_id") % 11 == 0, "  ").otherwise(F.col("operator"))))


def meta_changes(spark, sf_dir) -> DataFrame:
    """Metadata changes; half of the walks are new, one field does not exist."""
    order = F.col("o_orderpriority")
    field = (F.when(order == "1-URGENT", "site").when(order == "2-HIGH", "building")
             .when(order == "3-MEDIUM", "floor").when(order == "4-NOT SPECIFIED", "mount_height_cm")
             .otherwise("colour"))
    value = (F.when(field == "mount_height_cm", (100 + F.col("o_orderkey") % 200).cast("string"))
             .when(F.col("o_orderstatus") == "P", "")
             .otherwise(F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))))
    # every third order sets the camera too, in the same change set
    own = F.struct(field.alias("field"), value.alias("value"))
    camera = F.struct(F.lit("camera").alias("field"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("value"))
    both = F.when(F.col("o_orderkey") % 3 == 0, F.array(own, camera)).otherwise(F.array(own))
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 2).alias("walk_id"), F.col("o_orderkey").alias("seq"), F.explode(both).alias("c")) \
        .select("walk_id", "seq", "c.field", "c.value")


def forgotten(spark, sf_dir) -> DataFrame:
    return (table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
            .select(F.col("o_custkey").alias("walk_id")).distinct())


# Settings stored for each walk and the changes asked for, as JSON text.
STORED = [
    ("gate", "dead", "0.15"), ("gate", "band", "[0.25,0.75]"), ("faces", "fov_deg", "110.0"),
    ("faces", "size", "1024"), ("faces", "yaws", "[45,135,225,315]"),
    ("embed", "model_name", '"vit_base_patch16_dinov3.lvd1689m"'), ("embed", "batch_size", "8"),
    ("calib", "samples", "10"), ("calib", "far_seconds", "20.0"), ("calib", "false_merge_pct", "5.0"),
    ("dedup", "tau", "0.94"), ("dedup", "rule", '"calibrated"'), ("dedup", "solo_floor", "0.5"),
    ("segment", "enabled", "false"), ("segment", "threshold", "0.2"), ("segment", "classes", '["rebar"]'),
]
ASKED = [
    ("gate", "dead", "0.2"), ("gate", "dead", "1.0"), ("gate", "band", "[0.5,0.2]"),
    ("faces", "fov_deg", "110.0"), ("faces", "size", "512"), ("faces", "yaws", "[0,90,180,270]"),
    ("faces", "yaws", "[0,0]"), ("embed", "model_name", '"unknown"'), ("embed", "batch_size", "16"),
    ("calib", "false_merge_pct", "2.0"), ("calib", "samples", "1"), ("dedup", "tau", "0.9"),
    ("dedup", "rule", '"fixed"'), ("segment", "classes", '["", " "]'), ("segment", "threshold", "0.2"),
    ("segment", "enabled", "true"), ("faces", "fov_deg", "110"), ("faces", "yaws", "[45, 135, 225, 315]"),
    ("calib", "samples", "10.5"), ("dedup", "solo_span", "45"), ("dedup", "solo_span", "30.0"),
    ("gate", "band", "[0.250, 0.75]"), ("embed", "batch_size", "8.0"),
]


def _settings(rows) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), F.lit(v).alias("value"))
                     for s, f, v in rows])


def stored_settings(spark, sf_dir) -> DataFrame:
    """Defaults, but customers in building have another gate."""
    other = (F.col("c_mktsegment") == "BUILDING") & (F.col("s.section") == "gate") & (F.col("s.field") == "dead")
    return (table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.explode(_settings(STORED)).alias("s"))
            .select(F.col("c_custkey").alias("walk_id"), "s.section", "s.field",
                    F.when(other, "0.2").otherwise(F.col("s.value")).alias("value")))


def settings_requests(spark, sf_dir) -> DataFrame:
    """Each order asks for one or two changes."""
    key = F.col("o_orderkey")
    n = len(ASKED)
    asked = F.array_distinct(F.array((key % n).cast("int"), F.expr(f"cast((o_orderkey div {n}) % {n} as int)")))
    pick = F.element_at(_settings(ASKED), F.col("i") + 1)
    rows = (table(spark, sf_dir, "orders").select(key, "o_custkey", F.explode(asked).alias("i"))
            .select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("walk_id"), "i", pick.alias("s")))
    # a request names a setting once: the later of two values for it stands
    return (rows.groupBy("request_id", "walk_id", "s.section", "s.field")
            .agg(F.max_by("s.value", "i").alias("value")))


def sketched_walks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("walk_id"))


def inventory(spark, sf_dir) -> DataFrame:
    bal = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("walk_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "embed").when(F.col("c_mktsegment") == "MACHINERY", "")
        .alias("job_stage"),
        (bal > -500).alias("has_source"), (bal > 3000).alias("has_manifest"),
        (F.col("c_nationkey") < 5).alias("has_failure"), (bal > 1000).alias("has_panos"))
