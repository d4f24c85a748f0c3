"""Review: replay of the decision log, picks, and the views over them.

A decision row has id, walk_id, anchor and pick (face names) and action.
A manifest row has walk_id, face_idx, path, kept, anchor (face index), cosine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walksieve.params import ACTIONS, BORDERLINE_MARGIN


def replay_columns() -> list[Column]:
    """State of a group after its decisions, as aggregates that need no order.

    The pick is the last one made; the group is dropped if the last decision
    dropped it, since both other actions bring it back.
    """
    return [F.max_by("pick", F.when(F.col("action") == "pick", F.col("id"))).alias("pick"),
            (F.max_by("action", "id") == "drop").alias("dropped")]


def replay(decisions: DataFrame) -> DataFrame:
    """walk_id, anchor, pick, dropped per group with a decision."""
    return decisions.groupBy("walk_id", "anchor").agg(*replay_columns())


def override_log(decisions: DataFrame, walk_id=None) -> DataFrame:
    """The log in order, of all walks or of one."""
    rows = decisions if walk_id is None else decisions.filter(F.col("walk_id") == F.lit(walk_id))
    return rows.orderBy("id")


def validate(decisions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Decisions by face index, checked against the manifest.

    Input: id, walk_id, anchor_idx, action, pick_idx. Adds `reason`, '' when
    accepted, and the face names to log; drop and restore log no pick.
    """
    anchors = manifest.filter("kept").select(
        "walk_id", F.col("face_idx").alias("anchor_idx"), F.col("path").alias("anchor"))
    picks = manifest.select("walk_id", F.col("face_idx").alias("pick_idx"),
                            F.col("path").alias("_pick"), F.col("anchor").alias("_of"))
    # without a pick the anchor is looked up, so that missing picks share no join key
    joined = (decisions.join(anchors, ["walk_id", "anchor_idx"], "left")
              .withColumn("_look", F.coalesce("pick_idx", "anchor_idx"))
              .join(picks.withColumnRenamed("pick_idx", "_look"), ["walk_id", "_look"], "left"))
    member = (F.col("pick_idx") == F.col("anchor_idx")) | (F.col("_of") == F.col("anchor_idx"))
    in_group = F.col("_pick").isNotNull() & F.coalesce(member, F.lit(False))
    reason = (F.when(~F.col("action").isin(*ACTIONS), F.lit("unknown action"))
              .when(F.col("anchor").isNull(), F.lit("not a kept anchor"))
              .when((F.col("action") == "pick") & ~in_group, F.lit("not in the group"))
              .otherwise(F.lit("")))
    return joined.withColumn("reason", reason).select(
        "id", "walk_id", "anchor_idx", "action", "pick_idx", "reason",
        F.when(F.col("reason") == "", F.col("anchor")).alias("anchor"),
        F.when((F.col("reason") == "") & (F.col("action") == "pick"), F.col("_pick")).alias("pick"))


def resolve_picks(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Per kept anchor: the face its stored pick means today.

    A pick counts while it names the anchor or a face the anchor absorbed;
    otherwise the anchor itself stands. Columns: walk_id, anchor_idx, anchor,
    pick_idx, dropped, decided.
    """
    anchors = manifest.filter("kept").select(
        "walk_id", F.col("face_idx").alias("anchor_idx"), F.col("path").alias("anchor"))
    faces = manifest.select("walk_id", F.col("path").alias("pick"),
                            F.col("face_idx").alias("_idx"), F.col("anchor").alias("_of"))
    stored = state.select("walk_id", "anchor", "pick", "dropped", F.lit(True).alias("decided"))
    valid = (F.col("_idx") == F.col("anchor_idx")) | (F.col("_of") == F.col("anchor_idx"))
    # a group without a pick looks up its own anchor, so that no join key is shared
    return (anchors.join(stored, ["walk_id", "anchor"], "left")
            .withColumn("pick", F.coalesce("pick", "anchor"))
            .join(faces, ["walk_id", "pick"], "left")
            .select("walk_id", "anchor_idx", "anchor",
                    F.when(valid, F.col("_idx")).otherwise(F.col("anchor_idx")).alias("pick_idx"),
                    F.coalesce("dropped", F.lit(False)).alias("dropped"),
                    F.coalesce("decided", F.lit(False)).alias("decided")))


def effective_picks(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """The faces that ship: one per group not dropped, with `overridden`."""
    chosen = resolve_picks(manifest, state).filter("NOT dropped")
    picked = manifest.select("walk_id", F.col("face_idx").alias("pick_idx"), "pano_idx", "t_sec",
                             "yaw", F.col("path").alias("source_face"))
    return (chosen.join(picked, ["walk_id", "pick_idx"])
            .select("walk_id", "anchor_idx", "pick_idx", "source_face", "pano_idx", "t_sec", "yaw",
                    (F.col("pick_idx") != F.col("anchor_idx")).alias("overridden")))


def review_counts(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Per walk: dropped and overridden groups among those that exist now."""
    moved = F.col("pick_idx") != F.col("anchor_idx")
    return resolve_picks(manifest, state).groupBy("walk_id").agg(
        F.count_if(F.col("dropped")).alias("dropped"),
        F.count_if(F.col("decided") & ~F.col("dropped") & moved).alias("overridden"))


def group_members(manifest: DataFrame) -> DataFrame:
    """Every candidate of every group: walk_id, anchor_idx, member columns, is_anchor."""
    own = F.when(F.col("kept"), F.col("face_idx")).otherwise(F.col("anchor"))
    return (manifest.withColumn("anchor_idx", own).filter("anchor_idx IS NOT NULL")
            .select("walk_id", "anchor_idx", F.col("kept").alias("is_anchor"), "face_idx",
                    "pano_idx", "t_sec", "yaw", "path", "cosine", "sharpness"))


def review_groups(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """The groups as rows, one per candidate, with the group's pick and drop state.

    Sorted by (walk_id, anchor_idx, is_anchor desc, cosine desc, face_idx) the
    rows read as the review screen does: anchor first, then the closest member.
    A group stays as many rows, since one place may have any number of views.
    """
    return group_members(manifest).join(
        resolve_picks(manifest, state).select("walk_id", "anchor_idx", "pick_idx", "dropped"),
        ["walk_id", "anchor_idx"])


def in_review_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy("walk_id", "anchor_idx", F.desc("is_anchor"), F.desc("cosine"), "face_idx")


def borderline_members(manifest: DataFrame, state: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Candidates with their sharpness against the group's best and a flag near tau.

    A candidate is borderline when it is not the live pick and its cosine is
    less than tau + 0.015. `thresholds` (walk_id, tau) are those in force, fixed ones
    included; without one, nothing of a walk is borderline and its rows stay.
    """
    rows = review_groups(manifest, state)
    best = rows.groupBy("walk_id", "anchor_idx").agg(F.max("sharpness").alias("_best"))
    live_pick = (F.col("face_idx") == F.col("pick_idx")) & ~F.col("dropped")
    close = F.col("cosine") < F.col("tau") + BORDERLINE_MARGIN
    return (rows.join(best, ["walk_id", "anchor_idx"])
            .join(thresholds.select("walk_id", "tau"), "walk_id", "left")
            .select("walk_id", "anchor_idx", "face_idx", "is_anchor",
                    (F.col("sharpness") / F.when(F.col("_best") != 0, F.col("_best")).otherwise(1.0))
                    .alias("relative"),
                    (F.coalesce(close, F.lit(False)) & ~live_pick).alias("borderline")))


def walk_list(walks: DataFrame, manifest: DataFrame, state: DataFrame, failures: DataFrame) -> DataFrame:
    """Every walk with face and kept counts, ready flag, metadata and failure.

    `walks` carries the metadata columns; `failures` has walk_id and stage.
    """
    faces = manifest.groupBy("walk_id").agg(F.count(F.lit(1)).alias("faces"),
                                            F.count_if("kept").alias("_anchors"))
    dropped = review_counts(manifest, state).select("walk_id", "dropped")
    failed = failures.select("walk_id", F.col("stage").alias("failed_stage"))
    return (walks.join(faces, "walk_id", "left").join(dropped, "walk_id", "left")
            .join(failed, "walk_id", "left")
            .withColumn("faces", F.coalesce("faces", F.lit(0)))
            .withColumn("kept", F.coalesce("_anchors", F.lit(0)) - F.coalesce("dropped", F.lit(0)))
            .withColumn("ready", F.col("faces") > 0)
            .drop("_anchors", "dropped"))
