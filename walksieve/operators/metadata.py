"""Walk metadata: upsert, patch and removal.

Changes come as rows (walk_id, seq, field, value): one row per field supplied,
value as text. Rows of one walk and seq are one change set; a set that names an
unknown field is refused as a whole. The latest row per walk and field holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walksieve.params import META_FIELDS

NUMERIC = {"mount_height_cm"}


def unknown_fields(changes: DataFrame) -> DataFrame:
    """Changes to fields that do not exist; these are refused."""
    return changes.filter(~F.col("field").isin(*META_FIELDS))


def refused_sets(changes: DataFrame) -> DataFrame:
    """walk_id, seq, fields: change sets with fields that do not exist."""
    return unknown_fields(changes).groupBy("walk_id", "seq").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def latest_changes(changes: DataFrame) -> DataFrame:
    """One row per walk: the last supplied value of each field, NULL if none."""
    def last(field: str) -> Column:
        mine = (F.col("field") == field) & F.col("value").isNotNull()
        return F.max_by("value", F.when(mine, F.col("seq"))).alias(field)

    known = changes.join(unknown_fields(changes), ["walk_id", "seq"], "left_anti")
    return known.groupBy("walk_id").agg(*[last(f) for f in META_FIELDS])


def _merged(field: str) -> Column:
    new = F.col(f"new.{field}").try_cast("int") if field in NUMERIC else F.col(f"new.{field}")
    kept = F.coalesce(new, F.col(f"old.{field}"))
    return (kept if field in NUMERIC else F.coalesce(kept, F.lit(""))).alias(field)


def upsert(walks: DataFrame, changes: DataFrame) -> DataFrame:
    """Walks with the changes applied; new walks start from blank fields."""
    new, old = latest_changes(changes).alias("new"), walks.alias("old")
    return (old.join(new, F.col("old.walk_id") == F.col("new.walk_id"), "full_outer")
            .select(F.coalesce("old.walk_id", "new.walk_id").alias("walk_id"),
                    *[_merged(f) for f in META_FIELDS]))


def patch(walks: DataFrame, changes: DataFrame) -> DataFrame:
    """Walks with the changes applied; '' clears a field, an absent one stays."""
    new, old = latest_changes(changes).alias("new"), walks.alias("old")
    return (old.join(new, F.col("old.walk_id") == F.col("new.walk_id"), "left")
            .select("old.walk_id", *[_merged(f) for f in META_FIELDS]))


def patch_missing(walks: DataFrame, changes: DataFrame) -> DataFrame:
    """Patched walks that have no metadata: walk_id, changes."""
    return (changes.join(walks.select("walk_id"), "walk_id", "left_anti")
            .groupBy("walk_id").agg(F.count(F.lit(1)).alias("changes")))


def forget(table: DataFrame, walk_ids: DataFrame) -> DataFrame:
    """`table` without the rows of the given walks."""
    return table.join(walk_ids.select("walk_id").distinct(), "walk_id", "left_anti")
