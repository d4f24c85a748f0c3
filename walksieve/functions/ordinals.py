"""Positions within a group, without putting a group into one task.

A window over a whole group sorts that group in one task. Here a group is cut
into pieces of bounded size; only the pieces' row counts meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walksieve.session import cut

CHUNK = 1 << 16
_EARLIER = (Window.unboundedPreceding, -1)


def chunked(df: DataFrame, group: list[str], key: str, size: int = CHUNK) -> DataFrame:
    """Adds `_chunk`, a number that grows with the integer `key` within its group.

    A group of n rows has about n / size chunks, each covering an equal range of its
    keys. So dense keys (positions) and sparse ones (nanoseconds, ids of a shared
    sequence) both give chunks of about `size` rows, and few of them.
    """
    whole = F.col(key).cast("long")
    span = df.groupBy(*group).agg(F.min(whole).alias("_low"), F.max(whole).alias("_high"), F.count(F.lit(1)).alias("_rows"))
    pieces = F.expr(f"(_rows + {size - 1}) div {size}")
    span = span.withColumn("_pieces", pieces).select(*group, "_low", F.expr("(_high - _low) div _pieces + 1").alias("_width"))
    return df.join(span, group).withColumn("_chunk", F.expr(f"(cast(`{key}` as long) - _low) div _width")).drop("_low", "_width")


def _offsets(sizes: DataFrame, group: list[str], piece: str) -> DataFrame:
    """Rows in the earlier pieces of the same group."""
    earlier = Window.partitionBy(*group).orderBy(piece).rowsBetween(*_EARLIER)
    return sizes.select(*group, piece,
                        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))


def integer_ordinal(df: DataFrame, group: list[str], key: str, out: str,
                    size: int = CHUNK) -> DataFrame:
    """Adds the 0-based position by `key`, an integer unique in its group.

    No window spans more than a chunk of about `size` rows, or a group's chunks.
    """
    cutup = chunked(df, group, key, size)
    sizes = cutup.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    here = Window.partitionBy(*group, "_chunk").orderBy(key)
    return (cutup.withColumn("_within", F.row_number().over(here) - 1)
            .join(_offsets(sizes, group, "_chunk"), [*group, "_chunk"])
            .withColumn(out, (F.col("_before") + F.col("_within")).cast("long"))
            .drop("_chunk", "_within", "_before"))


def sorted_ordinal(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds the 0-based position by any total order within the group.

    One range shuffle on (group, order) spreads large groups over partitions.
    The sorted rows are written once, so that the counts and the rows agree.
    """
    keys = [F.col(g) for g in group] + order
    laid = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
               .withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    runs = laid.groupBy(*group, "_part").agg(F.min("_at").alias("_first"),
                                             F.count(F.lit(1)).alias("_n"))
    first = runs.select(*group, "_part", "_first")
    starts = _offsets(runs, group, "_part").join(first, [*group, "_part"])
    return (laid.join(starts, [*group, "_part"])
            .withColumn(out, (F.col("_before") + F.col("_at") - F.col("_first")).cast("long"))
            .drop("_at", "_part", "_first", "_before"))


def previous_row(df: DataFrame, group: list[str], key: str, columns: list[str],
                 size: int = CHUNK) -> DataFrame:
    """Adds struct `previous`: `columns` of the row before, by integer `key`.

    The first row of a chunk takes its value from the last row of the nearest
    earlier chunk of its group.
    """
    cutup = chunked(df, group, key, size)
    here = Window.partitionBy(*group, "_chunk").orderBy(key)
    value = F.struct(*columns)
    last = cutup.groupBy(*group, "_chunk").agg(F.max_by(value, F.col(key)).alias("_last"))
    carried = last.select(*group, "_chunk", F.lag("_last").over(
        Window.partitionBy(*group).orderBy("_chunk")).alias("_carried"))
    return (cutup.withColumn("_near", F.lag(value).over(here))
            .join(carried, [*group, "_chunk"])
            .withColumn("previous", F.coalesce("_near", "_carried"))
            .drop("_chunk", "_near", "_carried"))
