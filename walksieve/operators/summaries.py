"""Mergeable summaries of far cosines.

A walk's far cosines as a KLL sketch of fixed size. Summaries merge: those of many walks into
one of a site or of the fleet, and the pairs of later faces into a stored one. So a threshold for
any group, or for a walk that has grown, needs no vectors of faces seen before except for the
products with the new ones. It is approximate: the exact threshold of `calibration` stays the default.

A sketch takes one value at a time, while cells come with counts of millions. Merging a
sketch with itself doubles its weights, so the cells are sketched once per binary digit of their
counts and the digits are put together from the highest one down. The work follows the cells, not the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walksieve.operators.pairs import BINS
from walksieve.params import MIN_FAR_PAIRS, Calib

SIZE = 2048     # items of the lowest level of a sketch; a summary is some 25 kB at any number of pairs


def rank_error(size: int = SIZE) -> float:
    """The error of a rank, as a share of the pairs, that one sketch keeps to with 99 per cent
    chance. Putting digits together and merging add to it; the tests find it kept to twice."""
    return 2.296 / size ** 0.9723


def _both(one: Column, other: Column) -> Column:
    return F.when(one.isNull(), other).when(other.isNull(), one).otherwise(F.kll_sketch_merge_double(one, other))


def far_summary(histogram: DataFrame, by: tuple[str, ...] = ("walk_id",), size: int = SIZE) -> DataFrame:
    """Cells of `far_histogram` as one summary per group: `by`, sketch, n, max.

    The sketch holds the 4-decimal cosines. A histogram without rows gives none.
    """
    keys = [F.col(c) for c in by]
    digits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.call_function("shiftright", F.col("pairs"), b) % 2 == 1)
    rows = histogram.filter("pairs > 0").select(*keys, (F.col("bin") / BINS).alias("_value"), F.explode(digits).alias("_digit"))
    sketches = rows.groupBy(*keys, "_digit").agg(
        F.kll_sketch_agg_double("_value", F.lit(size)).alias("_sketch"), F.count(F.lit(1)).alias("_cells"), F.max("_value").alias("_top"))
    weight = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_digit"))
    held = sketches.groupBy(*keys).agg(      # at most 63 sketches
        F.map_from_entries(F.collect_list(F.struct("_digit", "_sketch"))).alias("_held"), F.max("_digit").alias("_highest"),
        F.sum(F.col("_cells") * weight).alias("n"), F.max("_top").alias("max"))
    whole = F.aggregate(F.sequence(F.col("_highest"), F.lit(0), F.lit(-1)), F.lit(None).cast("binary"),
                        lambda acc, b: _both(_both(acc, acc), F.try_element_at(F.col("_held"), b)))
    return held.select(*keys, whole.alias("sketch"), "n", "max")


def merged(summaries: DataFrame, by: tuple[str, ...] = (), size: int = SIZE) -> DataFrame:
    """Summaries of any parts as one per group of `by`, or as one of all."""
    rows = summaries.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"),
                                      F.sum("n").alias("n"), F.max("max").alias("max"))
    return rows.filter("n > 0")      # a group of nothing, which an empty table gives where `by` is empty


def with_later(stored: DataFrame, later: DataFrame, size: int = SIZE) -> DataFrame:
    """Stored summaries per walk with those of the pairs that later faces have brought."""
    return merged(stored.unionByName(later.select(*stored.columns)), ("walk_id",), size)


def summary_quantiles(summaries: DataFrame, calib: Calib = Calib()) -> DataFrame:
    """The statistics of `far_quantiles` from summaries: n, median, p95, p99, max, tau.

    Each is the value at its rank, without interpolation; n and max are exact; tau is NULL
    with too few pairs.
    """
    shares = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99), F.lit((100.0 - calib.false_merge_pct) / 100.0))
    found = summaries.withColumn("_q", F.kll_sketch_get_quantile_double("sketch", shares))
    groups = [c for c in summaries.columns if c not in ("sketch", "n", "max")]
    return found.select(*groups, "n", *[F.round(F.get("_q", F.lit(i)), 4).alias(c) for i, c in enumerate(("median", "p95", "p99"))], "max",
                        F.when(F.col("n") >= MIN_FAR_PAIRS, F.round(F.get("_q", F.lit(3)), 4)).alias("tau"))
