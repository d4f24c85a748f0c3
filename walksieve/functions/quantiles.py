"""Exact percentiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one
task. Here a mergeable summary brackets each wanted rank first; only the rows
inside a bracket are then ordered. The result is exact, with linear
interpolation between the two neighbouring ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000   # a summary of n rows is off by at most n / ACCURACY ranks


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """One row per group: `n` and one column per entry of `probs` (name -> 0..1).

    NULL values are ignored, as in a percentile.
    """
    # 4 / accuracy of the rows cover the summary's error on either side and the
    # two ranks of an interpolation, once a group has `accuracy` rows; smaller
    # groups are ordered whole
    slack = 4.0 / accuracy
    names = list(probs)
    marks = [m for p in probs.values() for m in (max(p - slack, 0.0), min(p + slack, 1.0))]
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    summary = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", marks, accuracy).alias("_marks"))

    def bracket(i: int, p: float):
        """(low, high) around the wanted ranks; the extremes are known exactly."""
        small = F.col("n") <= accuracy
        low = F.lit(True) if p - slack <= 0 else small
        high = F.lit(True) if p + slack >= 1 else small
        return (F.when(low, F.col("_min")).otherwise(F.col("_marks")[2 * i]),
                F.when(high, F.col("_max")).otherwise(F.col("_marks")[2 * i + 1]))

    brackets = F.array(*[F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high"))
                         for i, p in enumerate(probs.values()) for low, high in [bracket(i, p)]])
    near = (rows.join(summary.select(*group, "n", brackets.alias("_brackets")), group)
            .select(*group, "n", "_v", F.explode("_brackets").alias("_b"))
            .filter(F.col("_v") <= F.col("_b.high")))
    # everything under a bracket is one cell; equal values inside are one cell each
    cell = F.when(F.col("_v") < F.col("_b.low"), F.lit(float("-inf"))).otherwise(F.col("_v"))
    cells = (near.groupBy(*group, "n", F.col("_b.i").alias("_i"), cell.alias("_v"))
             .agg(F.count(F.lit(1)).alias("_n")))
    upto = F.sum("_n").over(Window.partitionBy(*group, "_i").orderBy("_v")
                            .rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumn("_upto", upto)
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("_i") + 1)
    at = ranked.withColumn("_pos", prob * (F.col("n") - 1))
    ends = at.groupBy(*group, "n", "_i", "_pos").agg(
        F.min(F.when(F.col("_upto") > F.floor("_pos"), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_upto") > F.ceil("_pos"), F.col("_v"))).alias("_hi"))
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
    return (ends.groupBy(*group, "n")
            .agg(*[F.max(F.when(F.col("_i") == i, q)).alias(name)
                   for i, name in enumerate(names)]))
