"""A walk's threshold from a false-merge budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walksieve.functions.ordinals import integer_ordinal
from walksieve.functions.text import neighbour_name
from walksieve.functions.vectors import dot
from walksieve.operators.pairs import BINS, BLOCK, far_cells, far_histogram
from walksieve.params import HEALTHY_REFERENCE, MIN_FAR_PAIRS, SKETCH_SIZE, Calib
from walksieve.session import cut, written


def _lerp(low: Column, high: Column, at: Column) -> Column:
    return low + (high - low) * (at - F.floor(at))


def walk_cells(histogram: DataFrame) -> DataFrame:
    """Histogram cells per walk with running totals: walk_id, bin, pairs, low, high, upto, n."""
    cells = histogram.groupBy("walk_id", "bin").agg(
        F.sum("pairs").alias("pairs"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = Window.partitionBy("walk_id")     # at most 20 001 cells per walk
    return (cells.withColumn("upto", F.sum("pairs").over(
                whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("n", F.sum("pairs").over(whole)))


_STATS = ("median", "p95", "p99", "tau")


def _position(name: str) -> Column:
    """Fractional rank of a statistic among `n` values."""
    share = {"median": F.lit(50.0), "p95": F.lit(95.0), "p99": F.lit(99.0),
             "tau": F.lit(100.0) - F.col("pct")}[name]
    return share / 100.0 * (F.col("n") - 1)


def _located(cell: Column, rank: Column) -> list[Column]:
    """Where a rank lies, given the cell it falls in: values below, low, high.

    The first and the last value of a cell are known exactly.
    """
    before = cell["upto"] - cell["pairs"]
    first, last = rank == before, rank == cell["upto"] - 1
    low = F.when(last & ~first, cell["high"]).otherwise(cell["low"])
    high = F.when(first, cell["low"]).otherwise(cell["high"])
    return [before.alias("before"), low.alias("low"), high.alias("high")]


def _bounds(ends: DataFrame) -> DataFrame:
    """One row per walk: the least and the greatest each statistic can be, rounded."""
    at = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    rows = ends.groupBy("walk_id", "n", "pct", "top").agg(*[
        at(2 * s + e, c).alias(f"_{s}_{e}_{c}")
        for s in range(len(_STATS)) for e in (0, 1) for c in ("low", "high")])
    stat = lambda s, c: F.round(_lerp(F.col(f"_{s}_0_{c}"), F.col(f"_{s}_1_{c}"), _position(_STATS[s])), 4)
    return rows.select("walk_id", "n", "top", *[
        stat(s, c).alias(f"{name}_{c}") for s, name in enumerate(_STATS) for c in ("low", "high")])


def far_quantiles(faces: DataFrame, histogram: DataFrame, calib: Calib = Calib(),
                  budgets: DataFrame | None = None, size: int = BLOCK) -> DataFrame:
    """Exact statistics of the far cosines, one row per walk with far pairs.

    walk_id, n, median, p95, p99, max, tau (all 4 decimals; tau is NULL with
    too few pairs). `budgets` may set false_merge_pct per walk.

    The cell of a wanted rank bounds its value. Where that leaves a rounded
    statistic open, the walk's blocks meet again and count only inside the
    bounds, in 4 096 finer cells, until it is settled. Only cells ever move,
    also where a third of a walk's faces are copies with near-equal cosines.
    """
    cells = walk_cells(histogram)
    if budgets is None:
        cells = cells.withColumn("pct", F.lit(float(calib.false_merge_pct)))
    else:
        cells = cells.join(budgets.select("walk_id", F.col("false_merge_pct").cast("double")
                                          .alias("pct")), "walk_id")
    ranks = [f(_position(name)).cast("long") for name in _STATS for f in (F.floor, F.ceil)]
    cell = F.struct("upto", "pairs", "low", "high")
    found = cells.groupBy("walk_id", "n", "pct").agg(
        F.max("bin").alias("top"),
        *[F.min(F.when(F.col("upto") > r, cell)).alias(f"_{i}") for i, r in enumerate(ranks)])
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.alias("rank"), F.col(f"_{i}").alias("cell"))
                       for i, r in enumerate(ranks)])
    rows = found.select("walk_id", "n", "pct", "top", F.explode(wanted).alias("w"))
    keys = ["walk_id", "n", "pct", "top", "i", "rank"]
    ends = cut(rows.select("walk_id", "n", "pct", "top", "w.i", "w.rank",
                           *_located(F.col("w.cell"), F.col("w.rank"))))
    spread = None
    unsettled = F.lit(False)
    for name in _STATS:
        unsettled = unsettled | (F.col(f"{name}_low") != F.col(f"{name}_high"))
    while True:
        bounds = _bounds(ends)
        unclear = bounds.filter(unsettled).select("walk_id")
        left = ends.agg(F.sum(F.col("high") - F.col("low"))).first()[0]
        # products summed in another order may fall outside bounds by a last bit; then
        # nothing is narrowed any more, and the lower bound is as good as the upper one
        if unclear.isEmpty() or (spread is not None and left >= spread):
            break
        spread = left
        ranges = written(
            ends.join(unclear, "walk_id", "left_semi").filter("low < high").groupBy("walk_id")
            .agg(F.collect_list(F.struct("i", "low", "high")).alias("ranges")), "ranges")
        finer = far_cells(faces, ranges, calib.far_seconds, size)
        upto = F.sum("pairs").over(Window.partitionBy("walk_id", "i").orderBy("cell")
                                   .rowsBetween(Window.unboundedPreceding, 0))
        targets = ends.select("walk_id", "i", "rank", F.col("before").alias("_base"))
        hit = (finer.withColumn("upto", upto).join(targets, ["walk_id", "i"])
               .withColumn("upto", F.col("upto") + F.col("_base"))
               .groupBy("walk_id", "i")
               .agg(F.min(F.when(F.col("upto") > F.col("rank"), cell)).alias("_c")))
        moved = ends.withColumnsRenamed({"before": "_before", "low": "_low", "high": "_high"}) \
            .join(hit, ["walk_id", "i"], "left")
        new = _located(F.col("_c"), F.col("rank"))
        ends = cut(moved.select(*keys, *[F.coalesce(c, F.col(f"_{o}")).alias(o) for c, o in
                                         zip(new, ("before", "low", "high"))]))
    return bounds.select(
        "walk_id", "n", *[F.col(f"{s}_low").alias(s) for s in ("median", "p95", "p99")],
        (F.col("top") / BINS).alias("max"),
        F.when(F.col("n") >= MIN_FAR_PAIRS, F.col("tau_low")).alias("tau"))


def sketch_cells(histogram: DataFrame, keep: int = SKETCH_SIZE) -> DataFrame:
    """The far sketch as counted values: walk_id, value, first, copies.

    Keeps every value up to `keep` of them, else the ranks of `keep` evenly
    spaced positions. Rounding to 4 decimals keeps the order, so the cells of
    the histogram give exactly the values at those ranks. `first` is the
    position of a value's first copy in the sketch.
    """
    step = F.col("n") - 1
    # how many of the spaced ranks lie under a running total c: rank(i) is
    # i*(n-1)/(keep-1) rounded half to even
    def ranks_under(c: Column) -> Column:
        num, den = (c * 2 - 1) * (keep - 1), step * 2
        whole = F.ceil(num.cast("decimal(38,0)") / den).cast("long")
        tie = (num % den == 0) & ((c - 1) % 2 == 0)
        return F.least(F.greatest(whole + tie.cast("int"), F.lit(0)), F.lit(keep))

    cells = walk_cells(histogram)
    before = F.col("upto") - F.col("pairs")
    thin = F.col("n") > keep
    first = F.when(thin, F.when(before > 0, ranks_under(before)).otherwise(0)).otherwise(before)
    until = F.when(thin, ranks_under(F.col("upto"))).otherwise(F.col("upto"))
    return (cells.select("walk_id", (F.col("bin") / BINS).alias("value"),
                         first.cast("long").alias("first"), (until - first).cast("long").alias("copies"))
            .filter("copies > 0"))


def far_sketch(histogram: DataFrame, keep: int = SKETCH_SIZE) -> DataFrame:
    """One row per kept far cosine in ascending order: walk_id, position, cosine."""
    places = F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)
    return sketch_cells(histogram, keep).select(
        "walk_id", F.explode(places).alias("position"), F.col("value").alias("cosine"))


def sketch_arrays(histogram: DataFrame, keep: int = SKETCH_SIZE) -> DataFrame:
    """The sketch as one sorted array per walk (at most `keep` numbers)."""
    runs = F.array_sort(F.collect_list(F.struct("value", "copies")))
    return (sketch_cells(histogram, keep).groupBy("walk_id").agg(runs.alias("_runs"))
            .select("walk_id", F.flatten(F.transform("_runs", lambda r: F.array_repeat(
                r["value"], r["copies"].cast("int")))).alias("cosines")))


def sample_panos(faces: DataFrame, samples: int) -> DataFrame:
    """Panoramas spread evenly through each walk: walk_id, pano_idx."""
    panos = faces.select("walk_id", "pano_idx").distinct()
    if samples <= 0:
        return panos.limit(0)
    placed = integer_ordinal(panos, ["walk_id"], "pano_idx", "_pos")
    counts = panos.groupBy("walk_id").agg(F.count(F.lit(1)).alias("_n"))
    i = F.sequence(F.lit(0), F.lit(samples - 1))
    spread = F.transform(i, lambda k: F.bround(
        k * (F.col("_n") - 1) / F.lit(max(samples - 1, 1))).cast("long"))
    wanted = F.when(F.col("_n") > samples, F.array_distinct(spread)) \
        .otherwise(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    chosen = counts.select("walk_id", F.explode(wanted).alias("_pos"))
    return placed.join(chosen, ["walk_id", "_pos"], "left_semi").drop("_pos")


def _next_frame(native_fps: float) -> Column:
    """Number of the frame straight after a panorama's own."""
    return F.bround(F.col("t_sec") * F.lit(float(native_fps))).cast("long") + 1


def reference_frames(faces: DataFrame, native_fps: float, samples: int) -> DataFrame:
    """The frames that reference pairs need: walk_id, frame_no."""
    chosen = sample_panos(faces, samples)
    return (faces.join(chosen, ["walk_id", "pano_idx"], "left_semi")
            .select("walk_id", _next_frame(native_fps).alias("frame_no")).distinct())


def reference_pairs(faces: DataFrame, neighbours: DataFrame, native_fps: float,
                    samples: int) -> DataFrame:
    """Kept faces against the same heading of the frame straight after them.

    `neighbours`: walk_id, frame_no, yaw, embedding of the re-projected frames.
    A frame or heading that is not there gives no pair.
    """
    chosen = sample_panos(faces, samples)
    at = (faces.join(chosen, ["walk_id", "pano_idx"], "left_semi")
          .withColumn("frame_no", _next_frame(native_fps)))
    near = neighbours.select("walk_id", "frame_no", F.col("yaw").cast("int").alias("yaw"),
                             F.col("embedding").alias("_next"))
    return at.join(near, ["walk_id", "frame_no", "yaw"]).select(
        "walk_id", F.col("pano_idx").alias("pano"), "yaw",
        F.round("t_sec", 1).alias("t_sec"), F.col("path").alias("face"),
        neighbour_name(F.col("pano_idx"), F.col("yaw")).alias("neighbour"),
        F.round(dot(F.col("embedding"), F.col("_next")), 4).alias("cosine"))


def reference_stats(pairs: DataFrame) -> DataFrame:
    """Per walk: n, median, p05, min and the pairs in ascending order.

    A walk has at most samples x headings reference pairs.
    """
    entry = F.struct("cosine", "pano", "yaw", "t_sec", "face", "neighbour")
    return pairs.groupBy("walk_id").agg(
        F.count(F.lit(1)).alias("ref_n"),
        F.round(F.percentile("cosine", F.lit(0.5)), 4).alias("ref_median"),
        F.round(F.percentile("cosine", F.lit(0.05)), 4).alias("ref_p05"),
        F.round(F.min("cosine"), 4).alias("ref_min"),
        F.array_sort(F.collect_list(entry)).alias("pairs"))


def assemble_record(walks: DataFrame, far: DataFrame, sketch: DataFrame, reference: DataFrame,
                    calib: Calib, gap_seconds: Column, reference_error: Column) -> DataFrame:
    """One nested calibration record per walk of `walks`."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c.split("_")[-1])
    joined = (walks.join(far, "walk_id", "left").join(sketch, "walk_id", "left")
              .join(reference, "walk_id", "left"))
    far_part = F.struct(F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero("median"),
                        zero("p95"), zero("p99"), zero("max"),
                        F.coalesce("cosines", F.array().cast("array<double>")).alias("cosines"))
    ref_part = F.struct(zero("ref_median"), zero("ref_p05"), zero("ref_min"),
                        F.coalesce("ref_n", F.lit(0)).cast("long").alias("n"))
    no_pairs = F.array().cast(
        "array<struct<cosine:double,pano:int,yaw:int,t_sec:double,face:string,neighbour:string>>")
    return joined.select(
        "walk_id", "tau", F.lit(float(calib.false_merge_pct)).alias("false_merge_pct"),
        F.lit(float(calib.far_seconds)).alias("far_seconds"), F.lit(calib.samples).alias("samples"),
        F.coalesce("pairs", no_pairs).alias("pairs"), far_part.alias("far"),
        ref_part.alias("reference"),
        (F.coalesce("ref_n", F.lit(0)) > 0).__and__(
            F.coalesce("ref_median", F.lit(0.0)) >= HEALTHY_REFERENCE).alias("healthy"),
        reference_error.alias("reference_error"), F.round(gap_seconds, 4).alias("gap_seconds"))


def calibrate(faces: DataFrame, neighbours: DataFrame, native_fps: float,
              calib: Calib = Calib(), size: int = BLOCK) -> DataFrame:
    """The calibration record of every walk in `faces`."""
    histogram = cut(far_histogram(faces, calib.far_seconds, size))
    pairs = reference_pairs(faces, neighbours, native_fps, calib.samples)
    reference = reference_stats(pairs)
    error = F.when(F.col("ref_n").isNull(), F.lit("no reference frame was exported")) \
        .otherwise(F.lit(""))
    return assemble_record(
        faces.select("walk_id").distinct(),
        far_quantiles(faces, histogram, calib, size=size), sketch_arrays(histogram),
        reference, calib, F.lit(1.0 / native_fps), error)


def low_reference_pairs(record: DataFrame) -> DataFrame:
    """Reference pairs at or under their walk's threshold."""
    return (record.filter("tau IS NOT NULL")
            .select("walk_id", "tau", F.explode("pairs").alias("p"))
            .filter(F.col("p.cosine") <= F.col("tau"))
            .select("walk_id", "tau", "p.*"))


def can_requantile(record: DataFrame) -> Column:
    return F.size("far.cosines") > 0


def requantile(record: DataFrame, false_merge_pct: float | Column) -> DataFrame:
    """New budget answered from the stored sketch; vectors are not read.

    The far statistics become those of the sketch. Walks without a stored
    sketch are left out: they need a new calibration.
    """
    pct = F.lit(float(false_merge_pct)) if isinstance(false_merge_pct, (int, float)) \
        else false_merge_pct
    kept = F.col("far.cosines")     # ascending
    n = F.size(kept)

    def at(percent: Column) -> Column:
        pos = percent / 100.0 * (n - 1)
        low = F.element_at(kept, (F.floor(pos) + 1).cast("int"))
        high = F.element_at(kept, (F.ceil(pos) + 1).cast("int"))
        return F.round(_lerp(low, high, pos), 4)

    far = F.struct(n.cast("long").alias("n"), at(F.lit(50.0)).alias("median"),
                   at(F.lit(95.0)).alias("p95"), at(F.lit(99.0)).alias("p99"),
                   F.element_at(kept, -1).alias("max"), kept.alias("cosines"))
    return (record.filter(can_requantile(record))
            .withColumn("tau", F.when(n >= MIN_FAR_PAIRS, at(F.lit(100.0) - pct)))
            .withColumn("false_merge_pct", pct.cast("double"))
            .withColumn("far", far))
