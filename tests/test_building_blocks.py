import numpy as np
import pytest
from pyspark.sql import functions as F

from walksieve.functions import ordinals, text
from walksieve.functions.quantiles import exact_quantiles
from walksieve.functions.vectors import l2_normalise


def test_integer_ordinal_of_a_hot_group(spark):
    keys = np.random.default_rng(0).permutation(5000)[:900].tolist()
    df = spark.createDataFrame([("hot", k) for k in keys] + [("cold", 7)], "g string, k long")
    got = ordinals.integer_ordinal(df, ["g"], "k", "at", size=50).collect()
    want = {k: i for i, k in enumerate(sorted(keys))}
    assert {r.k: r.at for r in got if r.g == "hot"} == want
    assert [r.at for r in got if r.g == "cold"] == [0]


@pytest.mark.parametrize("spacing", [1, 1_000, 10**12])
def test_sparse_keys_make_few_and_small_chunks(spark, spacing):
    """Nanosecond-like keys: neither one row per chunk nor all rows in one."""
    keys = [10**18 + spacing * k + (k % 7) * (spacing > 1) for k in range(2000)]
    df = spark.createDataFrame([("g", k) for k in keys], "g string, k long").repartition(3)
    sizes = [r["count"] for r in ordinals.chunked(df, ["g"], "k", 100).groupBy("g", "_chunk").count().collect()]
    assert max(sizes) <= 200 and len(sizes) <= 40
    got = {r.k: r.at for r in ordinals.integer_ordinal(df, ["g"], "k", "at", size=100).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    last = ordinals.previous_row(df, ["g"], "k", ["k"], size=100).filter(F.col("k") == max(keys)).first()
    assert last.previous.k == sorted(keys)[-2]


def test_sorted_ordinal(spark):
    rng = np.random.default_rng(1)
    data = [(int(g), float(v), i) for i, (g, v) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], 700), rng.integers(0, 20, 700)))]
    df = spark.createDataFrame(data, "g long, v double, i long")
    got = ordinals.sorted_ordinal(df, ["g"], [F.desc("v"), F.asc("i")], "at").collect()
    for g in (1, 2, 3):
        want = [i for _, i in sorted((-v, i) for gg, v, i in data if gg == g)]
        assert [r.i for r in sorted((r for r in got if r.g == g), key=lambda r: r.at)] == want
        assert sorted(r.at for r in got if r.g == g) == list(range(len(want)))


def test_previous_row_crosses_chunks(spark):
    df = spark.createDataFrame([("a", k, f"v{k}") for k in (1, 2, 30, 31, 95, 300)] + [("b", 5, "w")],
                               "g string, k long, v string")
    got = {(r.g, r.k): r.previous and r.previous.v
           for r in ordinals.previous_row(df, ["g"], "k", ["v"], size=10).collect()}
    assert got == {("a", 1): None, ("a", 2): "v1", ("a", 30): "v2", ("a", 31): "v30",
                   ("a", 95): "v31", ("a", 300): "v95", ("b", 5): None}


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.lognormal(size=4000), "ties": rng.integers(0, 3, 501).astype(float),
              "one": np.array([4.5]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)],
                               "g string, v double").repartition(6)
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"low": 0.0, "median": 0.5, "p95": 0.95, "top": 1.0},
                                           accuracy).collect()}
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        for name, p in (("low", 0), ("median", 50), ("p95", 95), ("top", 100)):
            assert got[g][name] == pytest.approx(np.percentile(vs, p)), (g, name)
    assert "none" not in got


def test_text(spark):
    row = lambda *cols: tuple(spark.range(1).select(*cols).first())
    assert row(text.slug(F.lit(" Tower 2 (East)!")), text.slug(F.lit(None).cast("string"))) == ("tower-2-east", "")
    assert row(text.join_present("_", F.lit("a"), F.lit(""), F.lit("b"))) == ("a_b",)
    assert row(text.face_name(F.lit(7), F.lit(45)), text.neighbour_name(F.lit(7), F.lit(45))) == \
        ("y045_00007.jpg", "n00007_y045.jpg")
    assert row(text.export_name(F.lit("p"), F.lit(12.5), F.lit(90))) == ("p_t0012.5_y090.jpg",)
    assert row(text.shot_stamp(F.lit("VID_20260728_114811_00_001.insv")), text.shot_stamp(F.lit("walk.insv"))) == \
        ("2026-07-28T11:48", "")
    assert row(text.clock_text(F.lit(144.4))) == ("2:24",)
    assert row(text.segmenter_label(F.lit("nvidia/segformer-b4-finetuned-ade-512-512"))) == ("SegFormer-B4 · ADE20K",)


def test_fixed_decimals_round_like_printf(spark):
    rng = np.random.default_rng(5)
    values = [0.125, 0.375, 0.625, 0.155, 0.145, 2.675, 0.25, 0.35, 0.05, 0.0, 12.96, 99.995, 0.99996, -0.004, -1.25, 30123.45] + \
        rng.uniform(-1000, 1000, 300).tolist() + [k / 10000 for k in range(0, 10000, 37)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = df.select("v", *[text.fixed(F.col("v"), p) for p in (1, 2, 4)]).collect()
    for v, *shown in got:
        for p, t in zip((1, 2, 4), shown):
            want = None if v is None else f"{v:.{p}f}"
            if want is not None and float(want) == 0:
                want = want.lstrip("-")
            assert t == want, (v, p)


def test_zero_vector_fails(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert [round(x, 4) for x in df.select(l2_normalise(F.col("v"))).first()[0]] == [0.6, 0.8]
    bad = spark.createDataFrame([([0.0, 0.0],)], "v array<float>")
    with pytest.raises(Exception, match="zero-norm"):
        bad.select(l2_normalise(F.col("v"))).collect()
