import numpy as np
import pytest
from pyspark.sql import functions as F

from walksieve.operators import images, segmentation as S

LABELS = [(0, "wall"), (3, "floor"), (5, "ceiling"), (14, "door")]


def masks(spark, arrays):
    rows = [(0, f"f{i}", a.shape[0], a.shape[1], bytearray(a.astype(np.uint8).tobytes())) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "walk_id long, path string, height int, width int, mask binary")


def frame(counts):
    flat, at = np.zeros(10_000, int), 0
    for cls, n in counts.items():
        flat[at:at + n] = cls
        at += n
    return flat.reshape(100, 100)


def shares(spark, counts):
    labels = spark.createDataFrame(LABELS, "class_id int, label string")
    return [(r["class"], r.share) for r in S.class_shares(masks(spark, [frame(counts)]), labels).orderBy("rank").collect()]


def test_shares(spark):
    assert shares(spark, {5: 3000, 3: 1000}) == [("wall", 0.6), ("ceiling", 0.3), ("floor", 0.1)]
    assert shares(spark, {5: 5000, 14: 20}) == [("ceiling", 0.5), ("wall", 0.498)]      # a sliver is left out
    assert ("99", 0.2) in shares(spark, {5: 5000, 99: 2000})                            # no name: its number
    assert shares(spark, {3: 5000, 5: 5000}) == [("floor", 0.5), ("ceiling", 0.5)]      # ties: seen first
    assert shares(spark, {5: 99, 3: 100})[1:] == [("floor", 0.01)]


def test_class_mix_counts_every_frame(spark):
    rows = spark.createDataFrame([(0, "a", 1, 0, "wall", 0.8), (0, "a", 2, 3, "floor", 0.2), (0, "b", 1, 0, "wall", 0.4)],
                                 "walk_id long, path string, rank int, class_id int, class string, share double")
    seen = spark.createDataFrame([(0, p) for p in "abcd"], "walk_id long, path string")
    got = [(r["class"], r.share) for r in S.class_mix(rows, seen).orderBy("rank").collect()]
    assert got == [("wall", 0.3), ("floor", 0.05)]


def test_prompt_and_tokens():
    prompt, spans = S.prompt_spans(["pipe", "duct work"])
    assert prompt == "pipe. duct work." and [prompt[a:b] for a, b in spans] == ["pipe", "duct work"]
    assert S.class_tokens(["pipe", "duct work"], [(0, 0), (0, 4), (4, 5), (6, 10), (11, 15), (15, 16)]) == [[1], [3, 4]]
    with pytest.raises(ValueError):
        S.class_tokens(["pipe", "duct work"], [(0, 4)])


def named(spark, probs, tokens, threshold=0.2):
    logit = lambda p: float(np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))))
    df = spark.createDataFrame([(i, [logit(p) for p in row], 0.5, 0.5, 0.2, 0.4, 100, 50) for i, row in enumerate(probs)],
                               "det_idx int, logits array<double>, cx double, cy double, w double, h double, width int, height int")
    return S.name_detections(df, tokens, threshold).orderBy("det_idx").collect()


def test_detections(spark):
    two = [[0, 1], [0, 2]]
    assert [r.class_id for r in named(spark, [[0.3, 0.1, 0.9], [0.95, 0.5, 0.9]], two)] == [2, 2]
    assert named(spark, [[0.9, 0.5, 0.52]], two) == []            # too close to call
    assert named(spark, [[0.1, 0.1, 0.2]], two) == []             # under the threshold
    one = named(spark, [[0.6, 0.0, 0.0]], [[0]])
    assert one[0].class_id == 1 and one[0].score == pytest.approx(0.6, abs=1e-6)
    assert (one[0].x0, one[0].y0, one[0].x1, one[0].y1) == pytest.approx((40, 15, 60, 35))


def test_composite_paints_small_over_large(spark):
    a, b, c = (np.zeros((130, 4), np.uint8) for _ in range(3))
    a[:] = 1
    b[60:70] = 1
    c[69:79] = 1                                                   # as large as b, scores higher
    rows = [(7, i, cls, s, 130, 4, bytearray(m.tobytes())) for i, (m, cls, s) in
            enumerate([(b, 2, 0.3), (a, 1, 0.9), (c, 3, 0.5)])]
    df = spark.createDataFrame(rows, "frame_id long, det_idx int, class_id int, score double, height int, width int, mask binary")
    parts = S.composite(df).orderBy("stripe").collect()
    whole = np.concatenate([np.frombuffer(p.mask, np.uint8) for p in parts]).reshape(130, 4)
    want = np.ones((130, 4), int)
    want[60:69], want[69:79] = 2, 3
    assert (whole == want).all() and [p.top for p in parts] == [0, 64, 128]


def test_boundaries(spark):
    rng = np.random.default_rng(0)
    m = rng.integers(0, 3, (7, 5))
    got = S.boundaries(masks(spark, [m, np.full((4, 4), 2)])).orderBy("path").collect()
    want = np.array([[any(0 <= y + dy < 7 and 0 <= x + dx < 5 and m[y + dy, x + dx] != m[y, x]
                          for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))) for x in range(5)] for y in range(7)])
    assert (np.frombuffer(got[0].edges, np.uint8).reshape(7, 5) == want).all()
    assert got[0].edge_pixels == want.sum() and got[1].edge_pixels == 0


def test_segment_kept_only(spark):
    data = bytearray(np.arange(64, dtype=np.uint8).tobytes())
    pics = spark.createDataFrame([(0, p, (p, 8, 8, 1, 0, data)) for p in "ab"],
                                 "walk_id long, path string, image " + images.IMAGE.simpleString())
    manifest = spark.createDataFrame([(0, "a", True), (0, "b", False)], "walk_id long, path string, kept boolean")
    out = S.segment_kept(pics, manifest, S.band_segmenter(16)).collect()
    assert [r.path for r in out] == ["a"] and set(out[0].mask) == {0, 1, 2, 3}

    def wide():
        return lambda batch: np.stack([np.full(im.shape[:2], 300) for im in batch])
    with pytest.raises(Exception, match="8-bit"):
        S.segment_kept(pics, manifest, wide).collect()


def test_view_of_unknown_faces(spark):
    share = spark.createDataFrame([(0, "a", 1, 0, "wall", 0.9)], "walk_id long, path string, rank int, class_id int, class string, share double")
    frames = spark.createDataFrame([(0, "a"), (0, "gone")], "walk_id long, path string")
    manifest = spark.createDataFrame([(0, "a", 2.5, 45)], "walk_id long, path string, t_sec double, yaw int")
    got = {r.face: (r.t_sec, r.yaw) for r in S.segmentation_view(share, frames, manifest).collect()}
    assert got == {"a": (2.5, 45), "gone": (0.0, 0)}


def test_class_mix_does_not_depend_on_row_order(spark):
    """0.1 + 0.2 + 0.3 in any order against 0.6."""
    import random
    rows = [(1, f"f{i}", c, s) for c, shares in (("b", (0.1, 0.2, 0.3)), ("a", (0.3, 0.2, 0.1)), ("c", (0.6, 0.0, 0.0))) for i, s in enumerate(shares)]
    found = set()
    for seed in range(6):
        random.Random(seed).shuffle(rows)
        shares = spark.createDataFrame(rows, "walk_id long, path string, class string, share double").repartition(1 + seed)
        seen = shares.select("walk_id", "path").distinct()
        found.add(tuple(tuple(r) for r in S.class_mix(shares, seen).orderBy("rank").collect()))
    assert found == {((1, 1, "a", 0.2), (1, 2, "b", 0.2), (1, 3, "c", 0.2))}
