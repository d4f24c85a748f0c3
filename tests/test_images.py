import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from walksieve.operators import images
from walksieve.params import Faces
from walksieve.sources.images import scan_images, torn_frames, unreadable, whole_frames


def table(spark, arrays, names=None):
    rows = []
    for i, a in enumerate(arrays):
        a = np.asarray(a, dtype=np.uint8)
        c = 1 if a.ndim == 2 else a.shape[2]
        name = names[i] if names else f"y045_{i:05d}.jpg"
        rows.append((0, i, i * 0.5, name, (name, a.shape[0], a.shape[1], c, 0 if c == 1 else 16, bytearray(a.tobytes()))))
    return spark.createDataFrame(rows, "walk_id long, pano_idx int, t_sec double, name string, image "
                                       + images.IMAGE.simpleString())


def slow_laplacian(a):
    h, w = a.shape
    m = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    g = a.astype(float)
    out = [[g[m(y - 1, h), x] + g[m(y + 1, h), x] + g[y, m(x - 1, w)] + g[y, m(x + 1, w)] - 4 * g[y, x]
            for x in range(w)] for y in range(h)]
    return np.var(out)


def test_sharpness(spark):
    rng = np.random.default_rng(0)
    pics = [rng.integers(0, 256, (9, 13)), np.full((9, 13), 77), rng.integers(0, 256, (8, 6))]
    df = table(spark, pics)
    got = [r.s for r in df.orderBy("pano_idx").select("pano_idx", images.sharpness(F.col("image")).alias("s")).orderBy("pano_idx").collect()]
    assert got == pytest.approx([slow_laplacian(p) for p in pics])
    band = [r.s for r in df.select("pano_idx", images.pano_sharpness(F.col("image")).alias("s")).orderBy("pano_idx").collect()]
    assert band[0] == pytest.approx(slow_laplacian(pics[0][2:6]))


def test_blur_lowers_sharpness():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (32, 32)).astype(float)
    soft = (a + np.roll(a, 1, 0) + np.roll(a, 1, 1)) / 3
    assert images.laplacian_variance(soft) < images.laplacian_variance(a)


def compass(h=360, w=720):
    lon = np.tile(np.linspace(0, 255, w), (h, 1))
    lat = np.tile(np.linspace(0, 255, h)[:, None], (1, w))
    return np.stack([np.zeros((h, w)), lat, lon], axis=-1).astype(np.uint8)


def test_face_centre_looks_along_its_heading():
    pano = compass()
    for yaw in (0, 45, 135, 225, 315):
        face = images.project(pano, 65, 110.0, yaw)
        want = (((yaw + 180) % 360) / 360) * 255
        assert abs(float(face[32, 32, 2]) - want) < 3
        assert abs(float(face[32, 32, 1]) - 127.5) < 3


def test_neighbouring_headings_overlap():
    pano = compass()
    a, b = images.project(pano, 64, 110.0, 45), images.project(pano, 64, 110.0, 135)
    assert abs(int(a[32, -1, 2]) - int(b[32, 0, 2])) < 20       # 110 degrees at 90 spacing


def test_yaw_rings():
    assert images.yaw_ring(4) == [45, 135, 225, 315]
    assert images.yaw_ring(3) == [30, 150, 270]
    assert images.yaw_ring(6) == [0, 60, 120, 180, 240, 300]


def test_render_faces(spark):
    out = images.render_faces(table(spark, [compass(36, 72)]), Faces(size=16)).collect()
    assert sorted(r.path for r in out) == [f"y{y:03d}_00000.jpg" for y in (45, 135, 225, 315)]
    assert all(len(r.image.data) == 16 * 16 * 3 for r in out)


def test_embedding_is_unit_and_a_blank_picture_is_told(spark):
    rng = np.random.default_rng(2)
    df = table(spark, [rng.integers(0, 256, (16, 16, 3)) for _ in range(5)])
    for r in images.embed_images(df, images.grid_embedder(4), batch=2).collect():
        assert np.linalg.norm(r.embedding) == pytest.approx(1.0, abs=1e-5)
    blank = images.embed_images(table(spark, [np.full((8, 8), 9), rng.integers(0, 256, (8, 8))], ["a", "b"]), images.grid_embedder(4))
    got = {r.name: r for r in blank.collect()}
    assert got["a"].embedding is None and got["a"].problem and got["b"].embedding is not None and got["b"].problem == ""


def test_thumbnails(spark):
    rng = np.random.default_rng(3)
    photo, mask = rng.integers(0, 256, (512, 512, 3)), rng.integers(0, 9, (512, 512))
    df = table(spark, [photo, mask], ["a.jpg", "a.png"])
    got = {r.name: r.image for r in images.thumbnails(df).collect()}
    assert (got["a.jpg"].height, got["a.jpg"].width) == (256, 256)
    small = np.frombuffer(got["a.jpg"].data, np.uint8).reshape(256, 256, 3)
    assert np.abs(small - photo.reshape(256, 2, 256, 2, 3).mean(axis=(1, 3))).max() <= 0.5
    assert (np.frombuffer(got["a.png"].data, np.uint8).reshape(256, 256) == mask[::2, ::2]).all()
    with pytest.raises(ValueError):
        images.thumbnails(df, 100)


def test_stale_thumbs(spark):
    src = spark.createDataFrame([(0, "a", 5), (0, "b", 5), (0, "c", 5)], "walk_id long, name string, modified long")
    made = spark.createDataFrame([(0, "a", 5), (0, "b", 4)], "walk_id long, name string, modified long")
    assert sorted(r.name for r in images.stale_thumbs(src, made).collect()) == ["b", "c"]


def write_jpeg(spark, path, size=32):
    jvm = spark._jvm
    img = jvm.java.awt.image.BufferedImage(size, size, 5)
    for y in range(size):
        for x in range(size):
            img.setRGB(x, y, (x * 7) << 16 | (y * 5) << 8 | 90)
    jvm.javax.imageio.ImageIO.write(img, "jpg", jvm.java.io.File(path))


def test_scan_leaves_out_torn_files(spark, tmp_path):
    write_jpeg(spark, str(tmp_path / "good.jpg"))
    whole = (tmp_path / "good.jpg").read_bytes()
    (tmp_path / "torn.jpg").write_bytes(whole[:-40])
    (tmp_path / "short.jpg").write_bytes(b"\xff\xd9")
    (tmp_path / "junk.jpg").write_bytes(os.urandom(200) + b"\xff\xd9")
    got = scan_images(spark, str(tmp_path)).collect()
    assert [os.path.basename(r.image.origin) for r in got] == ["good.jpg"]
    assert got[0].image.height == 32
    assert "junk.jpg" in {r.name for r in unreadable(spark, str(tmp_path)).collect()}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert whole_frames(files).count() == 2 and torn_frames(files).count() == 2
