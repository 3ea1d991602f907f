"""Tensor files, manifests and image tensors against plain loops."""

from math import ceil, floor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galena.functions import tensors as images
from galena.sources import tensors


@pytest.mark.parametrize("dtype, kind", [("f32", "<f4"), ("f16", "<f2")])
def test_flat_file_by_ranges(spark, tmp_path, dtype, kind):
    data = np.random.default_rng(1).normal(size=(23, 5)).astype(kind)
    (tmp_path / "t.bin").write_bytes(data.tobytes())
    rows = tensors.read_tensor(spark, f"file:{tmp_path}/t.bin", 5, dtype, split_bytes=5 * data.itemsize * 4)
    assert rows.rdd.getNumPartitions() == 6
    got = {r.row: r.vector for r in rows.collect()}
    assert got == {k: v.astype("float32").tolist() for k, v in enumerate(data)}
    tensors.write_tensor(rows, f"{tmp_path}/out", 5, dtype)
    again = tensors.read_tensor(spark, f"{tmp_path}/out", 5, dtype)
    assert {r.row: r.vector for r in again.collect()} == got


def test_bad_files_and_vectors(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(b"1234567")
    with pytest.raises(Exception, match="no whole rows"):
        tensors.read_tensor(spark, f"{tmp_path}/t.bin", 1).collect()
    (tmp_path / "none.bin").write_bytes(b"")
    assert tensors.read_tensor(spark, f"{tmp_path}/none.bin", 3).count() == 0
    with pytest.raises(Exception, match="has not 2 entries"):
        tensors.write_tensor(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "row long, vector array<float>"), f"{tmp_path}/bad", 2)
    assert not [p for p in (tmp_path / "bad").glob("*")]


def test_gather(spark):
    table = spark.createDataFrame([(k, [float(k)]) for k in range(4)], "row long, vector array<float>")
    tokens = spark.createDataFrame([(0, 3), (1, 0), (2, 3)], "at int, token_id long")
    assert sorted((r.at, r.vector) for r in tensors.gathered(tokens, table).collect()) == [(0, [3.0]), (1, [0.0]), (2, [3.0])]
    for bad in (4, -1, None):
        with pytest.raises(Exception, match="token id beyond the table"):
            tensors.gathered(spark.createDataFrame([(0, bad)], "at int, token_id long"), table).collect()


def loop_at(image, y, x):
    h, w = image.shape[:2]
    y, x = min(max(y, 0), h - 1), min(max(x, 0), w - 1)
    y0, x0 = floor(y), floor(x)
    y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
    top = image[y0, x0] + (image[y0, x1] - image[y0, x0]) * (x - x0)
    low = image[y1, x0] + (image[y1, x1] - image[y1, x0]) * (x - x0)
    return top + (low - top) * (y - y0)


def loop_resized(image, height, width):
    h, w = image.shape[:2]
    return np.array([[loop_at(image, (i + 0.5) * h / height - 0.5, (j + 0.5) * w / width - 0.5) for j in range(width)] for i in range(height)])


@pytest.mark.parametrize("size, to", [((5, 7), (11, 3)), ((1, 1), (4, 5)), ((6, 6), (6, 6)), ((9, 2), (2, 9))])
def test_resize(size, to):
    image = np.random.default_rng(2).integers(0, 256, (*size, 3)).astype(float)
    assert np.allclose(images.resized(image, *to), loop_resized(image, *to))


def test_patches_and_positions():
    image = np.random.default_rng(3).integers(0, 256, (10, 13, 3)).astype(float)
    big = np.floor(loop_resized(image, 8, 12) + 0.5) / 127.5 - 1
    want = [big[4 * a : 4 * a + 4, 4 * b : 4 * b + 4].ravel() for a in range(2) for b in range(3)]
    got = images.patches(image, 8, 12, 4, 8)
    assert np.allclose(got[:6], want, atol=1e-6) and not got[6:].any() and got.shape == (8, 48)
    base = np.random.default_rng(4).normal(size=(4, 4, 5))
    table = images.position_table(base, 2, 3, 9)
    assert np.allclose(table[:6], loop_resized(base, 2, 3).reshape(6, 5), atol=1e-6) and np.allclose(table[6:], table[0])
    stretched = images.clip_tensor(image, 6, [0.5, 0.4, 0.3], [0.2, 0.3, 0.4])
    assert np.allclose(stretched, ((np.floor(loop_resized(image, 6, 6) + 0.5) / 255 - [0.5, 0.4, 0.3]) / [0.2, 0.3, 0.4]).transpose(2, 0, 1), atol=1e-5)
    assert images.clip_tensor(image, 6, [0.5] * 3, [0.5] * 3, crop=True).shape == (3, 6, 6)
    square = images.clip_tensor(image[:, 1:11], 6, [0.5] * 3, [0.5] * 3, crop=True)
    assert np.allclose(square, images.clip_tensor(image[:, 1:11], 6, [0.5] * 3, [0.5] * 3))


def loop_size(width, height, most, patch=16):
    raw = (width // patch) * (height // patch)
    bucket = next((b for b in sorted({128, 256, 576, 784, 1024, most}) if b <= most and raw <= b), most)
    sized = lambda scale, size: max(patch, ceil(size * scale / patch) * patch)
    low, high = 1e-6, 100
    while high - low >= 1e-5:
        middle = (low + high) / 2
        low, high = (middle, high) if sized(middle, height) // patch * (sized(middle, width) // patch) <= bucket else (low, middle)
    return bucket, sized(low, width), sized(low, height)


def test_sizes_and_images_in_spark(spark):
    sizes = [(1, 1), (16, 16), (640, 480), (480, 640), (4000, 3), (3, 4000), (300, 300), (1000, 1000), (17, 5000)]
    rows = spark.createDataFrame([(w, h, bytes([7]) * (3 * w * h if w * h < 10_000 else 5)) for w, h in sizes], "w int, h int, rgb binary")
    for most in (256, 1024, 100):
        b = images.patch_bucket(F.col("w"), F.col("h"), 16, most)
        got = {(r.w, r.h): (r.b, r.s.width, r.s.height) for r in rows.withColumn("b", b).select("w", "h", "b", images.patch_size(F.col("w"), F.col("h"), F.col("b")).alias("s")).collect()}
        assert got == {s: loop_size(*s, most) for s in sizes}
    got = rows.filter("w < 20 and h < 20 or w = 1000").select("w", images.image_patches(F.col("w"), F.col("h"), F.col("rgb")).alias("t")).collect()
    for r in got:
        if r.w == 1000:
            assert r.t.patches is None
        else:
            n = r.t.grid_height * r.t.grid_width
            assert sum(r.t.mask) == n and len(r.t.mask) == r.t.max_patches and np.allclose(r.t.patches[: n * 768], 7 / 127.5 - 1) and not any(r.t.patches[n * 768 :])


def test_manifest_of_nothing(spark):
    rows = spark.createDataFrame([("{}",), ("not json",), (None,)], "t string").select(tensors.manifest_check(F.from_json("t", tensors.MANIFEST)).alias("c"))
    assert [(r.c.valid, r.c.reason, r.c.missing) for r in rows.collect()] == [(False, "format", [])] * 3


def test_missing_files_are_not_broadcast(spark, capsys):
    """Each file once, also of a folder that comes twice; paths pack well, so a table of them is no small one."""
    text = '{"family":"fg_clip","text":{"onnx":"t","tokenizer":"v","token_embedding":{"file":"e"}},"image":{"onnx":"i","preprocess":{"kind":"fgclip_patch_tokens"}}}'
    own = spark.createDataFrame([("/a", text), ("/a", text), ("/b", "{}"), ("/c", None)], "folder string, t string").select("folder", F.from_json("t", tensors.MANIFEST).alias("manifest"))
    there = spark.createDataFrame([("/a/t",), ("/a/t",), ("/a/model_config.json",), ("/a/i",), ("/b/v",), (None,)], "path string")
    lost = tensors.missing_files(own, there)
    assert sorted(map(tuple, lost.collect())) == [("/a", "e"), ("/a", "image.preprocess.vision_pos_embedding"), ("/a", "v"), ("/b", "model_config.json"), ("/c", "model_config.json")]
    lost.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_patches_come_in_small_batches():
    """One batch of images in, many out: they are never held together."""
    cut, n = images.patch_batches(16, 256), 50
    frame = (pd.Series([8] * n), pd.Series([8] * n), pd.Series([bytes([7]) * 192] * n), pd.Series([128] * n), pd.Series([176] * n), pd.Series([176] * n))
    sizes = [len(out) for out in cut(iter([frame]))]
    assert sum(sizes) == n and max(sizes) * 256 * 768 * 4 <= images.BATCH_BYTES
