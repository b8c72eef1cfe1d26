"""Samples against numpy: order of turns, channels, normalisation, reflection; images that aren't there or don't fit."""

import numpy as np
from pyspark.sql import functions as F

from quarrystone.operators import samples

SCHEMA = "key long, image array<double>, h int, w int, gt array<double>, gh int, gw int"


def turned(x, r):
    x = x[:, ::-1] if r.hflip else x
    x = x[::-1] if r.vflip else x
    return x.transpose(1, 0, 2) if r.transpose else x


def rows_of(spark, shapes, channels, scale=2):
    rng = np.random.default_rng(1)
    images = {k: rng.random((h, w, channels)) for k, (h, w) in enumerate(shapes)}
    targets = {k: rng.random((h * scale, w * scale, channels)) for k, (h, w) in enumerate(shapes)}
    rows = [(k, x.ravel().tolist(), *x.shape[:2], targets[k].ravel().tolist(), *targets[k].shape[:2]) for k, x in images.items()]
    return images, targets, spark.createDataFrame(rows, SCHEMA)


def test_pairs(spark):
    images, targets, df = rows_of(spark, [(6, 9), (5, 5), (4, 4), (3, 9), (7, 6)] * 4, 3)
    df = df.withColumn("gw", F.when(F.col("key") == 1, 99).otherwise(F.col("gw")))
    out = samples.paired_patches(df, "key", "image", "gt", "h", "w", "gh", "gw", 3, 4, 2, 7, order=[2, 1, 0], mean=[0.1, 0.2, 0.3], std=[1.0, 2.0, 4.0], unit=2.0).collect()
    seen = set()
    for r in out:
        h, w, _ = images[r.key].shape
        want = "scale_mismatch" if r.key == 1 else "too_small" if min(h, w) < 4 else "ok"
        assert r.crop_status == want
        if want != "ok":
            assert r.lq_patch is None and r.gt_patch is None
            continue
        seen.add((r.hflip, r.vflip, r.transpose))
        for name, x, at, size in (("lq_patch", images[r.key], (r.top, r.left), 4), ("gt_patch", targets[r.key], (r.gt_top, r.gt_left), 8)):
            cut = turned(x[at[0] : at[0] + size, at[1] : at[1] + size], r)[:, :, [2, 1, 0]] / 2
            assert np.allclose(getattr(r, name), ((cut - [0.1, 0.2, 0.3]) / [1, 2, 4]).transpose(2, 0, 1).ravel())
    assert len(seen) > 3


def test_degradation_samples(spark):
    images, _, df = rows_of(spark, [(6, 9), (3, 20), (1, 4), (12, 2), (9, 9)] * 3, 3)
    for r in samples.degradation_samples(df, "key", "image", "h", "w", 3, 4, side=8, unit=1.0).collect():
        x = turned(images[r.key], r)
        x = np.pad(x, ((0, max(0, 8 - x.shape[0])), (0, max(0, 8 - x.shape[1])), (0, 0)), mode="reflect")
        x = x[r.top : r.top + 8, r.left : r.left + 8]
        assert x.shape == (8, 8, 3) and np.allclose(r.gt, x.transpose(2, 0, 1).ravel())
        assert len(r.plan.stages) == 2


def test_single_faces_and_latents(spark):
    images, targets, df = rows_of(spark, [(2, 3), (4, 2)], 3)
    for r in samples.single_images(df, "image", "h", "w", 3, [2, 1, 0], unit=0.5).collect():
        assert np.allclose(r.lq, (images[r.key][:, :, ::-1] / 0.5).transpose(2, 0, 1).ravel())
    grey = samples.single_images(df, "image", "h", "w", 3, luma=True, unit=1.0).where("key = 0").first().lq
    assert np.allclose(grey, (images[0] @ (np.array([65.481, 128.553, 24.966]) / 255) + 16).ravel())
    for r in samples.face_images(df, "key", "image", "h", "w", 3, 2, [0, 1, 2], [0.5] * 3, [0.5] * 3, unit=1.0).collect():
        x = images[r.key][:, ::-1] if r.hflip else images[r.key]
        assert np.allclose(r.gt, ((x - 0.5) / 0.5).transpose(2, 0, 1).ravel())
    lq, gt = np.arange(12.0).reshape(3, 2, 2), np.arange(48.0).reshape(3, 4, 4)
    pairs = spark.createDataFrame([(k, lq.ravel().tolist(), gt.ravel().tolist()) for k in range(12)] + [(50, [1.0], gt.ravel().tolist())], "key long, lq array<double>, gt array<double>")
    for train in (True, False):
        for r in samples.paired_latents(pairs, "key", "lq", "gt", (3, 2, 2), 2, 1, train).collect():
            flip = lambda x, r=r: x[:, :: -1 if r.vflip else 1, :: -1 if r.hflip else 1].ravel().tolist()
            assert r.gt_latent == flip(gt) and r.lq_latent == (flip(lq) if r.key < 50 else None)
            assert train or not (r.hflip or r.vflip)


def test_nothing_there(spark):
    rows = [(1, None, 2, 2, None, 4, 4), (2, [], 0, 0, [], 0, 0), (3, [1.0], 2, 2, [1.0], 4, 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.key: r for r in samples.single_images(df, "image", "h", "w", 1, unit=1.0).collect()}
    assert out[1].lq is None and out[2].lq is None and out[3].lq == [1.0, None, None, None]
    assert {r.crop_status for r in samples.paired_patches(df, "key", "image", "gt", "h", "w", "gh", "gw", 1, 2, 2, 1).collect()} == {"ok", "too_small"}
    assert samples.degradation_samples(df.where("key = 2"), "key", "image", "h", "w", 1, 1, side=4).first().gt is None
    assert samples.single_images(df.limit(0), "image", "h", "w", 1).count() == 0
