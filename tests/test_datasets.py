"""Dataset plans and layouts: cases at the edges, and the drawn choices against hashlib."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import layout, scalars
from quarrystone.operators import curate, datasets
from quarrystone.operators.ordering import ranked
from quarrystone.streaming import jobs


def drawn(key, seed, purpose, n):
    return int(hashlib.md5(f"{key}:{seed}:{purpose}".encode()).hexdigest()[:8], 16) % n


def test_crop_and_flips_follow_the_digest(spark):
    rows = spark.createDataFrame([(1, 10, 12), (2, 4, 4), (3, 3, 40)], "id long, h int, w int")
    out = datasets.augmentation(datasets.crop_window(rows, "id", 9, "h", "w", 4, 2), "id", 9, rotate=False)
    found = {r["id"]: r for r in out.collect()}
    assert found[1]["top"] == drawn(1, 9, "top", 7) and found[1]["gt_left"] == 2 * drawn(1, 9, "left", 9)
    assert (found[2]["top"], found[2]["left"], found[2]["crop_status"]) == (0, 0, "ok")
    assert found[3]["top"] is None and found[3]["crop_status"] == "too_small"
    assert all(not r["vflip"] and not r["transpose"] and r["hflip"] == (drawn(r["id"], 9, "hflip", 2) == 0) for r in found.values())


def test_windows_stay_inside_their_clip(spark):
    clips = spark.createDataFrame([("a", 3), ("b", 20), ("c", 0), ("held", 9)], "clip string, n int")
    samples = datasets.frame_samples(clips, "clip", "n", ["held"])
    assert samples.count() == 23 and datasets.frame_samples(clips, "clip", "n", ["held"], inverse=True).count() == 9
    centred = datasets.centred_samples(samples, 5, [1, 3], 4, reverse=True).collect()
    assert {r["clip"] for r in centred} == {"b"} and len(centred) == 20
    for r in centred:
        assert sorted(r["frames"])[2] == r["centre"] and min(r["frames"]) >= 0 and max(r["frames"]) < 20
        assert len({b - a for a, b in zip(r["frames"], r["frames"][1:])}) == 1
    runs = datasets.recurrent_samples(samples, 3, [1], 4).collect()
    assert all(r["frames"] == [r["start"], r["start"] + 1, r["start"] + 2] and r["frames"][-1] < r["n_frames"] for r in runs)
    assert len(runs) == 23


def test_pairs_say_what_is_absent(spark):
    files = spark.createDataFrame([("m/256px/a.pt",), ("m/512px/a.pt",), ("m/256px/b.pt",), ("n/512px/b.pt",), ("m/256px/a.txt",)], "path string")
    pairs = datasets.latent_pairs(files, 256, 512)
    assert [tuple(r) for r in pairs.collect()] == [("m", "a.pt", "m/256px/a.pt", "m/512px/a.pt")]
    caches = spark.createDataFrame([("m",), ("n",)], "cache string")
    assert [r.cache for r in datasets.empty_caches(pairs, caches).collect()] == ["n"]
    gt, lq = spark.createDataFrame([("g/x.png",), ("g/y.png",)], "path string"), spark.createDataFrame([("l/xx4.png",)], "path string")
    assert {(r.gt_path, r.lq_path) for r in datasets.image_pairs(gt, lq, "{}x4").collect()} == {("g/x.png", "l/xx4.png"), ("g/y.png", None)}


def test_too_long_a_clip_is_an_error(spark):
    frames = spark.range(5).select(F.lit("a").alias("clip"), F.col("id").alias("idx"), F.array("id").alias("image"))
    assert datasets.stacked_clips(frames, "clip", "idx", "image").first()["images"] == [[k] for k in range(5)]
    with pytest.raises(Exception, match="too many frames"):
        datasets.stacked_clips(frames, "clip", "idx", "image", most_frames=4).collect()


def test_layouts_against_numpy(spark):
    image = np.arange(36)
    row = spark.range(1).select(F.array(*[F.lit(int(v)) for v in image]).alias("x"))
    get = lambda c: np.array(row.select(c.alias("y")).first()["y"])
    x = F.col("x")
    assert (get(layout.pixel_unshuffle(x, 6, 2)) == image.reshape(3, 2, 3, 2).transpose(1, 3, 0, 2).ravel()).all()
    assert (get(layout.channels_first(x, 4)) == image.reshape(9, 4).T.ravel()).all()
    assert (get(layout.channels_first(layout.channels_first(x, 4), 9)) == image).all()
    blocks = image.reshape(2, 3, 2, 3).transpose(0, 2, 1, 3).ravel()
    packed = spark.range(1).select(F.array(*[F.lit(int(v)) for v in blocks]).alias("x"))
    assert (np.array(packed.select(layout.merge_blocks(x, 6, 3).alias("y")).first()["y"]) == image).all()
    square = image.reshape(6, 6)
    wanted = [square]
    for change in (np.fliplr, np.flipud, np.transpose):
        wanted += [change(a) for a in wanted]
    assert (get(layout.orientations(x, 6)) == np.array([a.ravel() for a in wanted])).all()
    assert (get(layout.ensemble(layout.orientations(x, 6), 6)) == image).all()
    assert (get(layout.side_by_side(x, x, 6)) == np.hstack([square, square]).ravel()).all()
    assert layout.tile_boxes() == [(1, 256, 256, 768, 768), (2, 1280, 256, 1792, 768), (3, 256, 1280, 768, 1792), (4, 1280, 1280, 1792, 1792)]


def test_scalars(spark):
    rows = spark.createDataFrame([("true",), ("12",), ("1.5",), ("x",), (None,)], "t string")
    values = [r["v"] for r in rows.select(scalars.literal_value(F.col("t")).alias("v")).collect()]
    assert [(v["as_bool"], v["as_int"], v["as_float"], v["as_string"]) for v in values[:4]] == [(True, None, None, None), (None, 12, None, None), (None, None, 1.5, None), (None, None, None, "x")]
    with pytest.raises(Exception, match="unsupported type"):
        rows.select(scalars.dtype_name(F.col("t"), ["float16"])).collect()


@pytest.mark.parametrize("few", [200_000, 0])
def test_a_key_with_most_rows(spark, few):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, 7).when(F.col("id") % 30 == 2, None).otherwise(F.col("id")).alias("k"), "id")
    found = ranked(rows, ["k"], "id", few=few, block=100)
    assert found.columns == ["k", "id", "pos", "size"]
    hot = sorted((r["id"], r["pos"], r["size"]) for r in found.where("k = 7").collect())
    assert hot == [(i, n, 2000) for n, i in enumerate(i for i in range(3000) if i % 3 < 2)]
    empty = found.where("k is null").collect()
    assert len(empty) == 100 and {r["size"] for r in empty} == {100} and found.count() == 3000


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    events = spark.range(10).select("id", (F.col("id") % 3).alias("k"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = lambda: jobs.run_to_end(read(), "append", "rows", str(tmp_path / "job"))
    assert run().count() == 10
    spark.range(10, 14).select("id", (F.col("id") % 3).alias("k")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r["id"] for r in run().collect()) == list(range(14))


def test_statuses_of_an_empty_set(spark):
    none = spark.createDataFrame([], "path string")
    assert datasets.latent_pairs(none, 1, 2).count() == 0 and datasets.image_pairs(none, none).count() == 0
    assert curate.with_suffix(none, ["png"]).count() == 0
