import gzip
import os

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import files, sinks


def test_listing(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", ".hidden.png", "c.txt", "sub/d.webp"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    tail = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    found = files.list_files(spark, str(tmp_path), ["png", ".jpg", ".webp"])
    assert tail(found) == ["a.jpg", "b.PNG", "d.webp"] and {r.size_bytes for r in found.collect()} == {5}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert tail(files.list_files(spark, str(tmp_path), recursive=False)) == ["a.jpg", "b.PNG", "c.txt"]


def test_png_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(range(24)), 2, 4, 3)], "id int, p binary, h int, w int, c int")
    made = sinks.encode_png(rows, "p", "h", "w", "c")
    size = made.select(files.png_size(F.col("png")).alias("s")).first().s
    assert (size.width, size.height) == (4, 2)
    (tmp_path / "x.png").write_bytes(bytes(made.first().png))
    (tmp_path / "bad.png").write_bytes(b"no image")
    read = {r.origin.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert read["bad.png"].height == -1 and read["x.png"].height == 2
    assert bytes(read["x.png"].data)[:3] == bytes([2, 1, 0])
    unit = files.read_images(spark, str(tmp_path)).where("height > 0").select(files.unit_pixels(F.col("data")).alias("u")).first().u
    assert unit[0] == pytest.approx((2 / 255 - 0.5) / 0.5)


def test_text_formats(spark):
    lines = spark.createDataFrame([("000 100 (720,1280,3)",), ("odd",)], "value string")
    assert [tuple(r) for r in files.parse_clips(lines).collect()] == [("000", 100, 720, 1280, 3), ("odd", None, None, None, None)]
    pairs = spark.createDataFrame([("a.png, b.png",), ("only",)], "value string")
    assert [tuple(r) for r in files.parse_pairs(pairs).collect()] == [("a.png", "b.png"), ("only", None)]
    log = spark.createDataFrame([("iter: 1,000 loss 0.5",), ("x iter: 2 loss 1",), ("iter: 3 loss nan?",)], "value string")
    assert [tuple(r) for r in files.parse_log(log, r"iter: ([\d,]+) loss (\S+)").collect()] == [(1000, 0.5), (3, None)]
    assert [r.key for r in files.parse_keys(spark.createDataFrame([("k1.png (1,2,3) 1",)], "value string")).collect()] == ["k1"]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"], 1), ("b", None, None)], "path string, available array<string>, n int")
    sinks.write_csv(rows, f"{tmp_path}/m")
    back = files.read_csv(spark, f"{tmp_path}/m", "path string, available string, n int", ["path"])
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("a", "x,y", 1), ("b", None, None)], key=str)
    with pytest.raises(ValueError):
        files.read_csv(spark, f"{tmp_path}/m", "path string", ["other"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_csv(rows, f"{tmp_path}/m")


def test_missing_writes_are_idempotent(spark, tmp_path):
    rows = spark.range(5).toDF("k")
    assert [sinks.write_missing(rows, f"{tmp_path}/t", "k") for _ in range(2)] == [5, 0]
    assert sinks.write_missing(spark.range(8).toDF("k"), f"{tmp_path}/t", "k") == 3


def test_tar_round_trip(spark):
    rows = spark.createDataFrame([(k // 2, f"d/f{k}.txt", bytearray(b"x" * k)) for k in range(5)], "shard long, name string, content binary")
    packed = sinks.tar_shards(rows, "shard", "name", "content").cache()
    assert sorted((r.shard, r.files) for r in packed.collect()) == [(0, 2), (1, 2), (2, 1)]
    assert gzip.decompress(bytes(packed.first().archive))
    got = sinks.extract_tars(packed).collect()
    assert sorted((r.shard, r.name, bytes(r.content)) for r in got) == sorted((k // 2, f"d/f{k}.txt", b"x" * k) for k in range(5))
    assert sinks.extract_tars(packed, packed.where("shard < 2")).count() == 1
    evil = sinks.tar_shards(spark.createDataFrame([(0, "../x", bytearray(b""))], "shard long, name string, content binary"), "shard", "name", "content")
    with pytest.raises(Exception, match="unsafe"):
        sinks.extract_tars(evil).collect()


def test_fetch_retries(spark):
    def get(url):
        if "bad" in url:
            raise OSError("no such host")
        return url.encode()

    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "i int, u string")
    out = {r.i: r for r in files.fetch(rows, "u", "i", get).collect()}
    assert bytes(out[1].content) == b"good" and not out[2].ok and "no such host" in out[2].error


def test_pool_stream(spark, tmp_path):
    from quarrystone.streaming import jobs

    spark.range(300).toDF("vec_id").repartition(3).write.parquet(f"{tmp_path}/in")
    out = jobs.run_to_end(jobs.pair_pool(jobs.open_stream(spark, f"{tmp_path}/in"), "vec_id", 2, 16, 1), "append", "pool").collect()
    emitted = [r.emitted for r in out]
    assert len(emitted) == len(set(emitted)) == 300 - 32 and set(emitted) <= set(range(300))
