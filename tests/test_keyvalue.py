"""The key-value source: round trips, splits, filters that skip blocks, commits and failures."""

import os

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import keyvalue as kv


def rows_of(df):
    return sorted((r.key, bytes(r.value)) for r in df.collect())


def sample(n):
    return [(f"{k * 7919 % n:06d}/é", bytes([k % 256]) * (k % 50)) for k in range(n)]


def test_round_trip_splits_and_filters(spark, tmp_path):
    path, want = f"{tmp_path}/store", sorted(sample(3000))
    kv.write_store(spark.createDataFrame(sample(3000), "key string, value binary").repartition(5), path, block_kb=1)
    small = kv.read_store(spark, path, split_mb=0.005)
    assert small.rdd.getNumPartitions() > 10 and rows_of(small) == want
    assert rows_of(kv.read_store(spark, path)) == want
    for tests, keep in (
        ([("=", "000042/é")], lambda k: k == "000042/é"),
        ([("in", ["000001/é", "002999/é", "x"])], lambda k: k in ("000001/é", "002999/é")),
        ([("^", "0012")], lambda k: k.startswith("0012")),
        ([(">=", "000100"), ("<", "000110")], lambda k: "000100" <= k < "000110"),
        ([(">", "002990/é"), ("<=", "002995/é")], lambda k: "002990/é" < k <= "002995/é"),
        ([("in", [])], lambda k: False),
    ):
        some = kv.read_store(spark, path, tests, split_mb=0.05)
        assert rows_of(some) == [r for r in want if keep(r[0])]
        assert rows_of(some.where(F.length("value") > 10)) == [r for r in want if keep(r[0]) and len(r[1]) > 10]
        assert some.count() == len([r for r in want if keep(r[0])])
    # filters of queries are Spark's own, whatever was asked of the same table before
    assert rows_of(small.where("key = '000042/é'")) == [r for r in want if r[0] == "000042/é"] and small.count() == 3000
    with pytest.raises(Exception, match="no tests of a key"):
        kv.read_store(spark, path, [("~", "x")]).count()
    assert kv.get(spark, path, "000042/é") == dict(want)["000042/é"] and kv.get(spark, path, "none") is None


def test_wanted_keys_skip_blocks(spark, tmp_path):
    path = f"{tmp_path}/store"
    kv.write_store(spark.createDataFrame(sample(2000), "key string, value binary"), path, block_kb=1)
    reader = kv._Reader({"path": path, "split_mb": "1", "keys": '[["=", "000042/é"]]'})
    blocks = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(blocks) == 1 and blocks[0].num_rows == 1


def test_appends_overwrites_and_failures(spark, tmp_path):
    path = f"{tmp_path}/store"
    kv.write_store(spark.createDataFrame([("b", b"1"), ("a", None)], "key string, value binary"), path)
    kv.write_store(spark.createDataFrame([("c", b"2"), ("a", b"3")], "key string, value binary"), path)
    assert rows_of(kv.read_store(spark, path)) == [("a", b""), ("a", b"3"), ("b", b"1"), ("c", b"2")]
    files = sorted(os.listdir(path))
    bad = spark.range(200, numPartitions=4).select(F.when(F.col("id") == 150, None).otherwise(F.col("id").cast("string")).alias("key"), F.lit(b"x").alias("value"))
    with pytest.raises(Exception, match="key is null"):
        bad.sortWithinPartitions("key").write.format("quarrystone_kv").option("path", path).mode("append").save()
    assert kv.read_store(spark, path).count() == 4
    kv.vacuum(path)
    assert sorted(os.listdir(path)) == files
    kv.write_store(spark.createDataFrame([("z", b"9")], "key string, value binary"), path, mode="overwrite")
    assert rows_of(kv.read_store(spark, path)) == [("z", b"9")] and sum(f.endswith(".kv") for f in os.listdir(path)) == 1


def test_empty(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert kv.read_store(spark, path).count() == 0
    kv.write_store(spark.createDataFrame([], "key string, value binary"), path)
    assert kv.read_store(spark, path).count() == 0
