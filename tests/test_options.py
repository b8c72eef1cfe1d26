"""Scores with options against numpy; small rules of names, records and registries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import arrays, config, images, registry, scalars
from quarrystone.operators import curate, fidelity, storage


def test_scores_with_options(spark):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 256, (20, 17, 3)).astype(float) for _ in range(2))
    df = spark.createDataFrame([(1, a.ravel().tolist(), b.ravel().tolist()), (2, a.ravel().tolist(), a.ravel().tolist()), (3, None, b.ravel().tolist())], "id int, a array<double>, b array<double>")
    y = lambda x: x @ (np.array([65.481, 128.553, 24.966]) / 255) + 16
    size = (F.lit(20), F.lit(17))
    for border in (0, 3):
        cut = lambda x: x[border : x.shape[0] - border, border : x.shape[1] - border]  # noqa: E731, B023
        for luma in (False, True):
            p, q = (y(cut(x)) if luma else cut(x) for x in (a, b))
            got = {r.id: r.s for r in df.select("id", fidelity.psnr(F.col("a"), F.col("b"), *size, border=border, luma=luma).alias("s")).collect()}
            assert math.isclose(got[1], 10 * math.log10(255**2 / ((p - q) ** 2).mean()), rel_tol=1e-9) and got[2] == math.inf and got[3] is None
            found = {r.id: r.s for r in df.select("id", fidelity.ssim("a", "b", 20, 17, border=border, luma=luma).alias("s")).collect()}
            want = images.ssim_of(p, q) if luma else np.mean([images.ssim_of(p[:, :, c], q[:, :, c]) for c in range(3)])
            assert math.isclose(found[1], want, rel_tol=1e-9) and math.isclose(found[2], 1.0) and found[3] is None
    assert df.select(fidelity.ssim("a", "b", 20, 17, border=4).alias("s")).where("s is not null").count() == 0


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_devices(spark):
    names = lambda text: one(spark, scalars.device_list(F.lit(text)))
    assert names("cuda:1, gpu0,1, GPU:2 ,") == ["1", "0", "2"] and names("cpu, auto") is None and names("") is None
    for bad in ("cuda:,1", "tpu", "0,-1"):
        with pytest.raises(Exception, match="no device"):
            names(bad)
    found = one(spark, scalars.device_index(F.lit(" cuda: 7 ")))
    assert (found["index"], found.status) == ("7", "ok")
    assert one(spark, scalars.device_index(F.lit("0,1"))).status == "several"


def test_losses_by_arity(spark):
    a, b, w = (F.array(*map(F.lit, v)) for v in ([0.0, 2.0, 3.0], [1.0, 1.0, 1.0], [1.0, 0.0, 1.0]))
    assert one(spark, registry.evaluated("weighted_l1", a, b, w)) == 1.5 and abs(one(spark, registry.evaluated("mean", a, b)) - 5 / 3) < 1e-9
    assert abs(one(spark, registry.evaluated("l1", a, b)) - 4 / 3) < 1e-9
    with pytest.raises(ValueError, match="takes 3"):
        registry.evaluated("weighted_l1", a, b)
    spaces = {"latent": lambda x: x, "pixel": lambda x: F.transform(x, lambda v: v * 10)}
    at = lambda space: one(spark, registry.metric_in_space({"type": "psnr", "space": space}, a, b, spaces))
    assert abs(at("latent") - at("pixel") - 20) < 1e-9
    with pytest.raises(KeyError, match="no space"):
        at("other")
    scales = F.array(F.array(F.array(F.lit(9.0)), F.array(F.lit(1.0), F.lit(3.0))), F.array(F.array(F.lit(4.0))))
    assert one(spark, arrays.multi_scale_gan_loss(scales, "wgan", True)) == -3.0


def test_records_paths_guards_and_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, [["a", None], None, [" ", "b"]]), (2, []), (3, None)], "k int, n array<array<string>>")
    assert [tuple(r) for r in curate.flat_paths(rows, "n").collect()] == [(1, "a"), (1, "b")]
    with pytest.raises(ValueError, match="nothing"):
        curate.required_rows(rows.limit(0), "nothing")
    assert curate.required_rows(rows, "nothing") is rows
    report = spark.createDataFrame([("a", 5, 5, 10), ("b", 50, 5, 10), ("a", None, 5, 10), ("a", 5, 5, 99)], "stage string, width int, height int, size_bytes long")
    count = lambda **o: curate.filter_manifest(report, **o).count()
    assert [count(), count(stage="a"), count(max_bytes=10), count(stage="a", max_dimension_sum=10, max_bytes=10)] == [3, 2, 2, 1]
    a, b = (spark.createDataFrame(v, "k int, s string") for v in ([(1, "x"), (2, "y"), (3, None), (4, None)], [(1, "x"), (2, "z"), (3, None), (5, "q")]))
    assert {(r.k, r.fault) for r in curate.key_shape_faults(a, b, "k", "s").collect()} == {(2, "shape"), (4, "left"), (5, "right")}
    path = f"{tmp_path}/run"
    assert storage.archived(spark, path, "t1") is None
    rows.select("k").write.parquet(path)
    assert storage.archived(spark, path, "t1") == f"{path}_archived_t1" and spark.read.parquet(f"{path}_archived_t1").count() == 3
    rows.select("k").write.parquet(path)
    with pytest.raises(ValueError, match="can't be renamed"):
        storage.archived(spark, path, "t1")


def test_config_as_text():
    assert config.said({"a": 1, "b": {"c": "x", "d": {}}}) == "  a: 1\n  b:[\n    c: x\n    d:[\n    ]\n  ]\n"


def test_step_message_as_python_prints_it(spark):
    for epoch, step, rate in ((7, 7999, 1e-4), (3199, 3_199_999, 1e-4 / 3200), (12799, 12_799_000, 1e-4 / 12800)):
        made = lambda **options: one(spark, scalars.step_message(F.lit("baseline"), F.lit(epoch), F.lit(step), F.array(F.lit(rate), F.lit(0.5)), {"l": F.lit(1.00005)}, **options))  # noqa: B023, E731
        assert made() == f"[basel..][epoch:{epoch:3d}, step:{step:8,d}, lr:({rate:.3e},{0.5:.3e},)] l: {1.00005:.4e} "
        assert made(fixed=True).startswith(f"[basel..][epoch:{f'{epoch:3d}'[:3]}, step:{f'{step:8,d}'[:8]}, lr:(")


def test_step_messages_of_large_ids(spark, tmp_path):
    import duckdb

    from quarrystone.plans import catalogue

    duckdb.sql(f"COPY (SELECT k AS event_id, 0.5::DOUBLE AS value FROM (VALUES (0), (999999), (1000000), (3199005), (6399999)) t(k)) TO '{tmp_path}/events.parquet'")
    got = catalogue.QUERIES["step_messages"](spark, str(tmp_path)).collect()
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        assert sorted(map(tuple, got)) == sorted(c.sql(catalogue.ORACLES["step_messages"]).fetchall())
