import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import arrays, config, images, registry, scalars
from quarrystone.operators import curate, metrics, ordering, sampling, sequence


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_numbered_and_ranked(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if k % 9 else None, rng.randint(0, 50), k) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(7)
    got = sorted(ordering.numbered(df, "v", "k").collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(300)) and [(r.v, r.k) for r in got] == sorted((v, k) for _, v, k in rows)
    for r in ordering.ranked(df, ["g"], "v", "k").collect():
        mine = sorted((v, k) for g, v, k in rows if g == r.g)
        assert mine[r.pos] == (r.v, r.k) and r["size"] == len(mine)
    assert ordering.numbered(df.limit(0), "k").count() == 0


def chunks(sizes, max_files, max_bytes):
    out, n, total, shard = [], 0, 0, 0
    for s in sizes:
        if n and (n >= max_files or total + s > max_bytes):
            shard, n, total = shard + 1, 0, 0
        n, total = n + 1, total + s
        out.append(shard)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_shards_against_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 20, 90, 300]) for _ in range(rng.choice([1, 37, 400]))]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k long, s long").repartition(5)
    got = curate.greedy_shards(df, ["k"], "s", 4 + seed, 100, width=16).orderBy("k").collect()
    assert [r.shard for r in got] == chunks(sizes, 4 + seed, 100)


def test_division_and_matching(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "x"), (None, "x"), (None, "y")], "k string, v string")
    assert values(curate.divide(rows, "k", "v", ["x", "y"])) == sorted([("a",), (None,)], key=str)
    found = spark.createDataFrame([("p", "m", "1px"), ("p", "m", "2px"), ("q", "m", "1px")], "key string, model string, resolution string")
    manifest = spark.createDataFrame([("p",), ("q",), ("r",)], "key string")
    out = curate.match_manifest(manifest, curate.index_embeddings(found), curate.parse_requirement("m:1px, 2px"))
    assert {r.key: r.status for r in out.collect()} == {"p": "matched", "q": "filtered", "r": "missing"}
    unknown = curate.match_manifest(manifest, curate.index_embeddings(found, ["other"]), [])
    assert {r.status for r in unknown.collect()} == {"missing"}
    for bad in ("m", "m:", ":1", "m: ,"):
        with pytest.raises(ValueError):
            curate.parse_requirement(bad)


def test_limits(spark):
    df = spark.createDataFrame([(10, 3, 4, True), (11, 3, 4, True), (10, 3, 5, True), (10, 3, 4, False), (None, 1, 1, True), (10, 3, 5, False), (10, None, None, False)], "s long, w int, h int, ok boolean")
    got = [r.v for r in df.select(curate.validity(F.col("s"), F.col("w"), F.col("h"), F.col("ok"), 10, 12).alias("v")).collect()]
    assert got == ["ok", "too_large", "too_many_pixels", "unreadable", "ok", "too_many_pixels", "unreadable"]
    report = spark.createDataFrame([("v", "a", 10, 3, 4, None), ("v", "b", 10, 3, 5, None), ("v", "c", 10, None, 1, None), ("w", "d", 1, 1, 1, None)], "stage string, path string, size_bytes long, width int, height int, over_limit boolean")
    assert [r.path for r in curate.filter_manifest(report, "v", 10, 7).collect()] == ["a"]
    with pytest.raises(ValueError):
        curate.filter_manifest(report.drop("width"), "v", 1, 1)


def test_paths(spark):
    assert one(spark, curate.path_key(F.lit("/r/a/b.c.png"), "/r")) == "a/b.c"
    got = one(spark, curate.embedding_key(F.lit("vae/128px/x/y.pt")))
    assert (got.key, got.model, got.resolution) == ("x/y", "vae", "128px")
    got = one(spark, curate.embedding_key(F.lit("a/b/bigpx/c//64px/d.tar.pt")))
    assert (got.key, got.model, got.resolution) == ("c/64px/d.tar", "a", "bigpx")
    for bad in ("vae/128px", "vae/128/x.pt", "128px/x/y.pt", "a/b/128px"):
        assert one(spark, curate.embedding_key(F.lit(bad))) is None
    assert one(spark, curate.after_marker(F.lit("a/cache/b/c"), "cache")) == "b/c"
    with pytest.raises(Exception, match="no segment"):
        one(spark, curate.after_marker(F.lit("a/b"), "cache"))
    paths = spark.createDataFrame([("a/b/c",), ("a/b/d",), ("a/bx",)], "p string")
    assert curate.common_prefix(paths, "p").first().common == "a"


def test_frame_padding_examples(spark):
    want = {"replicate": [0, 0, 0, 1, 2], "reflection": [2, 1, 0, 1, 2], "reflection_circle": [4, 3, 0, 1, 2], "circle": [3, 4, 0, 1, 2]}
    frames = spark.createDataFrame([("c", k) for k in range(10)], "clip string, idx int")
    for mode, indexes in want.items():
        rows = sequence.padded_windows(frames, "clip", "idx", 5, mode).where("idx = 0").orderBy("offset").collect()
        assert [r.source for r in rows] == indexes
    with pytest.raises(ValueError):
        sequence.padded_windows(frames, "clip", "idx", 4, "circle")
    assert [sequence.centred_list(n) for n in (1, 3, 5, 7)] == [[4], [3, 4, 5], [2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6, 7]]


def test_smoothing_over_block_edges(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.random()) for g in "ab" for k in range(23)]
    rows += [(None, k, rng.random()) for k in range(7)]
    for block in (2, 5, 100):  # 23 rows in blocks of 2 make blocks of blocks
        got = {(r.g, r.pos): r.smooth for r in sequence.smoothed(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], ["k"], "v", 0.8, block=block).collect()}
        assert len(got) == len(rows)
        for g in ("a", "b", None):
            y = None
            for k, v in sorted(r[1:] for r in rows if r[0] == g):
                y = v if y is None else y * 0.8 + v * (1 - 0.8)
                assert abs(got[g, k] - y) < 1e-12


def test_samplers(spark):
    df = spark.range(10).toDF("k")
    rows = sampling.enlarged(df, ["k"], 2, 3).collect()
    assert sorted(r.slot for r in rows) == list(range(21)) and all(r.k == r.slot % 10 and r["rank"] == r.slot % 3 for r in rows)
    shuffled = sampling.enlarged(df, ["k"], 2, 3, epoch=1).collect()
    assert sorted(r.slot for r in shuffled) == list(range(21)) and [r.k for r in sorted(shuffled, key=lambda r: r.slot)] != [k % 10 for k in range(21)]
    padded = sampling.padded_shards(df, ["k"], 4).groupBy("rank").count().collect()
    assert {r["count"] for r in padded} == {3}
    assert sampling.hash_sample(df, ["k"], 99, 1).count() == 10 and sampling.hash_sample(df, ["k"], 3, 1).collect() == sampling.hash_sample(df, ["k"], 3, 1).collect()
    assert sampling.head(df, 0, "k").count() == 10 and sampling.head(df, 2, "k").count() == 2


def test_weighted_loss_examples(spark):
    loss, weight = F.array(*map(F.lit, [1.0, 1.0, 2.0])), F.array(*map(F.lit, [1.0, 0.0, 1.0]))
    assert abs(one(spark, arrays.mae(F.array(*map(F.lit, [0.0, 2.0, 3.0])), F.array(*map(F.lit, [1.0, 1.0, 1.0])))) - 4 / 3) < 1e-9
    assert one(spark, arrays.weighted(loss, weight)) == 1.5 and one(spark, arrays.weighted(loss, weight, "sum")) == 3.0
    assert one(spark, arrays.weighted(loss, weight, "none")) == [1.0, 0.0, 2.0]


def test_scalar_examples(spark):
    assert [one(spark, scalars.period_index(F.lit(s), [100, 200, 300, 400])) for s in (50, 210, 300)] == [0, 2, 2]
    assert one(spark, scalars.prompt_slug(F.lit("Ein schönes, BILD!"))) == "ein_schönes_bild_"
    assert one(spark, scalars.run_slug(F.lit("  "))) == "run" and one(spark, scalars.or_default(F.lit(" x "), "run")) == "x"
    assert one(spark, scalars.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, arrays.psnr(F.lit(0.0))) == float("inf") and abs(one(spark, arrays.psnr_unit(F.lit(0.0))) - 80) < 1e-9


def test_moments_skip_nan(spark):
    rows = [([1.0, float("nan")],), ([3.0, 4.0],), ([5.0, 6.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [(r.dim, r.n, r.mean) for r in metrics.moments(df, "v").orderBy("dim").collect()] == [(0, 3, 3.0), (1, 2, 5.0)]
    cov = {(r.i, r.j): r.cov for r in metrics.covariance(df, "v").collect()}
    assert abs(cov[0, 1] - 2.0) < 1e-9 and len(cov) == 3


def test_frechet_against_definition():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 5)), rng.normal(1, 2, size=(300, 5))
    c1, c2 = np.cov(x.T), np.cov(y.T)
    root = np.linalg.eigvals(c1 @ c2).real
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * np.sqrt(np.maximum(root, 0)).sum()
    assert abs(metrics.frechet(x.mean(0), c1, y.mean(0), c2) - want) < 1e-8
    assert abs(metrics.frechet(x.mean(0), c1, x.mean(0), c1)) < 1e-8


def test_image_kernels():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (24, 16)).astype(float)
    assert abs(images.ssim_of(x, x) - 1) < 1e-12 and images.ssim_of(x, 255 - x) < 0.2
    assert np.abs(images.jpeg_grey(x, 100) - x).max() < 1e-9 or np.abs(images.jpeg_grey(x, 100) - x).max() <= 8
    assert np.abs(images.jpeg_grey(x, 10) - x).mean() > np.abs(images.jpeg_grey(x, 90) - x).mean()
    assert np.allclose(images.bessel_j1(np.array([0.0, 1.0, 5.0])), [0.0, 0.4400505857449335, -0.3275791375914652])
    assert abs(images.sinc_kernel(1.2, 21).sum() - 1) < 1e-12
    flow = rng.normal(size=(3, 4, 2)).astype(np.float32)
    assert (images.flow_from(images.flow_bytes(flow)) == flow).all()
    with pytest.raises(ValueError):
        images.flow_from(b"nope")
    assert np.allclose(images.warped(x, np.zeros_like(x), np.zeros_like(x)), x) and np.allclose(images.warped(x, np.ones_like(x), np.zeros_like(x))[:, :-1], x[:, 1:])
    assert np.allclose(images.filtered(x, np.eye(3)[1][:, None] * np.eye(3)[1]), x)
    a, left, right = images.aggd(rng.normal(size=20_000))
    assert abs(a - 2) < 0.15 and abs(left - right) < 0.1
    assert len(images.niqe_features(x)) == 18 and images.artifact_map(x, x * 0.9, x).shape == x.shape
    assert images.sharpened(x / 255).shape == x.shape
    n = images.poisson_noise(x / 255, 5)
    assert (n == images.poisson_noise(x / 255, 5)).all() and n.min() >= 0 and n.max() <= 1


def test_registry(spark):
    r = registry.Registry("thing")
    r.register(len, "size", suffix="quarrystone")
    assert r.get("size") is len and list(r) == ["size_quarrystone"]
    with pytest.raises(ValueError):
        r.register(len, "size", suffix="quarrystone")
    with pytest.raises(KeyError):
        registry.metric({"type": "none"}, F.lit(1), F.lit(1))
    a = F.array(*[F.lit(float(k)) for k in range(256)])
    assert one(spark, registry.metric({"type": "ssim", "width": 16}, a, a)) > 0.999
    assert one(spark, registry.weighted_losses([{"type": "l1", "weight": 2}, {"type": "mse"}], F.array(F.lit(1.0)), F.array(F.lit(3.0)))) == 8.0
    assert registry.register_sql(spark) == ["q_ssim"]


def test_config():
    base = {"a": {"b": 1, "c": 2}, "d": [1]}
    assert config.overridden(base, "a.b=true") == {"a": {"b": True, "c": 2}, "d": [1]} and base["a"]["b"] == 1
    assert [config.parsed(t) for t in ("1", "1.5", "~", "False", "x y", "[1, 2]")] == [1, 1.5, None, False, "x y", [1, 2]]
    assert config.flat(base) == {"a.b": 1, "a.c": 2, "d": [1]}
    with pytest.raises(ValueError):
        config.overridden(base, "a.b")


def test_image_kernels_against_plain_loops():
    import numpy as np

    from quarrystone.functions import images

    rng = np.random.default_rng(4)
    x, k = rng.random((5, 7)), rng.random((3, 2))
    for up, down, pad in ((1, 1, (0, 0)), (2, 3, (2, 1)), (3, 2, (-1, 4))):
        got = images.up_filter_down(x, k, up, down, pad)
        at = lambda r, c: x[r // up, c // up] if 0 <= r < 5 * up and 0 <= c < 7 * up and r % up == c % up == 0 else 0.0  # noqa: B023, E731
        for r in range(got.shape[0]):
            for c in range(got.shape[1]):
                want = sum(k[2 - i, 1 - j] * at(r * down + i - pad[0], c * down + j - pad[0]) for i in range(3) for j in range(2))
                assert abs(got[r, c] - want) < 1e-12
        assert got.shape[0] == (5 * up + sum(pad) - 3) // down + 1
    flat = np.full((9, 9), 3.0)
    for scale in (2, 3, 4):
        w = images.blur_weights(9, scale)
        assert np.allclose(images.resized(flat, w, w), 3.0) and w.shape == (-(-9 // scale), 9)
    a = rng.random((48, 16)) * 255
    b = np.clip(a + rng.normal(0, 9, a.shape), 0, 255)
    parts = [images.ssim_of(a[i : i + 16][1:-1, 1:-1], b[i : i + 16][1:-1, 1:-1]) for i in (0, 16, 32)]
    assert abs(images.ssim_channels(a, b, 3, border=1) - np.mean(parts)) < 1e-12 and images.ssim_channels(a, a, 3) > 1 - 1e-12


def test_fit_square_cuts_and_reflects(spark):
    from pyspark.sql import functions as F

    from quarrystone.functions import layout

    row = spark.createDataFrame([(list(range(6)),)], "v array<int>").select(layout.fit_square(F.col("v"), 3, 2, 2, 0, 1).alias("a"), layout.fit_square(F.col("v"), 3, 2, 3).alias("b"), layout.pad_multiple(F.col("v"), 3, 2, 4).alias("c")).first()
    assert row.a == [1, 2, 4, 5] and row.b == [0, 1, 2, 3, 4, 5, 0, 1, 2]
    assert row.c == [0, 1, 2, 1, 3, 4, 5, 4, 0, 1, 2, 1, 3, 4, 5, 4]


def test_weights_are_applied_a_vector_at_once(spark):
    weights = spark.createDataFrame([(0, 0, 0.5), (0, 2, 2.0), (3, 1, -1.0), (4, 9, 1.0)], "o int, i int, w double")
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, None), (4, []), (5, [None, None, 1e-12]), (6, [1e13, None, 0.25]), (7, [1.0, 2.0, 3.0]), (7, [1.0, 1.0, 1.0])]
    out = arrays.apply_weights(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", weights)
    got = {(r.id, r.o): r.value for r in out.collect()}
    assert got == {(1, 0): 6.5, (1, 3): -2.0, (2, 0): 0.5, (5, 0): 2e-12, (5, 3): None, (6, 0): 5e12 + 0.5, (6, 3): None, (7, 0): 9.0, (7, 3): -3.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # products aren't rows
