"""Block features by strips against the whole image, the fit against a search of the grid, scores against plain numpy."""

import math

import numpy as np
import pytest

from quarrystone.functions import images
from quarrystone.operators import niqe


def plain_aggd(x):
    """The definition: least squared difference of ratios over the whole grid."""
    r = lambda a: math.exp(2 * math.lgamma(2 / a) - math.lgamma(1 / a) - math.lgamma(3 / a))
    left, right = (math.sqrt(np.mean(x[m] ** 2)) for m in (x < 0, x > 0))
    g = left / right
    want = np.mean(np.abs(x)) ** 2 / np.mean(x**2) * (g**3 + 1) * (g + 1) / (g**2 + 1) ** 2
    a = min((0.2 + 0.001 * k for k in range(9801)), key=lambda a: (r(a) - want) ** 2)
    scale = math.sqrt(math.gamma(1 / a) / math.gamma(3 / a))
    return a, left * scale, right * scale


def test_fit():
    rng = np.random.default_rng(1)
    for x in (rng.normal(0, 1, 500), rng.laplace(0.3, 2, 400), rng.uniform(-1, 3, 300), np.array([-1.0, 5, 0, 0.1, -9])):
        assert np.allclose(images.aggd(x), plain_aggd(x), atol=1e-9)
    shape, left, right = images.aggd(np.array([1.0, 2.0, 0.0]))
    assert shape == 0.2 and math.isnan(left) and right > 0


def whole_image(x, block):
    """Both scales of the whole image at once, then blocks."""
    h, w = (n // block * block for n in x.shape)
    if not h or not w:
        return {}
    x = np.rint(x[:h, :w])
    half = niqe.half_weights(h, 0, h // 2) @ (x / 255) @ niqe.half_weights(w, 0, w // 2).T * 255
    a, b, k = images.normalised(x), images.normalised(half), block // 2
    at = lambda v, i, j, n: images.block_features(v[i * n : (i + 1) * n, j * n : (j + 1) * n])
    return {(i, j): at(a, i, j, block) + at(b, i, j, k) for i in range(h // block) for j in range(w // block)}


def test_half_weights_keep_lines_and_constants():
    w = niqe.half_weights(20, 0, 10)
    assert np.allclose(w.sum(1), 1) and np.allclose((w @ np.arange(20.0))[3:7], 2 * np.arange(3, 7) + 0.5)
    assert np.array_equal(niqe.half_weights(20, 4, 7), w[4:7])


def sample(seed, h, w):
    rng = np.random.default_rng(seed)
    return np.clip(rng.normal(128, 50, (h, w)) + 30 * np.sin(np.arange(w) / 3), 0, 255)


def test_strips_and_scores(spark):
    shapes = [(70, 50), (32, 32), (16, 48), (97, 33), (8, 90), (15, 15)]
    planes = {k: sample(k, *s) for k, s in enumerate(shapes)}
    df = spark.createDataFrame([(k, p.ravel().tolist(), p.shape[1], "clash") for k, p in planes.items()] + [(90, None, 16, ""), (91, [], 16, ""), (92, [1.0], 0, "")], "id long, image array<double>, w int, key string")
    rows = niqe.block_rows(df, "id", "image", "w", 16).repartition(5)
    got = {(r.id, r.block_row, r.block_column): r.features for r in rows.collect()}
    want = {(k, *at): f for k, p in planes.items() for at, f in whole_image(p, 16).items()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9, equal_nan=True) for k in want)
    model = niqe.pristine_model(rows.where("id < 3"))
    some = np.array([f for k, f in sorted(want.items()) if k[0] < 3])
    mean, cov = some.mean(0), np.cov(some, rowvar=False)
    found = {r.id: (r.blocks, r.niqe) for r in niqe.scores(rows, "id", model).collect()}
    for k in planes:
        own = np.array([f for at, f in sorted(want.items()) if at[0] == k])
        if len(own) < 2:
            assert k not in found or found[k][1] is None
        else:
            gap = mean - own.mean(0)
            value = math.sqrt(gap @ np.linalg.pinv((cov + np.cov(own, rowvar=False)) / 2) @ gap)
            assert found[k][0] == len(own) and abs(found[k][1] - value) < 1e-4 * max(1, value)


def test_border_and_planes(spark):
    x = sample(7, 40, 44)
    df = spark.createDataFrame([(1, x.ravel().tolist(), 44)], "id long, image array<double>, w int")
    got = {(r.block_row, r.block_column): r.features for r in niqe.block_rows(df, "id", "image", "w", 16, border=4).collect()}
    want = whole_image(x[4:-4, 4:-4], 16)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    colour = spark.createDataFrame([([255, 0, 0, 0, 255, 0, 10, 20, 30],)], "image array<int>")
    y, gray = colour.select(niqe.luma(colour.image), niqe.luma(colour.image, "gray")).first()
    assert np.allclose(y, [81.481, 144.553, 16 + (65.481 * 10 + 128.553 * 20 + 24.966 * 30) / 255])
    assert np.allclose(gray, [76.245, 149.685, 18.15])
    with pytest.raises(ValueError):
        niqe.block_rows(df, "id", "image", "w", 15)
