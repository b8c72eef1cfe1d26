"""Kernels, resizing, noise and colour JPEG against plain loops; plans against their digests; carrying out against each step."""

import hashlib
import math

import numpy as np
import pytest

from quarrystone.functions import degrade
from quarrystone.functions.images import LUMA
from quarrystone.operators import degradation as d


def plain_kernel(kind, size, sx, sy, theta, beta):
    if not kind.endswith("aniso"):
        sy, theta = sx, 0.0
    turn = np.array([[math.cos(theta), -math.sin(theta)], [math.sin(theta), math.cos(theta)]])
    inverse = np.linalg.inv(turn @ np.diag([sx**2, sy**2]) @ turn.T)
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(size):
            p = np.array([j - size // 2, i - size // 2])
            q = p @ inverse @ p
            out[i, j] = 1 / (q**beta + 1) if kind.startswith("plateau") else math.exp(-0.5 * q ** (beta if kind.startswith("general") else 1))
    return out / out.sum()


@pytest.mark.parametrize("kind", d.KINDS)
def test_kernels(kind):
    args = (7, 1.3, 0.4, 0.7, 1.8)
    assert np.allclose(degrade.blur_kernel(kind, *args), plain_kernel(kind, *args))


def test_resizing():
    x = np.random.default_rng(1).random((5, 7))
    area = degrade.axis_weights(7, 3, "area") @ x.T
    assert np.allclose(area, [x[:, 0:3].mean(1), x[:, 2:5].mean(1), x[:, 4:7].mean(1)])
    for mode, n_out, scale in (("bilinear", 11, None), ("bilinear", 4, 0.6), ("bicubic", 11, None), ("bicubic", 4, 0.6)):
        got = degrade.axis_weights(7, n_out, mode, scale) @ x[0]
        for o in range(n_out):
            at = (o + 0.5) * (1 / scale if scale else 7 / n_out) - 0.5
            at = max(at, 0) if mode == "bilinear" else at
            base, t = math.floor(at), at - math.floor(at)
            px = lambda i: x[0][min(max(i, 0), 6)]
            if mode == "bilinear":
                want = px(base) * (1 - t) + px(base + 1) * t
            else:
                a = -0.75
                near = lambda v: (a + 2) * v**3 - (a + 3) * v**2 + 1
                far = lambda v: a * v**3 - 5 * a * v**2 + 8 * a * v - 4 * a
                want = px(base - 1) * far(1 + t) + px(base) * near(t) + px(base + 1) * near(1 - t) + px(base + 2) * far(2 - t)
            assert abs(got[o] - want) < 1e-9


def plain_jpeg(x, quality):
    h, w, _ = x.shape
    factor = (5000 / quality if quality < 50 else 200 - 2 * quality) / 100
    hh, ww = h + -h % 16, w + -w % 16
    planes = np.zeros((3, hh, ww))
    for i in range(hh):
        for j in range(ww):
            r, g, b = x[i, j] * 255 if i < h and j < w else (0, 0, 0)
            planes[:, i, j] = [0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128]
    out = []
    for c in range(3):
        p = planes[c] if c == 0 else np.array([[planes[c, 2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean() for j in range(ww // 2)] for i in range(hh // 2)])
        back = np.zeros_like(p)
        cos = [[math.cos((2 * k + 1) * u * math.pi / 16) for k in range(8)] for u in range(8)]
        alpha = lambda u: math.sqrt(0.5) if u == 0 else 1.0
        for by in range(0, p.shape[0], 8):
            for bx in range(0, p.shape[1], 8):
                block, coded = p[by : by + 8, bx : bx + 8] - 128, np.zeros((8, 8))
                for u in range(8):
                    for v in range(8):
                        table = (LUMA[v][u] if c == 0 else degrade.CHROMA[u][v]) * factor
                        value = 0.25 * alpha(u) * alpha(v) * sum(block[i][j] * cos[u][i] * cos[v][j] for i in range(8) for j in range(8))
                        coded[u][v] = round(value / table) * table
                for i in range(8):
                    for j in range(8):
                        back[by + i, bx + j] = 128 + 0.25 * sum(alpha(u) * alpha(v) * coded[u][v] * cos[u][i] * cos[v][j] for u in range(8) for v in range(8))
        out.append(back)
    result = np.zeros_like(x)
    for i in range(h):
        for j in range(w):
            y, cb, cr = out[0][i, j], out[1][i // 2, j // 2] - 128, out[2][i // 2, j // 2] - 128
            result[i, j] = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(result, 0, 255) / 255


@pytest.mark.parametrize(("shape", "quality"), [((16, 16), 75), ((9, 20), 30.5), ((17, 5), 92)])
def test_colour_jpeg(shape, quality):
    x = np.random.default_rng(2).random((*shape, 3))
    assert np.allclose(degrade.jpeg_colour(x, quality), plain_jpeg(x, quality), atol=1e-9)


def test_colour_jpeg_of_an_even_image_and_best_quality():
    flat = np.full((16, 16, 3), 128 / 255)
    assert np.allclose(degrade.jpeg_colour(flat, 90), flat, atol=0.01)
    x = np.random.default_rng(3).random((16, 16, 1)).repeat(3, 2)
    assert np.abs(degrade.jpeg_colour(x, 100) - x).max() < 0.02


def test_noise():
    x = np.random.default_rng(4).random((40, 40, 3)) * 0.5 + 0.25
    one = degrade.noisy(x, "gaussian", 10, False, degrade.generator(1, 2, "n"))
    assert np.array_equal(one, degrade.noisy(x, "gaussian", 10, False, degrade.generator(1, 2, "n")))
    assert not np.array_equal(one, degrade.noisy(x, "gaussian", 10, False, degrade.generator(2, 2, "n")))
    assert abs((one - x).std() - 10 / 255) < 0.002
    for kind in ("gaussian", "poisson"):
        out = degrade.noisy(x, kind, 1.0, True, degrade.generator(1, 2, "g"))
        free = ((out > 0) & (out < 1)).all(2)
        assert free.mean() > 0.5 and np.allclose((out - x)[free][:, 0], (out - x)[free][:, 2])
    flat = np.full((30, 30, 3), 0.4)
    shot = degrade.noisy(flat, "poisson", 1.0, False, degrade.generator(1, 2, "p"))
    plain = round(0.4 * 255) / 255  # one value: one level, so counts are whole numbers
    assert set(np.round((shot - flat + plain).ravel(), 9)) <= {0.0, 1.0, round(1 - 0.4 + plain, 9), round(plain - 0.4 + 1, 9), round(plain - 0.4, 9)}


def test_finishing_cdf_and_grid():
    x = np.array([[[-0.2, 0.5004, 1.3]]])
    assert degrade.finished(x).ravel().tolist() == [0, 0.5004, 1] and degrade.finished(x, False).ravel().tolist() == [-0.2, 0.5004, 1.3]
    assert np.allclose(degrade.finished(x, True, True).ravel() * 255, [0, 128, 255]) and np.allclose(degrade.finished(x, False, True).ravel() * 255, [-51, 128, 332])
    cdf = degrade.gaussian_cdf(5, np.array([[0.5, 0.2], [0.0, 2.0]]))
    phi = lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2)))
    for i in range(5):
        for j in range(5):
            a, b = np.array([j - 2, i - 2]) @ np.array([[0.5, 0.2], [0.0, 2.0]])
            assert abs(cdf[i, j] - phi(a) * phi(b)) < 1e-12
    images = np.arange(5 * 2 * 3.0).reshape(5, 2, 3, 1) + 1
    grid = degrade.image_grid(images)
    assert grid.shape == (3 * 4 + 2, 2 * 5 + 2, 1) and np.array_equal(grid[6:8, 7:10], images[3]) and not grid[10:, 7:].any() and not grid[:2].any()
    assert np.array_equal(degrade.image_grid(images[:1]), images[0]) and degrade.image_grid(images, 9, 0).shape == (2, 15, 1)


def number(key, step, seed=5):
    return int(hashlib.md5(f"{key}:{seed}:{step}".encode()).hexdigest()[:8], 16) / 2**32


def test_plans(spark):
    rows = spark.range(400).select("id", d.plan(d.F.col("id"), 5).alias("plan"))
    plans = {r.id: r.plan.asDict(True) for r in rows.repartition(7).collect()}
    assert plans == {r.id: r.plan.asDict(True) for r in rows.collect()}
    kinds, ways = set(), set()
    for k, p in plans.items():
        for n, (s, recipe) in enumerate(zip(p["stages"], d.Recipe().stages, strict=True), 1):
            u = lambda step: number(k, f"stage{n}.{step}")  # noqa: E731, B023
            kernel = s["kernel"]
            kinds.add(kernel["kind"])
            ways.add(s["resize"]["way"])
            assert kernel["size"] == range(7, 22, 2)[int(u("size") * 8)]
            assert (kernel["kind"] == "sinc") == (u("sinc") < 0.1)
            assert math.isclose(kernel["sigma_x"], recipe.sigma[0] + u("sigma_x") * (recipe.sigma[1] - recipe.sigma[0]))
            low = math.pi / (3 if kernel["size"] < 13 else 5)
            assert math.isclose(kernel["cutoff"], low + u("cutoff") * (math.pi - low))
            assert s["blur"] == (u("blur") < recipe.blur)
            assert {"up": 1 <= s["resize"]["scale"] <= recipe.resize[1], "down": recipe.resize[0] <= s["resize"]["scale"] <= 1, "keep": s["resize"]["scale"] == 1}[s["resize"]["way"]]
            lo, hi = recipe.noise if s["noise"]["kind"] == "gaussian" else recipe.poisson
            assert (s["noise"]["kind"] == "gaussian") == (u("noise") < 0.5) and lo <= s["noise"]["level"] <= hi
            assert 30 <= s["quality"] <= 95
        assert p["last"]["filter_first"] == (number(k, "last.order") < 0.5)
    assert kinds == {*d.KINDS, "sinc"} and ways == {"up", "down", "keep"}


def test_carrying_out(spark):
    rng = np.random.default_rng(6)
    shapes = [(16, 16), (20, 12), (9, 33), (5, 5), (16, 16)]
    rows = [(k, rng.integers(0, 256, h * w * 3).tolist(), h, w, "clash") for k, (h, w) in enumerate(shapes)] + [(90, None, 4, 4, ""), (91, [1, 2], 4, 4, ""), (92, [], 0, 0, ""), (93, [1, 2, 3], None, 1, "")]
    df = spark.createDataFrame(rows, "id long, image array<int>, h int, w int, status string")
    out = {r.id: r for r in d.degraded(df, "id", "image", "h", "w", 3, scale=2).collect()}
    again = {r.id: r for r in d.degraded(df.repartition(3), "id", "image", "h", "w", 3, scale=2).collect()}
    assert out == again and [out[k].status for k in (90, 91, 92, 93)] == ["bad_size"] * 4
    for k, (h, w) in enumerate(shapes):
        r = out[k]
        assert (r.status, r.lq_height, r.lq_width) == ("ok", h // 2, w // 2) and len(r.lq) == h // 2 * (w // 2) * 3
        assert all(0 <= v <= 255 for v in r.lq)
        # the same steps by hand
        x, p = np.array(rows[k][1]).reshape(h, w, 3) / 255, r.plan.asDict(True)
        x = degrade.per_channel(lambda q: degrade.sharpened(q, 0.5, 50), x)
        for n, s in enumerate(p["stages"], 1):
            if s["blur"]:
                x = degrade.blurred(x, degrade.blur_kernel(*(s["kernel"][f] for f in ("kind", "size", "sigma_x", "sigma_y", "theta", "beta", "cutoff"))))
            size = [max(1, int((a if n == 1 else b / 2) * s["resize"]["scale"])) for a, b in zip(x.shape[:2], (h, w), strict=True)]
            x = degrade.resized(x, *size, s["resize"]["mode"], s["resize"]["scale"] if n == 1 else None)
            x = degrade.noisy(x, s["noise"]["kind"], s["noise"]["level"], s["noise"]["grey"], degrade.generator(k, 3, f"noise{n}"))
            if n == 1:
                x = plain_jpeg(np.clip(x, 0, 1), s["quality"])
        steps = ["filter", "jpeg"] if p["last"]["filter_first"] else ["jpeg", "filter"]
        for step in steps:
            if step == "jpeg":
                x = plain_jpeg(np.clip(x, 0, 1), p["stages"][1]["quality"])
            else:
                x = degrade.resized(x, h // 2, w // 2, p["last"]["mode"])
                x = degrade.blurred(x, degrade.sinc_kernel(p["last"]["cutoff"], p["last"]["size"])) if p["last"]["sinc"] else x
        assert np.abs(np.clip(np.rint(x.ravel() * 255), 0, 255) - np.array(r.lq)).max() <= 1


def test_empty(spark):
    df = spark.createDataFrame([], "id long, image array<int>, h int, w int")
    assert d.degraded(df, "id", "image", "h", "w", 3).count() == 0
