"""Names with alternatives, PNG files, statuses of broken ones, turned images and resized flow."""

import itertools
import math
import zlib

import numpy as np
import pytest

from quarrystone.functions import images, png
from quarrystone.operators import lookup, resizing


def test_names(spark):
    first = spark.createDataFrame([("My Model", "a"), ("other", "b"), ("other", "a2"), ("gone", None)], "key string, spec string")
    second = spark.createDataFrame([("my model", "c"), ("third_one", "d"), ("gone", "e"), ("Mixed", "m1"), ("mixed", "m2"), (None, "n")], "key string, spec string")
    asked = ["My Model", "my model", "MY MODEL", "Other", "Third One", "gone", "Mixed", "MIXED", "nobody", None, "My Model", ""]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(asked)], "id int, name string")
    out = {r.id: (r.spec, r.registry, r.variant, r.matched) for r in lookup.resolved(rows, "name", [first, second], "key", "spec").collect()}
    none = (None,) * 4
    assert out == {
        0: ("a", 0, 0, "My Model"),
        1: ("c", 1, 0, "my model"),
        2: ("c", 1, 1, "my model"),
        3: ("a2", 0, 1, "other"),
        4: ("d", 1, 3, "third_one"),
        5: ("e", 1, 0, "gone"),
        6: ("m1", 1, 0, "Mixed"),
        7: ("m2", 1, 1, "mixed"),
        8: none,
        9: none,
        10: ("a", 0, 0, "My Model"),
        11: none,
    }
    # an earlier registry wins even by a later spelling
    low = spark.createDataFrame([("mixed", "low")], "key string, spec string")
    assert lookup.resolved(rows.where("id = 6"), "name", [low, second], "key", "spec").first().spec == "low"


def filtered(pixels, kind):
    """A PNG whose lines use one filter, made by the definition."""
    h, w, n = pixels.shape
    flat = pixels.reshape(h, -1).astype(int)
    body = b""
    for k in range(h):
        line = bytearray([kind])
        for i in range(w * n):
            a, b = (flat[k, i - n] if i >= n else 0), (flat[k - 1, i] if k else 0)
            c = flat[k - 1, i - n] if k and i >= n else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((flat[k, i] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        body += bytes(line)
    whole = png.encoded(pixels)
    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    at = whole.index(b"IDAT") - 4
    return whole[:at] + chunk(b"IDAT", zlib.compress(body)[:7]) + chunk(b"IDAT", zlib.compress(body)[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("kind", "channels"), itertools.product(range(5), (1, 3, 4)))
def test_png_filters(kind, channels):
    pixels = np.random.default_rng(kind).integers(0, 256, (6, 7, channels)).astype(np.uint8)
    got, header = png.decoded(filtered(pixels, kind))
    assert np.array_equal(got, pixels[:, :, :3] if channels > 1 else pixels.repeat(3, 2)) and (header.width, header.height) == (7, 6)


def test_png_palettes_and_transparency():
    numbers, colours = np.array([[0, 1], [2, 0]]), np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    got, header = png.decoded(png.encoded(numbers, colours))
    assert np.array_equal(got, colours[numbers]) and not header.byte_transparency()
    one = lambda t: png.parts(png.encoded(numbers, colours, t))[0].byte_transparency()
    assert [one(t) for t in (b"\xff\x00", b"\x00", b"\x00\x00", b"\x80", b"\xff", b"\xff\x00\xff")] == [False, False, True, True, True, False]
    assert not png.parts(png.encoded(np.zeros((1, 1, 3)), None, b"\0\0\0\0\0\0"))[0].byte_transparency()


def test_sizes_and_weights():
    assert [png.new_size(*a) for a in ((100, 50, 200), (400, 200, 100), (3, 1000, 10), (1000, 25, 100), (1000, 35, 100))] == [(100, 50), (100, 50), (1, 10), (100, 2), (100, 4)]
    for a, b in ((9, 4), (4, 9), (5, 5), (3, 1), (1, 4)):
        w = png.lanczos_weights(a, b)
        assert np.allclose(w.sum(1), 1)
        for o in range(b):
            step = a / b
            wide = max(1, step)
            f = lambda x: 0.0 if abs(x) >= 3 else 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)
            raw = [f((i + 0.5 - (o + 0.5) * step) / wide) for i in range(a)]
            assert np.allclose(w[o], np.array(raw) / sum(raw), atol=1e-6)


def test_broken_files_leave_their_neighbours(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (20, 40, 3)).astype(np.uint8)
    good = png.encoded(image)
    flipped = bytearray(good)
    flipped[60] ^= 1
    numbers, colours = np.zeros((4, 4), int), np.array([[9, 9, 9]])
    files = {
        "good": (good, "ok"),
        "small": (png.encoded(image[:4, :6]), "ok"),
        "cut": (good[:-20], "file is truncated"),
        "flipped": (bytes(flipped), "wrong checksum of IDAT"),
        "text": (b"hello", "no PNG file"),
        "empty": (b"", "no PNG file"),
        "none": (None, "no content"),
        "large": (png.encoded(np.zeros((100, 100))), "too many pixels"),
        "palette": (png.encoded(numbers, colours), "ok"),
        "glass": (png.encoded(numbers, colours, b"\x80"), resizing.PALETTE),
        "outside": (png.encoded(numbers + 5, colours), "a colour is not in the palette"),
    }
    df = spark.createDataFrame([(k, v[0], "clash") for k, v in files.items()], "path string, content binary, status string").repartition(1)
    out = {r.path: r for r in resizing.resize_files(df, 10, most_pixels=5000).collect()}
    assert {k: r.status for k, r in out.items()} == {k: v[1] for k, v in files.items()}
    assert (out["good"].width, out["good"].height) == (10, 5) and (out["small"].width, out["small"].height) == (6, 4)
    assert np.array_equal(png.decoded(bytes(out["small"].image))[0], image[:4, :6])
    across = np.clip(np.floor(np.einsum("hwc,ow->hoc", image.astype(float), png.lanczos_weights(40, 10)) + 0.5), 0, 255)
    down = np.clip(np.floor(np.einsum("hwc,oh->owc", across, png.lanczos_weights(20, 5)) + 0.5), 0, 255)
    assert np.array_equal(png.decoded(bytes(out["good"].image))[0], down)
    assert tuple(resizing.outcome_counts(resizing.resize_files(df, 10, most_pixels=5000)).first()) == (3, 7, 1)
    failed = {r.path: r.failed for r in resizing.probe(df).collect()}
    assert {k for k, f in failed.items() if f} == {"cut", "flipped", "text", "empty", "none", "outside"} and all(f in ("", k) for k, f in failed.items())
    assert resizing.probe(df, load=lambda data: data[100]).where("failed <> ''").count() == sum(v[0] is None or len(v[0]) <= 100 for v in files.values())
    assert tuple(resizing.outcome_counts(resizing.resize_files(df.limit(0), 10)).first()) == (0, 0, 0)


def test_quarter_turns_are_exact():
    x = np.random.default_rng(4).random((7, 7))
    assert np.array_equal(images.rotated(x, 90), np.rot90(x)) and np.array_equal(images.rotated(x, -90), np.rot90(x, -1))
    assert np.array_equal(images.rotated(x, 180), x[::-1, ::-1]) and np.array_equal(images.rotated(x, 90), x.T[::-1])
    assert np.array_equal(images.rotated(x, 0), x)


def test_turns_by_loops():
    x = np.random.default_rng(5).random((6, 9))
    for angle, centre, scale, border in ((30, None, 1.0, "zeros"), (-77, (2, 3), 1.4, "zeros"), (200, (0, 0), 0.6, "border")):
        got, (cx, cy), t = images.rotated(x, angle, centre, scale, border), centre or (4, 3), math.radians(angle)
        for i in range(6):
            for j in range(9):
                u, v = (j - cx) / scale, (i - cy) / scale
                sx, sy = u * math.cos(t) - v * math.sin(t) + cx, u * math.sin(t) + v * math.cos(t) + cy
                if border == "border":
                    sx, sy = min(max(sx, 0), 8), min(max(sy, 0), 5)
                want = 0.0
                for a, b in itertools.product((0, 1), repeat=2):
                    r, c = math.floor(sy) + a, math.floor(sx) + b
                    if 0 <= r < 6 and 0 <= c < 9:
                        want += x[r, c] * (1 - abs(sy - r)) * (1 - abs(sx - c))
                assert abs(got[i, j] - want) < 1e-9


def test_flow_sizes():
    flow = np.stack([np.full((4, 6), 2.0), np.tile(np.arange(4.0)[:, None], (1, 6))], 2)
    up = images.flow_resized(flow, 8, 18)
    assert np.allclose(up[:, :, 0], 6) and np.allclose(up[2:-1, 0, 1], 2 * (np.arange(2, 7) / 2 - 0.25))
    assert np.allclose(images.flow_resized(flow, 4, 6), flow)
    aligned = images.flow_resized(flow, 7, 6, align=True)
    assert np.allclose(aligned[:, 0, 1], np.arange(7) / 2 * 7 / 4)
