"""Numeric kernels over image arrays that no built-in expresses; each is a few lines of numpy, run on Arrow batches.

Images are row-major float arrays with their width beside them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _gauss(n: int, sigma: float) -> np.ndarray:
    g = np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * sigma**2))
    return g / g.sum()


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, (k, k))


def ssim_of(a: np.ndarray, b: np.ndarray, peak: float = 255.0) -> float:
    """Mean structural similarity over the valid region of an 11-tap Gaussian of deviation 1.5."""
    w = np.outer(_gauss(11, 1.5), _gauss(11, 1.5))
    blur = lambda x: (_windows(x, 11) * w).sum((2, 3))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    ma, mb = blur(a), blur(b)
    va, vb, vab = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def filtered(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """2-D correlation, edges reflected without repeating them."""
    k = kernel.shape[0]
    return np.einsum("abij,ij->ab", _windows(np.pad(x, k // 2, mode="reflect"), k), kernel)


def sharpened(x: np.ndarray, weight: float = 0.5, radius: int = 5, threshold: float = 10.0) -> np.ndarray:
    """Unsharp masking in [0, 1] where the residue exceeds the threshold (of 255), with a blurred mask."""
    g = np.outer(_gauss(radius | 1, radius / 3), _gauss(radius | 1, radius / 3))
    residue = x - filtered(x, g)
    soft = filtered((np.abs(residue) * 255 > threshold).astype(float), g)
    return soft * np.clip(x + weight * residue, 0, 1) + (1 - soft) * x


def local_variance(x: np.ndarray, k: int = 7) -> np.ndarray:
    return _windows(np.pad(x, k // 2, mode="reflect"), k).var((2, 3), ddof=1)


def artifact_map(gt: np.ndarray, output: np.ndarray, smooth: np.ndarray, k: int = 7) -> np.ndarray:
    """Patch weight times local variance of the residual; zero where the residual is below that of the smoothed output."""
    residual, other = np.abs(gt - output), np.abs(gt - smooth)
    out = residual.var(ddof=1) ** 0.2 * local_variance(residual, k)
    return np.where(residual < other, 0.0, out)


SHAPES = np.arange(0.2, 10.001, 0.001)


@functools.lru_cache(maxsize=1)
def shape_ratios() -> np.ndarray:
    """Squared mean over mean square of a generalised Gaussian for each shape; it grows with the shape."""
    log_gamma = lambda x: np.array([math.lgamma(v) for v in x])
    return np.exp(2 * log_gamma(2 / SHAPES) - log_gamma(1 / SHAPES) - log_gamma(3 / SHAPES))


def aggd(x: np.ndarray) -> tuple[float, float, float]:
    """Shape and both scales of an asymmetric generalised Gaussian: the shape of the grid whose ratio is nearest to that of the moments.

    Without values on one side the ratio is undefined; then the shape is the grid's first and that side's scale is NaN.
    """
    x = np.ravel(x)
    side = np.sign(x).astype(int) + 1
    count, square, total = (np.bincount(side, w, minlength=3) for w in (None, x * x, np.abs(x)))
    with np.errstate(divide="ignore", invalid="ignore"):
        left, _, right = np.sqrt(square / count)
        skew = left / right
        ratio = total.sum() ** 2 / (len(x) * square.sum()) * (skew**3 + 1) * (skew + 1) / (skew**2 + 1) ** 2
    known = shape_ratios()
    at = 0
    if not np.isnan(ratio):
        at = int(np.clip(np.searchsorted(known, ratio), 1, len(known) - 1))
        at -= ratio - known[at - 1] <= known[at] - ratio
    shape = float(SHAPES[at])
    scale = math.exp((math.lgamma(1 / shape) - math.lgamma(3 / shape)) / 2)
    return shape, float(left * scale), float(right * scale)


def normalised(x: np.ndarray) -> np.ndarray:
    """Pixels less the mean around them, over the deviation around them plus 1; edges are repeated."""
    taps = _gauss(7, 7 / 6)
    blur = lambda v: np.einsum("abij,i,j->ab", _windows(np.pad(v, 3, mode="edge"), 7), taps, taps, optimize=True)
    mean = blur(x)
    return (x - mean) / (np.sqrt(np.abs(blur(x * x) - mean * mean)) + 1)


def block_features(normal: np.ndarray) -> list[float]:
    """18 features of a block of normalised pixels: their fit, and that of products with four neighbours."""
    shape, left, right = aggd(normal)
    out = [shape, (left + right) / 2]
    for shift in ((0, 1), (1, 0), (1, 1), (1, -1)):
        shape, left, right = aggd(normal * np.roll(normal, shift, (0, 1)))
        out += [shape, (right - left) * math.exp(math.lgamma(2 / shape) - math.lgamma(1 / shape)), left, right]
    return out


def niqe_features(x: np.ndarray) -> list[float]:
    """The features of an image that is one block."""
    return block_features(normalised(x))


#: The luminance table of the JPEG standard, annex K, by rows.
LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]).reshape(8, 8)


def jpeg_grey(x: np.ndarray, quality: float) -> np.ndarray:
    """Grey image (0..255, sides multiples of 8) through 8 x 8 cosine transform, quantisation and back."""
    factor = (5000 / quality if quality < 50 else 200 - 2 * quality) / 100
    k = np.arange(8)
    d = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k + 1) * k[:, None] * math.pi / 16)
    h, w = x.shape
    blocks = (x - 128).reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
    table = LUMA * factor if factor else np.ones((8, 8))
    coded = np.rint(d @ blocks @ d.T / table) * table
    return np.clip((d.T @ coded @ d).transpose(0, 2, 1, 3).reshape(h, w) + 128, 0, 255)


def poisson_noise(x: np.ndarray, seed: int, scale: float = 1.0) -> np.ndarray:
    """Values in [0, 1] plus scaled Poisson noise at the image's own number of levels, clamped; seeded per row."""
    x = np.clip(np.rint(x * 255), 0, 255) / 255
    levels = 2 ** math.ceil(math.log2(max(2, len(np.unique(x)))))
    return np.clip(x + scale * (np.random.default_rng(seed).poisson(x * levels) / levels - x), 0, 1)


def bessel_j1(x: np.ndarray) -> np.ndarray:
    """By its integral over half a turn, midpoints."""
    t = (np.arange(400) + 0.5) * math.pi / 400
    return np.cos(t[:, None] - np.multiply.outer(np.sin(t), np.ravel(x))).mean(0).reshape(np.shape(x))


def sinc_kernel(cutoff: float, size: int) -> np.ndarray:
    """Circular low-pass filter, summing to 1."""
    axis = np.arange(size) - (size - 1) / 2
    r = np.hypot(axis[:, None], axis)
    inside = np.where(r == 0, 1.0, r)
    k = np.where(r == 0, cutoff**2 / (4 * math.pi), cutoff * bessel_j1(cutoff * inside) / (2 * math.pi * inside))
    return k / k.sum()


def warped(x: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Bilinear samples at (column + dx, row + dy); outside is 0."""
    h, w = x.shape
    col, row = np.arange(w) + dx, np.arange(h)[:, None] + dy
    c, r = np.floor(col).astype(int), np.floor(row).astype(int)
    padded = np.pad(x, 1)
    at = lambda i, j: padded[np.clip(i + 1, 0, h + 1), np.clip(j + 1, 0, w + 1)]
    fc, fr = col - c, row - r
    return at(r, c) * (1 - fc) * (1 - fr) + at(r, c + 1) * fc * (1 - fr) + at(r + 1, c) * (1 - fc) * fr + at(r + 1, c + 1) * fc * fr


def flow_bytes(flow: np.ndarray) -> bytes:
    """(h, w, 2) flow as tag, width, height and little-endian floats."""
    h, w, _ = flow.shape
    return b"PIEH" + np.array([w, h], "<i4").tobytes() + flow.astype("<f4").tobytes()


def flow_from(content: bytes) -> np.ndarray:
    if content[:4] != b"PIEH":
        raise ValueError("no flow file")
    w, h = np.frombuffer(content, "<i4", 2, 4)
    return np.frombuffer(content, "<f4", int(w) * int(h) * 2, 12).reshape(h, w, 2)


def measure(f: Callable[..., float], *images: Column | str, width: int):
    """A column of f over row-major images."""

    @F.pandas_udf(DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        shape = lambda v: np.asarray(v, np.float64).reshape(-1, width)
        return pd.Series([None if any(v is None for v in row) else f(*map(shape, row)) for row in zip(*columns, strict=True)], dtype="float64")

    return run(*images)


def changed(f: Callable[..., np.ndarray], image: Column | str, *scalars: Column | str, width: int):
    """A column of f(image, *scalars), row-major."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(*columns: pd.Series) -> pd.Series:
        out = [None if row[0] is None else np.ravel(f(np.asarray(row[0], np.float64).reshape(-1, width), *row[1:])) for row in zip(*columns, strict=True)]
        return pd.Series(out, dtype=object)

    return run(image, *scalars)


def dense(weights: DataFrame, size_out: int, size_in: int) -> np.ndarray:
    """The matrix of a weights table (o, i, w), whose size is a parameter and doesn't depend on the data."""
    out = np.zeros((size_out, size_in))
    for row in weights.collect():
        out[row.o, row.i] = row.w
    return out


def resized(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Both axes by their weights."""
    return rows @ x @ columns.T


def blur_weights(size: int, scale: int) -> np.ndarray:
    """Every scale-th value after a Gaussian of deviation 0.4 * scale, cut at four deviations; ends reflect without repeating."""
    sigma, turn = 0.4 * scale, max(2 * (size - 1), 1)
    reach = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    g = np.exp(-(reach**2) / (2 * sigma**2))
    out = np.zeros((-(-size // scale), size))
    for o, row in enumerate(out):
        at = (o * scale + reach) % turn
        np.add.at(row, np.minimum(at, turn - at) if size > 1 else at, g / g.sum())
    return out


def up_filter_down(x: np.ndarray, kernel: np.ndarray, up: int = 1, down: int = 1, pad: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Zeros between values, padding (negative: cropping) before and after, convolution, then every down-th value."""
    spread = np.zeros((x.shape[0] * up, x.shape[1] * up))
    spread[::up, ::up] = x
    spread = np.pad(spread, [(max(pad[0], 0), max(pad[1], 0))] * 2)
    low, high = max(-pad[0], 0), max(-pad[1], 0)
    spread = spread[low : spread.shape[0] - high, low : spread.shape[1] - high]
    found = np.einsum("abij,ij->ab", np.lib.stride_tricks.sliding_window_view(spread, kernel.shape), kernel[::-1, ::-1])
    return found[::down, ::down]


def ssim_channels(a: np.ndarray, b: np.ndarray, channels: int, border: int = 0) -> float:
    """Mean over planes that lie one below the other, without a border."""
    cut = slice(border, -border or None)
    planes = zip(np.split(a, channels), np.split(b, channels), strict=True)
    return float(np.mean([ssim_of(p[cut, cut], q[cut, cut]) for p, q in planes]))


def sampled(x: np.ndarray, column: np.ndarray, row: np.ndarray, border: str = "zeros") -> np.ndarray:
    """Bilinear samples at any places. Outside, `zeros` fades to 0 over a pixel, `border` repeats the edge."""
    h, w = x.shape
    if border == "border":
        column, row = np.clip(column, 0, w - 1), np.clip(row, 0, h - 1)
    c, r = np.floor(column).astype(int), np.floor(row).astype(int)
    fc, fr = column - c, row - r

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < h) & (j >= 0) & (j < w)
        return np.where(inside, x[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)], 0.0)

    return (at(r, c) * (1 - fc) + at(r, c + 1) * fc) * (1 - fr) + (at(r + 1, c) * (1 - fc) + at(r + 1, c + 1) * fc) * fr


def rotated(x: np.ndarray, angle: float, centre: tuple[float, float] | None = None, scale: float = 1.0, border: str = "zeros") -> np.ndarray:
    """Turned counter-clockwise by degrees about a centre (column, row; by default half the sides, rounded down) and scaled, same size.

    Each pixel is looked up where the inverse map says.
    """
    h, w = x.shape
    cx, cy = centre or (w // 2, h // 2)
    turn = math.radians(angle)
    dx, dy = (np.arange(w) - cx) / scale, (np.arange(h) - cy)[:, None] / scale
    # whole quarter turns have no rounding: cosines of them are exactly 0 or 1
    cos, sin = (float(round(v)) if abs(v - round(v)) < 1e-12 else v for v in (math.cos(turn), math.sin(turn)))
    return sampled(x, dx * cos - dy * sin + cx, dx * sin + dy * cos + cy, border)


def flow_resized(flow: np.ndarray, height: int, width: int, align: bool = False) -> np.ndarray:
    """A flow field (h, w, 2: across, down) brought to another size, bilinear without antialiasing; its vectors grow with the image."""
    h, w, _ = flow.shape

    def places(n_in: int, n_out: int) -> np.ndarray:
        o = np.arange(n_out)
        if align:
            return o * ((n_in - 1) / (n_out - 1) if n_out > 1 else 0.0)
        return np.maximum((o + 0.5) * (n_in / n_out) - 0.5, 0)

    column, row = np.broadcast_arrays(places(w, width), places(h, height)[:, None])
    return np.stack([sampled(flow[:, :, k], column, row, "border") * ratio for k, ratio in ((0, width / w), (1, height / h))], 2)
