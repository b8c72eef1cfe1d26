"""Numeric kernels of image degradation: blur kernels, resizing as networks do it, noise in colour or grey, colour JPEG.

Colour images are (height, width, 3) arrays of doubles in [0, 1], red first. Randomness comes from `generator`, which depends on a
key, a seed and the name of a step only.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

from quarrystone.functions.images import LUMA, filtered, sharpened, sinc_kernel

#: Weights of red, green and blue in grey, as image libraries have them.
GREY = np.array([0.2989, 0.587, 0.114])
#: RGB to YCbCr of JPEG files and back.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
FROM_YCC = np.array([[1.0, 0.0, 1.402], [1.0, -0.344136, -0.714136], [1.0, 1.772, 0.0]])
#: The chrominance table of the JPEG standard, annex K: these corner values, 99 elsewhere.
CHROMA_CORNER = np.array([[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]])
CHROMA = np.pad(CHROMA_CORNER, (0, 4), constant_values=99)


def generator(key: object, seed: int, step: str) -> np.random.Generator:
    """A counter-based generator: a task that is repeated draws the same numbers."""
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.md5(f"{key}:{seed}:{step}".encode()).digest(), "little")))


def blur_kernel(kind: str, size: int, sigma_x: float, sigma_y: float, theta: float, beta: float, cutoff: float | None = None) -> np.ndarray:
    """`iso`, `aniso`, `generalized_iso`, `generalized_aniso`, `plateau_iso`, `plateau_aniso` or `sinc`, summing to 1.

    Kinds that end in `iso` but not in `aniso` use sigma_x alone.
    """
    if kind == "sinc":
        return sinc_kernel(cutoff, size)
    if not kind.endswith("aniso"):
        sigma_y, theta = sigma_x, 0.0
    axis = np.arange(size) - size // 2
    u = axis * math.cos(theta) + axis[:, None] * math.sin(theta)
    v = axis[:, None] * math.cos(theta) - axis * math.sin(theta)
    far = (u / sigma_x) ** 2 + (v / sigma_y) ** 2
    power = 1.0 if kind in ("iso", "aniso") else beta
    out = 1 / (far**power + 1) if kind.startswith("plateau") else np.exp(-0.5 * far**power)
    return out / out.sum()


def axis_weights(n_in: int, n_out: int, mode: str, scale: float | None = None) -> np.ndarray:
    """(n_out, n_in) weights: `area` averages what an output covers; `bilinear` and `bicubic` (a = -0.75) interpolate between pixel centres
    without antialiasing, clamped at the ends. The step is 1 / scale if a scale is given, else n_in / n_out."""
    out, o = np.zeros((n_out, n_in)), np.arange(n_out)
    if mode == "area":
        lo, hi = o * n_in // n_out, -(-(o + 1) * n_in // n_out)
        at = np.arange(n_in)
        inside = (at >= lo[:, None]) & (at < hi[:, None])
        return inside / (hi - lo)[:, None]
    at = (o + 0.5) * (1 / scale if scale else n_in / n_out) - 0.5
    if mode == "bilinear":
        at = np.maximum(at, 0)
    base = np.floor(at).astype(int)
    for k in range(0, 2) if mode == "bilinear" else range(-1, 3):
        d = np.abs(at - (base + k))
        if mode == "bilinear":
            w = 1 - d
        else:
            a = -0.75
            w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a)
        np.add.at(out, (o, np.clip(base + k, 0, n_in - 1)), w)
    return out


def resized(x: np.ndarray, height: int, width: int, mode: str, scale: float | None = None) -> np.ndarray:
    rows, columns = axis_weights(x.shape[0], height, mode, scale), axis_weights(x.shape[1], width, mode, scale)
    return np.einsum("ah,hwc,bw->abc", rows, x, columns, optimize=True)


def per_channel(f, x: np.ndarray) -> np.ndarray:
    return np.stack([f(x[:, :, c]) for c in range(x.shape[2])], 2)


def blurred(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return per_channel(lambda p: filtered(p, kernel), x)


def _levels(x: np.ndarray) -> tuple[np.ndarray, int]:
    """x in 255ths, and the power of two that is not below its number of different values."""
    x = np.clip(np.rint(x * 255), 0, 255) / 255
    return x, 2 ** math.ceil(math.log2(max(len(np.unique(x)), 1)))


def finished(x: np.ndarray, clip: bool = True, rounds: bool = False) -> np.ndarray:
    """Clamped to [0, 1], rounded to 255ths (halves to even), both or neither."""
    if rounds:
        x = np.rint(x * 255) / 255
    return np.clip(x, 0, 1) if clip else x


def gaussian_cdf(size: int, matrix: np.ndarray) -> np.ndarray:
    """(size, size): the chance that two independent normal numbers are below the centred grid's points (across, down) times the matrix."""
    axis = np.arange(size) - size // 2
    points = np.stack(np.broadcast_arrays(axis, axis[:, None]), -1) @ matrix
    below = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))(points)
    return below[..., 0] * below[..., 1]


def image_grid(images: np.ndarray, across: int | None = None, padding: int = 2, fill: float = 0.0) -> np.ndarray:
    """(n, h, w, c) images side by side, `across` in a row (the root of n, rounded down, by default), with a frame of padding around each."""
    n, h, w, c = images.shape
    if n == 1:
        return images[0]
    across = min(across or int(math.sqrt(n)), n)
    down = -(-n // across)
    out = np.full((down * (h + padding) + padding, across * (w + padding) + padding, c), fill)
    for k, image in enumerate(images):
        top, left = k // across * (h + padding) + padding, k % across * (w + padding) + padding
        out[top : top + h, left : left + w] = image
    return out


def noisy(x: np.ndarray, kind: str, level: float, grey: bool, rng: np.random.Generator, clip: bool = True, rounds: bool = False) -> np.ndarray:
    """`gaussian` (level: deviation in 255ths) or `poisson` noise (level: a factor), the same in all channels if grey; then `finished`."""
    if kind == "gaussian":
        noise = rng.standard_normal((*x.shape[:2], 1 if grey else x.shape[2])) * level / 255
    else:
        plain, n = _levels((x @ GREY)[:, :, None] if grey else x)
        noise = (rng.poisson(plain * n) / n - plain) * level
    return finished(x + noise, clip, rounds)


def _coded(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A plane (0..255, sides multiples of 8) through 8 x 8 cosine transform, quantisation and back."""
    k = np.arange(8)
    d = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k + 1) * k[:, None] * math.pi / 16)
    h, w = plane.shape
    blocks = (plane - 128).reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
    kept = np.rint(d @ blocks @ d.T / table) * table
    return (d.T @ kept @ d).transpose(0, 2, 1, 3).reshape(h, w) + 128


def jpeg_colour(x: np.ndarray, quality: float) -> np.ndarray:
    """A colour image through JPEG's lossy steps: zeros up to multiples of 16, luminance and halved chrominance, 8 x 8 blocks, back, cut.

    The luminance table is applied with rows and columns exchanged, as the networks' JPEG layer has it. A quality of 100 divides by 1.
    """
    h, w, _ = x.shape
    factor = (5000 / quality if quality < 50 else 200 - 2 * quality) / 100
    luma, chroma = (LUMA.T * factor, CHROMA * factor) if factor else (np.ones((8, 8)),) * 2
    full = np.pad(x, ((0, -h % 16), (0, -w % 16), (0, 0))) * 255
    ycc = full @ TO_YCC.T + [0, 128, 128]
    halved = ycc.reshape(ycc.shape[0] // 2, 2, ycc.shape[1] // 2, 2, 3).mean((1, 3))
    double = lambda p: p.repeat(2, 0).repeat(2, 1)
    back = np.stack([_coded(ycc[:, :, 0], luma), double(_coded(halved[:, :, 1], chroma)), double(_coded(halved[:, :, 2], chroma))], 2)
    return np.clip((back - [0, 128, 128]) @ FROM_YCC.T, 0, 255)[:h, :w] / 255


def executed(x: np.ndarray, plan: dict, key: object, seed: int, scale: int, sharpen: bool = True) -> np.ndarray:
    """The degraded image, 1 / scale as large, in 255ths: blur, resize, noise and JPEG as the plan's two stages say, then the
    last resize with its filter, before or after the last JPEG."""
    h, w, _ = x.shape
    out = per_channel(lambda p: sharpened(p, 0.5, 50), x) if sharpen else x
    for number, stage in enumerate(plan["stages"], 1):
        if stage["blur"]:
            out = blurred(out, blur_kernel(*(stage["kernel"][k] for k in ("kind", "size", "sigma_x", "sigma_y", "theta", "beta", "cutoff"))))
        s = stage["resize"]["scale"]
        if number == 1:
            out = resized(out, max(1, int(out.shape[0] * s)), max(1, int(out.shape[1] * s)), stage["resize"]["mode"], s)
        else:
            out = resized(out, max(1, int(h / scale * s)), max(1, int(w / scale * s)), stage["resize"]["mode"])
        out = noisy(out, stage["noise"]["kind"], stage["noise"]["level"], stage["noise"]["grey"], generator(key, seed, f"noise{number}"))
        if number == 1:
            out = jpeg_colour(np.clip(out, 0, 1), stage["quality"])
    last = plan["last"]
    quality = plan["stages"][-1]["quality"]

    def settled(v: np.ndarray) -> np.ndarray:
        v = resized(v, max(1, h // scale), max(1, w // scale), last["mode"])
        return blurred(v, sinc_kernel(last["cutoff"], last["size"])) if last["sinc"] else v

    if last["filter_first"]:
        out = jpeg_colour(np.clip(settled(out), 0, 1), quality)
    else:
        out = settled(jpeg_colour(np.clip(out, 0, 1), quality))
    return np.clip(np.rint(out * 255), 0, 255) / 255
