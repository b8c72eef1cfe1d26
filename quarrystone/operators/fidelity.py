"""Full-reference scores with the options that evaluations use: a border that doesn't count, and luminance only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions import arrays, images, layout
from quarrystone.operators.samples import tensor

#: 255ths of red, green and blue in luminance of video range, which begins at 16.
LUMA = (65.481, 128.553, 24.966)


def planes(image: Column, height: Column, width: Column, channels: int = 3, border: int = 0, luma: bool = False) -> Column:
    """What counts of a row-major 0..255 image with its channels last (red first), by planes; of its luminance (video range, not rounded) if `luma`."""
    inner = (height - 2 * border, width - 2 * border)
    cut = F.when((inner[0] > 0) & (inner[1] > 0), tensor(image, width, inner, channels, border, border))
    if not luma or channels == 1:
        return cut
    weights = [w / 255 for w in LUMA]
    n = (inner[0] * inner[1]).cast("int")
    return layout.let(cut, lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((F.get(p, i + n * c) * w for c, w in enumerate(weights)), F.lit(16.0))))


def psnr(a: Column, b: Column, height: Column, width: Column, channels: int = 3, border: int = 0, luma: bool = False) -> Column:
    side = lambda x: planes(x, height, width, channels, border, luma)
    return arrays.psnr(arrays.mse(side(a), side(b)))


def ssim(a: Column | str, b: Column | str, height: int, width: int, channels: int = 3, border: int = 0, luma: bool = False) -> Column:
    """Mean over the planes; images of one size. Less than 11 pixels a side inside the border gives null."""
    if min(height, width) - 2 * border < 11:
        return F.lit(None).cast("double")

    def score(x: np.ndarray, y: np.ndarray) -> float:
        cut = [v.reshape(height, width, channels)[border : height - border, border : width - border] for v in (x, y)]
        if luma and channels == 3:
            cut = [(v @ (np.array(LUMA) / 255) + 16)[:, :, None] for v in cut]
        return float(np.mean([images.ssim_of(cut[0][:, :, c], cut[1][:, :, c]) for c in range(cut[0].shape[2])]))

    return images.measure(score, a, b, width=width * channels)
