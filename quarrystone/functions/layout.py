"""Layout of row-major images held in arrays, as Column expressions: blocks, channels, multiples, the eight orientations, tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions import arrays, scalars


def let(value: Column, body) -> Column:
    """body of the value, which is computed once: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gather(values: Column, at, times: int = 1) -> Column:
    """The array of `times` as many values, of which the i-th is the one at position at(i, number of values)."""
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) * times - 1), lambda i: F.get(v, at(i, F.size(v)).cast("int"))))


def merge_blocks(values: Column, width: int, side: int) -> Column:
    """Inverse of `blocks` on their flattened values."""
    across = width // side
    at = lambda i, _: (F.floor(i / (width * side)) * across + F.floor(i % width / side)) * side * side + F.floor(i / width) % side * side + i % side
    return gather(values, at)


def pixel_unshuffle(values: Column, width: int, factor: int) -> Column:
    """One channel to factor^2 smaller ones, one after the other."""
    narrow = width // factor

    def at(i: Column, n: Column) -> Column:
        plane = F.floor(n / (factor * factor))
        channel, p = F.floor(i / plane), i % plane
        return (F.floor(p / narrow) * factor + F.floor(channel / factor)) * width + p % narrow * factor + channel % factor

    return gather(values, at)


def crop_multiple(values: Column, width: int, height: int, scale: int) -> Column:
    """The upper left part whose sides are multiples of scale."""
    return arrays.crop(values, width, 0, 0, height - height % scale, width - width % scale)


def channels_first(values: Column, channels: int) -> Column:
    """Pixel by pixel to plane by plane; the inverse is the same with the pixels' number in place of channels."""
    return gather(values, lambda i, n: i % F.floor(n / channels) * channels + F.floor(i / F.floor(n / channels)))


def reorder_channels(values: Column, order: list[int]) -> Column:
    """Channels of each pixel in another order, as of blue, green, red to red, green, blue."""
    wanted = F.array(*map(F.lit, order))
    return gather(values, lambda i, _: i - i % len(order) + F.get(wanted, (i % len(order)).cast("int")))


def rgb(y: Column, cb: Column, cr: Column) -> Column:
    """struct(red, green, blue) in [0, 1] of studio values: the inverse of `ycbcr`."""
    rows = np.array([arrays.YCBCR[k] for k in ("y", "cb", "cr")])
    back = np.linalg.inv(rows[:, 1:])
    parts = [c - float(o) for c, o in zip((y, cb, cr), rows[:, 0], strict=True)]
    return F.struct(*[sum((p * float(w) for p, w in zip(parts[1:], row[1:], strict=True)), parts[0] * float(row[0])).alias(k) for k, row in zip(("red", "green", "blue"), back, strict=True)])


def _turned(image: Column, width: int, k: int, back: bool) -> Column:
    """A square image mirrored if k has bit 1, turned upside down for bit 2, transposed for 4, in this order; or that undone."""
    row, column = (lambda i: F.floor(i / width)), (lambda i: i % width)
    steps = [(1, lambda i: row(i) * width + (width - 1) - column(i)), (2, lambda i: (width - 1 - row(i)) * width + column(i)), (4, lambda i: column(i) * width + row(i))]

    def at(i: Column, _: Column) -> Column:
        for bit, step in steps if back else reversed(steps):
            i = step(i) if k & bit else i
        return i

    return gather(image, at)


def orientations(image: Column, width: int) -> Column:
    """The eight orientations of a square image."""
    return F.array(*[_turned(image, width, k, False) for k in range(8)])


def ensemble(results: Column, width: int) -> Column:
    """Mean of the results for the eight orientations, each turned back."""
    turned = lambda r: F.array(*[_turned(F.get(r, F.lit(k)), width, k, True) for k in range(8)])
    mean = lambda b, i: sum((F.get(F.get(b, F.lit(k)), i) for k in range(1, 8)), F.get(F.get(b, F.lit(0)), i)) / 8.0
    return let(results, lambda r: let(turned(r), lambda b: F.transform(F.get(b, F.lit(0)), lambda _, i: mean(b, i))))


def with_statistics_of(content: Column, style: Column, eps: float = 1e-5) -> Column:
    """Content with the mean and deviation (unbiased, eps added to the variance) of style."""

    def moments(v: Column) -> Column:
        spread = lambda m: F.sqrt(arrays.exact_sum(v, lambda x: (x - m) * (x - m)) / (F.size(v) - 1) + eps)
        return let(arrays.exact_sum(v) / F.size(v), lambda m: F.struct(m.alias("m"), spread(m).alias("s")))

    both = F.struct(moments(content).alias("a"), moments(style).alias("b"))
    return let(both, lambda t: F.transform(content, lambda x: (x - t["a"]["m"]) / t["a"]["s"] * t["b"]["s"] + t["b"]["m"]))


def flow_levels(dx: Column, dy: Column, width: int, height: int, most: float = 0.02, norm: bool = True) -> Column:
    """struct(dx, dy) of flow components as levels 0..254."""
    level = lambda d, n: F.transform(d, lambda x: scalars.quantize(x / n if norm else x, -most, most, 255))
    return F.struct(level(dx, width).alias("dx"), level(dy, height).alias("dy"))


def flow_of(levels: Column, width: int, height: int, most: float = 0.02, denorm: bool = True) -> Column:
    back = lambda d, n: F.transform(d, lambda q: scalars.dequantize(q, -most, most, 255) * (n if denorm else 1))
    return F.struct(back(levels["dx"], width).alias("dx"), back(levels["dy"], height).alias("dy"))


def side_by_side(left: Column, right: Column, width: int) -> Column:
    """Two images of one height and width as one of twice the width."""
    at = lambda i, n: F.floor(i / (2 * width)) * width + i % width + F.when(i % (2 * width) >= width, F.floor(n / 2)).otherwise(0)
    return gather(F.concat(left, right), at)


def tile_boxes(side: int = 2048, tile: int = 512) -> list[tuple[int, int, int, int, int]]:
    """(id, left, top, right, bottom) of the square of `tile` pixels in the middle of each quarter of a square picture; ids from 1."""
    margin = (side // 2 - tile) // 2
    corners = [(x, y) for y in (margin, side // 2 + margin) for x in (margin, side // 2 + margin)]
    return [(k, x, y, x + tile, y + tile) for k, (x, y) in enumerate(corners, 1)]


def tiles_of(width: Column, height: Column, side: int = 2048, tile: int = 512) -> Column:
    """Array of struct(tile, left, top, right, bottom); empty unless the picture is a square of that side."""
    box = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("tile", "left", "top", "right", "bottom"), b, strict=True)]) for b in tile_boxes(side, tile)]
    return F.when((width == side) & (height == side), F.array(*box)).otherwise(F.slice(F.array(*box), 1, 0))


def _reflected(i: Column, n: int) -> Column:
    """Position i of a line of n that goes on by its mirror image, ends not repeated."""
    turn = max(2 * (n - 1), 1)
    return F.least(i % turn, turn - i % turn) if n > 1 else F.lit(0)


def extended(values: Column, width: int, height: int, wide: int, high: int) -> Column:
    """The image with columns and rows added at the right and below, reflected as often as it takes."""
    at = lambda i: _reflected(F.floor(i / wide), height) * width + _reflected(i % wide, width)
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(wide * high - 1)), lambda i: F.get(v, at(i).cast("int"))))


def pad_multiple(values: Column, width: int, height: int, side: int) -> Column:
    """Reflected up to the next multiples of side; `arrays.crop` with the sizes times the scale takes the padding off a result."""
    return extended(values, width, height, -(-width // side) * side, -(-height // side) * side)


def fit_square(values: Column, width: int, height: int, side: int, top: int = 0, left: int = 0) -> Column:
    """A side x side image: smaller sides are reflected, larger ones are cut at (top, left)."""
    wide, high = max(width, side), max(height, side)
    grown = extended(values, width, height, wide, high) if (wide, high) != (width, height) else values
    return let(grown, lambda v: arrays.crop(v, wide, top, left, side, side)) if (wide, high) != (side, side) else grown
