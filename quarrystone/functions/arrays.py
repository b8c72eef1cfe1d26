"""Array functions as Column expressions: errors, losses, colour, layout, resampling weights.

Vectors are array columns; sums are decimal where `exact`, so that results don't depend on the engine's order of adding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

TERM, SUM = "decimal(28,12)", "decimal(38,12)"
#: Products of weights and values that a task makes at once.
PRODUCTS = 1 << 17


def exact_sum(values: Column, term=lambda x: x) -> Column:
    """Sum of term(x) over an array of doubles, by decimals."""
    return F.aggregate(values, F.lit(0).cast(SUM), lambda acc, x: (acc + term(x.cast("double")).cast(TERM)).cast(SUM)).cast("double")


def pair_sum(a: Column, b: Column, term) -> Column:
    """Sum of term(x, y) over two arrays of equal length."""
    return exact_sum(F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double"))))


def mse(a: Column, b: Column) -> Column:
    return F.try_divide(pair_sum(a, b, lambda x, y: (x - y) * (x - y)), F.size(a))


def mae(a: Column, b: Column) -> Column:
    return F.try_divide(pair_sum(a, b, lambda x, y: F.abs(x - y)), F.size(a))


def charbonnier(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return F.try_divide(pair_sum(a, b, lambda x, y: F.sqrt((x - y) * (x - y) + eps)), F.size(a))


def psnr(error: Column, peak: float = 255.0) -> Column:
    """From a mean squared error; infinite where that is 0."""
    return F.when(error == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(F.lit(peak * peak) / F.when(error == 0, F.lit(1.0)).otherwise(error)))


def psnr_unit(error: Column) -> Column:
    """For values in [0, 1]; at most 80 dB."""
    return 10.0 * F.log10(1.0 / (error + 1e-8))


def weighted(loss: Column, weight: Column, reduction: str = "mean", channels: int = 1) -> Column:
    """Elementwise losses times weights: none, sum, or mean over the weights (times channels where they are shared by them)."""
    products = F.zip_with(loss, weight, lambda x, w: x * w)
    if reduction == "none":
        return products
    total = exact_sum(products)
    return total if reduction == "sum" else F.try_divide(total, exact_sum(weight) * channels)


def total_variation(image: Column, width: int) -> Column:
    """Mean absolute difference to the next row plus that to the next column, of a row-major image."""
    n = F.size(image)
    down = pair_sum(F.slice(image, 1, n - width), F.slice(image, F.lit(width + 1), n - width), lambda x, y: F.abs(x - y))
    inner = lambda shift: F.filter(image, lambda x, i: (i % width < width - 1) if shift == 0 else (i % width > 0))
    across = pair_sum(inner(0), inner(1), lambda x, y: F.abs(x - y))
    return F.try_divide(down, n - width) + F.try_divide(across, n - F.floor(n / width))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gan_loss(score: Column, kind: str, real: bool, discriminator: bool = True) -> Column:
    sign = -1.0 if real else 1.0
    if kind == "vanilla":
        return softplus(score * sign)
    if kind == "lsgan":
        return (score - (1.0 if real else 0.0)) * (score - (1.0 if real else 0.0))
    if kind == "wgan":
        return score * sign
    if kind == "wgan_softplus":
        return softplus(score * sign)
    if kind == "hinge":
        return F.greatest(F.lit(0.0), 1.0 + score * sign) if discriminator else -score
    raise ValueError(f"unknown loss {kind}")


def multi_scale_gan_loss(scales: Column, kind: str, real: bool, discriminator: bool = True) -> Column:
    """Mean over scales of the mean loss of each one's last layer; scales are arrays of layers, which are arrays of scores."""
    last = lambda layers: F.element_at(layers, -1)
    means = F.transform(scales, lambda layers: F.try_divide(exact_sum(F.transform(last(layers), lambda x: gan_loss(x.cast("double"), kind, real, discriminator))), F.size(last(layers))))
    return F.try_divide(exact_sum(means), F.size(scales))


def gram(features: Column, channels: int) -> Column:
    """channels x channels products of feature rows, divided by the number of values."""
    n = F.size(features)
    row = lambda c: F.slice(features, (c * F.floor(n / channels)).cast("int") + 1, F.floor(n / channels).cast("int"))
    index = F.sequence(F.lit(0), F.lit(channels - 1))
    return F.flatten(F.transform(index, lambda i: F.transform(index, lambda j: pair_sum(row(i), row(j), lambda x, y: x * y) / n)))


def standardise(values: Column, mean: list[float], std: list[float]) -> Column:
    """Channel k = position mod channels."""
    m, s, c = F.array(*map(F.lit, mean)), F.array(*map(F.lit, std)), len(mean)
    return F.transform(values, lambda x, i: (x - F.element_at(m, i % c + 1)) / F.element_at(s, i % c + 1))


#: Fixed values of ITU-R BT.601 in studio range: offsets, and rows of weights for red, green, blue (of 255).
YCBCR = {"y": (16.0, 65.481, 128.553, 24.966), "cb": (128.0, -37.797, -74.203, 112.0), "cr": (128.0, 112.0, -93.786, -18.214)}


def ycbcr(red: Column, green: Column, blue: Column) -> Column:
    """struct(y, cb, cr) of values in [0, 1], in 0..255 without rounding."""
    return F.struct(*[(red * r + green * g + blue * b + o).alias(k) for k, (o, r, g, b) in YCBCR.items()])


def flip_rows(image: Column, width: int) -> Column:
    """Mirror left to right."""
    return F.transform(image, lambda _, i: F.element_at(image, (i - i % width + (width - 1) - i % width + 1).cast("int")))


def flip_columns(image: Column, width: int) -> Column:
    """Mirror top to bottom."""
    return F.transform(image, lambda _, i: F.element_at(image, (F.size(image) - width - (i - i % width) + i % width + 1).cast("int")))


def transpose(image: Column, width: int) -> Column:
    """Row-major transpose of a height x width image."""
    return F.transform(image, lambda _, i: F.element_at(image, (i % F.floor(F.size(image) / width) * width + F.floor(i / F.floor(F.size(image) / width)) + 1).cast("int")))


def crop(image: Column, width: int, top: int, left: int, height: int, wide: int) -> Column:
    rows = F.sequence(F.lit(top), F.lit(top + height - 1))
    return F.flatten(F.transform(rows, lambda r: F.slice(image, (r * width + left + 1).cast("int"), wide)))


def blocks(image: Column, width: int, side: int) -> Column:
    """Row-major side x side blocks of an image whose sides they divide, as an array of arrays."""
    height = F.floor(F.size(image) / width)
    index = F.sequence(F.lit(0), (F.floor(height / side) * (width // side) - 1).cast("int"))
    inner = F.sequence(F.lit(0), F.lit(side * side - 1))
    at = lambda b, i: (F.floor(b / (width // side)) * side + F.floor(i / side)) * width + b % (width // side) * side + i % side
    return F.transform(index, lambda b: F.transform(inner, lambda i: F.element_at(image, at(b, i).cast("int") + 1)))


def kernel(name: str, x: Column) -> Column:
    """Interpolation kernels: cubic, lanczos2, lanczos3, linear, box; an unknown name is cubic."""
    a = F.abs(x)
    if name == "linear":
        return F.greatest(F.lit(0.0), 1.0 - a)
    if name == "box":
        return F.when((x >= -1) & (x <= 1), 1.0).otherwise(0.0)
    if name in ("lanczos2", "lanczos3"):
        n = float(name[-1])
        sinc = lambda t: F.when(t == 0, 1.0).otherwise(F.try_divide(F.sin(math.pi * t), math.pi * t))
        return F.when(a < n, sinc(x) * sinc(x / n)).otherwise(0.0)
    near = 1.5 * a * a * a - 2.5 * a * a + 1.0
    far = -0.5 * a * a * a + 2.5 * a * a - 4.0 * a + 2.0
    return F.when(a <= 1, near).when(a <= 2, far).otherwise(0.0)


SUPPORT = {"cubic": 4, "lanczos2": 4, "lanczos3": 6, "linear": 2, "box": 1}


def resize_weights(spark, size_in: int, size_out: int, name: str = "cubic", antialias: bool = True) -> DataFrame:
    """(o, i, w): output o is the sum of w times input i; input indexes are mirrored at the ends, weights sum to 1, zeros go."""
    scale = size_out / size_in
    stretch = scale if antialias and scale < 1 else 1.0
    reach = SUPPORT.get(name, 4) / stretch
    rows = spark.range(size_out).select(F.col("id").cast("int").alias("o"))
    centre = (F.col("o") + 0.5) / scale - 0.5
    rows = rows.select("o", centre.alias("c"), F.explode(F.sequence(F.floor(centre - reach / 2).cast("int"), F.ceil(centre + reach / 2).cast("int"))).alias("p"))
    rows = rows.select("o", "p", kernel(name, (F.col("c") - F.col("p")) * stretch).alias("w"))
    mirrored = F.pmod("p", F.lit(2 * size_in))
    rows = rows.select("o", F.least(mirrored, 2 * size_in - 1 - mirrored).alias("i"), "w").groupBy("o", "i").agg(F.sum("w").alias("w"))
    total = rows.groupBy("o").agg(F.sum("w").alias("t"))
    return rows.join(total, "o").select("o", "i", (F.col("w") / F.col("t")).alias("w")).where("w <> 0")


def dct_weights(spark, n: int = 8) -> DataFrame:
    """(o, i, w) of the orthonormal type-II cosine transform."""
    rows = spark.range(n * n).select((F.col("id") / n).cast("int").alias("o"), (F.col("id") % n).cast("int").alias("i"))
    norm = F.when(F.col("o") == 0, math.sqrt(1 / n)).otherwise(math.sqrt(2 / n))
    return rows.select("o", "i", (norm * F.cos((2 * F.col("i") + 1) * F.col("o") * (math.pi / (2 * n)))).alias("w"))


def apply_weights(vectors: DataFrame, key: str, vector: str, weights: DataFrame) -> DataFrame:
    """(key, o, value): each vector's values against the weights table, whose size its caller fixes. Products have twelve decimals and are summed
    exactly, a row at once; only the outputs are grouped, for keys that repeat. Values that are null are left out."""
    terms = sorted((r["o"], r["i"], r["w"]) for r in weights.select("o", "i", F.col("w").cast("double").alias("w")).collect())
    o, i, w = (np.array(x, t) for x, t in zip(zip(*terms, strict=True), (np.int32, np.int64, float), strict=True))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            for n in np.unique(lengths[lengths > 0]).tolist():
                inside = i < n
                if not inside.any():
                    continue
                outputs, starts = np.unique(o[inside], return_index=True)
                at = np.flatnonzero(lengths == n)
                for rows in np.array_split(at, -(-len(at) * inside.sum() // PRODUCTS)):
                    x = lists.take(pa.array(rows)).flatten()
                    some = x.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n)[:, i[inside]]
                    product = np.where(some, x.to_numpy(zero_copy_only=False).reshape(-1, n)[:, i[inside]] * w[inside], 0.0)
                    if not (np.abs(product) < 1e15).all():
                        raise ValueError("a product isn't finite, or too large for twelve exact decimals")
                    whole = np.trunc(product)
                    parts = [np.add.reduceat(v.astype(np.int64), starts, axis=1).ravel() for v in (whole, np.rint((product - whole) * 1e12))]
                    none = ~np.logical_or.reduceat(some, starts, axis=1).ravel()
                    keys = batch.column(0).take(pa.array(rows.repeat(len(outputs))))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(outputs, len(rows))), *[pa.array(v, mask=none) for v in parts]], [key, "o", "whole", "part"])

    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("v"))
    schema = StructType([rows.schema[key], StructField("o", IntegerType()), StructField("whole", LongType()), StructField("part", LongType())])
    sums = rows.mapInArrow(applied, schema).groupBy(key, "o").agg(F.sum("whole").alias("whole"), F.sum("part").alias("part"))
    value = F.col("whole").cast("decimal(20,0)") + F.col("part").cast("decimal(20,0)") * F.lit(Decimal("0.000000000001"))
    return sums.select(key, "o", value.cast("double").alias("value"))


def grid_kernel(spark, size: int, density) -> DataFrame:
    """(y, x, w) over a centred grid, weights summing to 1; density(x, y) is a Column."""
    half = size // 2
    axis = spark.range(size).select((F.col("id") - half).cast("int").alias("v"))
    grid = axis.select(F.col("v").alias("y")).crossJoin(F.broadcast(axis.select(F.col("v").alias("x"))))  # size x size cells, size is a parameter
    cells = grid.select("y", "x", density(F.col("x").cast("double"), F.col("y").cast("double")).alias("d"))
    total = cells.agg(F.sum("d").alias("t"))
    return cells.crossJoin(F.broadcast(total)).select("y", "x", (F.col("d") / F.col("t")).alias("w"))  # one row


def convolution_weights(kernel: DataFrame, width: int, height: int) -> DataFrame:
    """(o, i, w): output pixel o is the sum of w times pixel i, by a kernel (y, x, w) about o; edges are reflected without repeating them."""
    pixels = kernel.sparkSession.range(width * height).select(F.col("id").cast("int").alias("o"))
    cells = F.broadcast(kernel).crossJoin(pixels)  # kernel cells x pixels, both parameters

    def mirrored(at: Column, n: int) -> Column:
        turn = max(2 * (n - 1), 1)
        inside = F.pmod(at, F.lit(turn))
        return F.least(inside, turn - inside) if n > 1 else F.lit(0)

    row, column = mirrored(F.floor(F.col("o") / width) + F.col("y"), height), mirrored(F.col("o") % width + F.col("x"), width)
    return cells.groupBy("o", (row * width + column).cast("int").alias("i")).agg(F.sum("w").alias("w"))


def quadratic(x: Column, y: Column, sig_x: float, sig_y: float, theta: float) -> Column:
    """The squared Mahalanobis distance under a covariance with deviations sig_x, sig_y, rotated by theta."""
    c, s = math.cos(theta), math.sin(theta)
    u, v = x * c + y * s, y * c - x * s
    return u * u / sig_x**2 + v * v / sig_y**2


def gaussian(sig_x: float, sig_y: float, theta: float, beta: float = 1.0):
    return lambda x, y: F.exp(-0.5 * F.pow(quadratic(x, y, sig_x, sig_y, theta), F.lit(beta)))


def plateau(sig_x: float, sig_y: float, theta: float, beta: float):
    return lambda x, y: 1.0 / (F.pow(quadratic(x, y, sig_x, sig_y, theta), F.lit(beta)) + 1.0)


def gaussian_noise(values: Column, seed: Column, sigma: float, low: float = 0.0, high: float = 1.0) -> Column:
    """Values plus normal noise, clamped: two hashes of position and seed give a Box-Muller pair, so a row's noise is its own."""
    unit = lambda i, salt: (F.pmod(F.xxhash64(i, seed, F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    noise = lambda i: F.sqrt(-2.0 * F.log(unit(i, 1))) * F.cos(2 * math.pi * unit(i, 2))
    return F.transform(values, lambda x, i: F.least(F.greatest(x + sigma * noise(i), F.lit(low)), F.lit(high)))
