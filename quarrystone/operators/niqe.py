"""Blind image quality at two scales: block features, a model of pristine blocks, and the distance between the two.

Large images are cut into rows of blocks with the pixels around them before Python sees them, so that an image's blocks are spread
over tasks; what a task computes is what the whole image would give. The model of pristine blocks is summed up by Spark. A block's features are
36 numbers, so the blocks of one image meet in one row for its own mean and covariance.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import images
from quarrystone.operators import metrics

BLOCK = 96
#: Rows of pixels around a row of blocks: three of the half-sized image, whose weights reach four rows and a half further.
HALO = 12


def luma(image: Column, to: str = "y") -> Column:
    """The plane that is judged, of a row-major 0..255 image with three channels last (red first): `y` of video range, or `gray`."""
    # fixed values: weights of red, green, blue and an offset
    weights = {"y": (65.481 / 255, 128.553 / 255, 24.966 / 255, 16.0), "gray": (0.299, 0.587, 0.114, 0.0)}[to]
    at = lambda p, c: F.element_at(image, (p * 3 + c + 1).cast("int")).cast("double") * weights[c]
    return F.transform(F.sequence(F.lit(0), (F.floor(F.size(image) / 3) - 1).cast("int")), lambda p: at(p, 0) + at(p, 1) + at(p, 2) + weights[3])


@functools.lru_cache(maxsize=64)
def half_weights(n: int, lo: int, hi: int) -> np.ndarray:
    """Rows lo..hi-1 of the weights that halve n values: cubic, antialiased, ends mirrored with themselves."""
    out = np.zeros((hi - lo, n))
    o = np.arange(lo, hi)
    for p in range(-4, 6):
        at = 2 * o + p
        d = np.abs(0.5 - p) / 2
        w = 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d <= 2 else 0.0
        at = at % (2 * n)
        np.add.at(out, (o - lo, np.minimum(at, 2 * n - 1 - at)), w)
    return out / out.sum(1, keepdims=True)


def strip_features(strip: np.ndarray, top: int, row: int, height: int, block: int) -> np.ndarray:
    """(blocks, 36) of the row of blocks `row` of an image of this height; the strip's first line is the image's line `top`."""
    width = strip.shape[1]
    at = row * block - top
    full = images.normalised(strip)[at : at + block]
    half = block // 2
    lo, hi = max(0, row * half - 3), min(height // 2, (row + 1) * half + 3)
    small = half_weights(height, lo, hi)[:, top : top + strip.shape[0]] @ (strip / 255) @ half_weights(width, 0, width // 2).T * 255
    small = images.normalised(small)[row * half - lo : row * half - lo + half]
    return np.array([images.block_features(full[:, x * block : (x + 1) * block]) + images.block_features(small[:, x * half : (x + 1) * half]) for x in range(width // block)])


def block_rows(rows: DataFrame, key: str, image: str, width: str, block: int = BLOCK, border: int = 0) -> DataFrame:
    """key, block_row, block_column, features (36 numbers). Images are row-major planes of 0..255, rounded here; `border` lines are cut off on
    each side, and what doesn't fill a block at the right and the lower end. An image that is smaller than a block gives no rows."""
    if block % 2:
        raise ValueError("a block has an even number of lines")
    given = rows.select(F.col(key).alias("key"), F.col(image).alias("image"), F.col(width).cast("int").alias("wide")).where("wide > 0 and image is not null")
    given = given.withColumn("tall", F.floor(F.size("image") / F.col("wide")).cast("int"))
    given = given.withColumns({"h": F.floor((F.col("tall") - 2 * border) / block).cast("int") * block, "w": F.floor((F.col("wide") - 2 * border) / block).cast("int") * block}).where("h > 0 and w > 0")
    cut = given.withColumn("row", F.explode(F.sequence(F.lit(0), (F.col("h") / block).cast("int") - 1)))
    cut = cut.withColumn("top", F.greatest(F.lit(0), F.col("row") * block - HALO))
    lines = F.least(F.col("h"), (F.col("row") + 1) * block + HALO) - F.col("top")
    strip = F.slice("image", (F.col("top") + border) * F.col("wide") + 1, lines * F.col("wide"))
    cut = cut.select("key", "row", "top", "wide", "h", "w", F.transform(strip, lambda x: F.rint(x.cast("double"))).alias("strip"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, columns, features = [], [], [], []
            heads = zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True)
            for (k, row, top, wide, h, w), values in zip(heads, batch.column(6), strict=True):
                plane = values.values.to_numpy(zero_copy_only=False).reshape(-1, wide)[:, border : border + w]
                found = strip_features(plane, top, row, h, block)
                keys += [k] * len(found)
                at += [row] * len(found)
                columns += range(len(found))
                features += list(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(at, pa.int32()), pa.array(columns, pa.int32()), pa.array(features, pa.list_(pa.float64()))], [key, "block_row", "block_column", "features"])

    return cut.mapInArrow(run, f"`{key}` {cut.schema['key'].dataType.simpleString()}, block_row int, block_column int, features array<double>")


def pristine_model(blocks: DataFrame) -> DataFrame:
    """One row: mean (array) and cov (array of arrays) of the features of blocks, summed up in their tasks."""
    mean = metrics.moments(blocks, "features").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("mean"))
    cells = metrics.covariance(blocks, "features")
    both = cells.unionByName(cells.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    lines = both.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "cov"))), lambda x: x["cov"]).alias("line"))
    cov = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("cov"))
    return mean.crossJoin(F.broadcast(cov))  # one row each


def distance(blocks: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> float | None:
    """Of one image's blocks from the model: NaN features are left out of means, blocks with one out of the covariance."""
    whole = blocks[~np.isnan(blocks).any(1)]
    if len(whole) < 2:
        return None
    gap = mean - np.nanmean(blocks, 0)
    square = gap @ np.linalg.pinv((cov + np.cov(whole, rowvar=False)) / 2) @ gap
    return float(np.sqrt(square)) if square >= 0 else None


def scores(blocks: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """key, blocks, niqe. An image with less than two whole blocks has no covariance and gets null."""
    own = blocks.groupBy(F.col(key).alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("block_row", "block_column", "features"))), lambda x: x["features"]).alias("own"))
    rows = own.crossJoin(F.broadcast(model))  # one row of 36 + 36 x 36 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distance(np.array(o), np.array(m), np.array(c)) for o, m, c in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).value_lengths().cast(pa.int32()), pa.array(found, pa.float64())], [key, "blocks", "niqe"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, blocks int, niqe double")
