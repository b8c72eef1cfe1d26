"""Samples of image datasets down to their values: crops, flips, channel order, planes and normalisation composed into one index.

An image is a row-major array of pixels with their channels beside each other. What is drawn (see `datasets.draw`) are columns, and a sample's values are
one expression over them, so a plan that reads files, pairs them, draws and cuts is a plan of built-in functions, and repeated tasks
give the same sample. Which value an output takes is computed from its place, so nothing is cut or turned in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import layout
from quarrystone.operators import datasets, degradation
from quarrystone.operators.ordering import numbered


def _column(v: Column | int | bool) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _planes(image: Column, height: Column, width: Column, order: Sequence[int], source, mean: Sequence[float] | None, std: Sequence[float] | None, unit: float) -> Column:
    """Values by channel, line and column; source(y, x, channel) is where in the image each stands."""
    channels = F.array(*map(F.lit, order))
    numbers = lambda v, other: F.array(*[F.lit(float(x)) for x in v]) if v is not None else F.array(*[F.lit(other)] * len(order))
    area = (height * width).cast("int")

    def value(values: Column, at: Column) -> Column:
        c, y, x = F.floor(at / area).cast("int"), F.floor(at % area / width).cast("int"), (at % width).cast("int")
        taken = F.get(values, source(y, x, F.get(channels, c)).cast("int")).cast("double")
        return (taken / unit - F.get(numbers(mean, 0.0), c)) / F.get(numbers(std, 1.0), c)

    places = F.sequence(F.lit(0), area * len(order) - 1)
    return F.when((area > 0) & image.isNotNull(), layout.let(image, lambda v: F.transform(places, lambda i: value(v, i))))


def tensor(image: Column, width: Column | int, patch: tuple, channels: int = 1, top: Column | int = 0, left: Column | int = 0, hflip: Column | bool = False, vflip: Column | bool = False, transpose: Column | bool = False, order: Sequence[int] | None = None, mean: Sequence[float] | None = None, std: Sequence[float] | None = None, unit: float = 1.0) -> Column:
    """The patch (height, width) at top and left, flipped across and down and then transposed, in planes of the channels that `order` names,
    divided by `unit`, less the mean over the deviation of its channel."""
    high, wide = map(_column, patch)
    width, top, left, hflip, vflip, transpose = map(_column, (width, top, left, hflip, vflip, transpose))

    def source(y: Column, x: Column, c: Column) -> Column:
        row, col = F.when(transpose, x).otherwise(y), F.when(transpose, y).otherwise(x)
        row, col = F.when(vflip, high - 1 - row).otherwise(row), F.when(hflip, wide - 1 - col).otherwise(col)
        return ((top + row) * width + left + col) * channels + c

    return _planes(image, F.when(transpose, wide).otherwise(high), F.when(transpose, high).otherwise(wide), order or range(channels), source, mean, std, unit)


def single_images(rows: DataFrame, image: str, height: str, width: str, channels: int, order: Sequence[int] | None = None, luma: bool = False, mean: Sequence[float] | None = None, std: Sequence[float] | None = None, unit: float = 255.0) -> DataFrame:
    """rows with `lq`: the whole image in planes; of its luminance (video range, first channel red) if `luma`."""
    size = (F.col(height), F.col(width))
    if luma:
        from quarrystone.operators.niqe import luma as plane

        return rows.withColumn("lq", tensor(plane(F.col(image)), F.col(width), size, 1, mean=mean, std=std, unit=unit))
    return rows.withColumn("lq", tensor(F.col(image), F.col(width), size, channels, order=order, mean=mean, std=std, unit=unit))


def face_images(rows: DataFrame, key: str, image: str, height: str, width: str, channels: int, seed: int, order: Sequence[int], mean: Sequence[float], std: Sequence[float], hflip: bool = True, unit: float = 255.0) -> DataFrame:
    """rows with `hflip` and `gt`: whole images, mirrored by a coin of their key."""
    drawn = datasets.augmentation(rows, key, seed, hflip, rotate=False).drop("vflip", "transpose")
    return drawn.withColumn("gt", tensor(F.col(image), F.col(width), (F.col(height), F.col(width)), channels, hflip=F.col("hflip"), order=order, mean=mean, std=std, unit=unit))


def paired_patches(rows: DataFrame, key: str, lq: str, gt: str, height: str, width: str, gt_height: str, gt_width: str, channels: int, patch: int, scale: int, seed: int, hflip: bool = True, rotate: bool = True, order: Sequence[int] | None = None, mean: Sequence[float] | None = None, std: Sequence[float] | None = None, unit: float = 255.0) -> DataFrame:
    """rows with the draws, `crop_status`, and `lq_patch` and `gt_patch`, cut at the same place and turned alike.

    The status is `too_small` where the input is smaller than the patch, `scale_mismatch` where the target isn't `scale` times as large; then both are null.
    """
    drawn = datasets.augmentation(datasets.crop_window(rows, key, seed, height, width, patch, scale), key, seed, hflip, rotate)
    fits = (F.col(gt_height) == F.col(height) * scale) & (F.col(gt_width) == F.col(width) * scale)
    drawn = drawn.withColumn("crop_status", F.when(fits, F.col("crop_status")).otherwise("scale_mismatch"))
    turn = {k: F.col(k) for k in ("hflip", "vflip", "transpose")}
    cut = lambda name, wide, at, size: F.when(F.col("crop_status") == "ok", tensor(F.col(name), F.col(wide), (size, size), channels, F.col(f"{at}top"), F.col(f"{at}left"), **turn, order=order, mean=mean, std=std, unit=unit))
    return drawn.withColumns({"lq_patch": cut(lq, width, "", patch), "gt_patch": cut(gt, gt_width, "gt_", patch * scale)})


def degradation_samples(rows: DataFrame, key: str, image: str, height: str, width: str, channels: int, seed: int, side: int = 400, recipe: degradation.Recipe | None = None, order: Sequence[int] | None = None, unit: float = 255.0) -> DataFrame:
    """rows with the draws, `gt` (side x side, in planes) and `plan`, what `degradation.degraded` does to it.

    Images are turned first; what is smaller than the side is extended to the right and below by reflection without its edge, what is larger is cut at a drawn place.
    """
    drawn = datasets.augmentation(rows, key, seed)
    turned = F.col("transpose")
    high, wide = F.when(turned, F.col(width)).otherwise(F.col(height)), F.when(turned, F.col(height)).otherwise(F.col(width))
    at = lambda size, purpose: datasets.draw(F.col(key), seed, purpose, F.greatest(size - side + 1, F.lit(1)))
    drawn = drawn.withColumns({"top": at(high, "top"), "left": at(wide, "left")})

    def reflected(i: Column, n: Column) -> Column:
        period = F.greatest(2 * (n - 1), F.lit(1))
        inside = i % period
        return F.least(inside, F.abs(period - inside))

    def source(y: Column, x: Column, c: Column) -> Column:
        a, b = reflected(F.col("top") + y, high), reflected(F.col("left") + x, wide)
        row, col = F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b)
        row, col = F.when(F.col("vflip"), F.col(height) - 1 - row).otherwise(row), F.when(F.col("hflip"), F.col(width) - 1 - col).otherwise(col)
        return (row * F.col(width) + col) * channels + c

    gt = F.when((F.col(height) > 0) & (F.col(width) > 0), _planes(F.col(image), F.lit(side), F.lit(side), order or range(channels), source, None, None, unit))
    return drawn.withColumns({"gt": gt, "plan": degradation.plan(F.col(key), seed, recipe or degradation.Recipe())})


def paired_latents(rows: DataFrame, key: str, lq: str, gt: str, shape: tuple[int, int, int], scale: int, seed: int, train: bool = True, mean: Sequence[float] | None = None, std: Sequence[float] | None = None) -> DataFrame:
    """rows with the draws and `lq_latent`, `gt_latent`: planes (channels, height, width) as they are stored, both mirrored alike in training.

    An array of another size than its shape gives null.
    """
    drawn = datasets.augmentation(rows, key, seed, train, train).drop("transpose")

    def turned(name: str, c: int, h: int, w: int) -> Column:
        def value(values: Column, i: Column) -> Column:
            plane, y, x = F.floor(i / (h * w)).cast("int"), F.floor(i % (h * w) / w), i % w
            y, x = F.when(F.col("vflip"), h - 1 - y).otherwise(y), F.when(F.col("hflip"), w - 1 - x).otherwise(x)
            taken = F.get(values, (plane * (h * w) + y * w + x).cast("int")).cast("double")
            if mean is None or std is None:
                return taken
            return (taken - F.get(F.array(*map(F.lit, mean)), plane)) / F.get(F.array(*map(F.lit, std)), plane)

        return F.when(F.size(name) == c * h * w, layout.let(F.col(name), lambda v: F.transform(F.sequence(F.lit(0), F.lit(c * h * w - 1)), lambda i: value(v, i))))

    c, h, w = shape
    return drawn.withColumns({"lq_latent": turned(lq, c, h, w), "gt_latent": turned(gt, c, h * scale, w * scale)})


def septuplet_tests(clips: DataFrame, clip: str, frames: int, gt_root: str, lq_root: str) -> DataFrame:
    """clip, gt_path, lq_paths, folder, idx ('number/all'), border, lq_path: a test of the fourth image of each clip of seven, in order of clips."""
    at = numbered(clips.select(clip), clip, name="__n")
    total = clips.agg(F.count("*").alias("__all"))
    path = lambda root, n: F.concat(F.lit(root + "/"), F.col(clip).cast("string"), F.lit("/im"), n.cast("string"), F.lit(".png"))
    numbers = F.array(*[F.lit(k + (9 - frames) // 2) for k in range(frames)])
    rows = at.crossJoin(F.broadcast(total))  # one row
    rows = rows.select(clip, path(gt_root, F.lit(4)).alias("gt_path"), F.transform(numbers, lambda n: path(lq_root, n)).alias("lq_paths"), F.lit("vimeo90k").alias("folder"), F.concat_ws("/", F.col("__n").cast("string"), F.col("__all").cast("string")).alias("idx"), F.lit(0).alias("border"))
    return rows.withColumn("lq_path", F.get("lq_paths", F.lit(frames // 2)))
