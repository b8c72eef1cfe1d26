"""Two-stage random degradation: what is done to an image is drawn as columns, then carried out in one pass over Arrow batches.

A draw is 32 bits of a digest of the image's key, a seed and the step's name, so a plan doesn't depend on order, partitions or
attempts, and other engines can draw it as well. Plans are structs: they can be looked at, stored, counted and filtered like any column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import degrade

KINDS = ("iso", "aniso", "generalized_iso", "generalized_aniso", "plateau_iso", "plateau_aniso")
MODES = ("area", "bilinear", "bicubic")


@dataclass(frozen=True)
class Stage:
    """What a stage may draw. `ways`: the weights of growing, shrinking and staying; `resize`: least and largest scale."""

    sinc: float = 0.1
    kinds: tuple[float, ...] = (0.45, 0.25, 0.12, 0.03, 0.12, 0.03)
    sigma: tuple[float, float] = (0.2, 3.0)
    beta_generalized: tuple[float, float] = (0.5, 4.0)
    beta_plateau: tuple[float, float] = (1.0, 2.0)
    blur: float = 1.0
    ways: tuple[float, float, float] = (0.2, 0.7, 0.1)
    resize: tuple[float, float] = (0.15, 1.5)
    gaussian: float = 0.5
    noise: tuple[float, float] = (1.0, 30.0)
    poisson: tuple[float, float] = (0.05, 3.0)
    grey: float = 0.4
    quality: tuple[float, float] = (30.0, 95.0)


@dataclass(frozen=True)
class Recipe:
    stages: tuple[Stage, Stage] = (Stage(), Stage(sigma=(0.2, 1.5), blur=0.8, ways=(0.3, 0.4, 0.3), resize=(0.3, 1.2), noise=(1.0, 25.0), poisson=(0.05, 2.5)))
    sizes: tuple[int, ...] = field(default=tuple(range(7, 22, 2)))
    last_sinc: float = 0.8


def uniform(key: Column, seed: int, step: str) -> Column:
    """A number in [0, 1) for a key and the name of a step."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(f"{seed}:{step}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def between(u: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return low + u * (high - low)


def weighted(u: Column, values: Sequence[str], weights: Sequence[float]) -> Column:
    """The value into whose share of the weights u falls."""
    total, at, out = sum(weights), 0.0, None
    for v, w in list(zip(values, weights, strict=True))[:-1]:
        at += w
        test = u < at / total
        out = F.when(test, v) if out is None else out.when(test, v)
    return F.lit(values[-1]) if out is None else out.otherwise(values[-1])


def pick(u: Column, values: Sequence) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int") + 1)


def kernel_plan(key: Column, seed: int, name: str, stage: Stage, sizes: Sequence[int]) -> Column:
    """kind, size, sigma_x, sigma_y, theta, beta, cutoff of a blur kernel; beta lies on either side of 1 with even chances."""
    u = lambda step: uniform(key, seed, f"{name}.{step}")
    size = pick(u("size"), sizes)
    kind = F.when(u("sinc") < stage.sinc, "sinc").otherwise(weighted(u("kind"), KINDS, stage.kinds))
    low, high = (F.when(kind.startswith("plateau"), stage.beta_plateau[k]).otherwise(stage.beta_generalized[k]) for k in (0, 1))
    beta = F.when(u("side") < 0.5, between(u("beta"), low, 1.0)).otherwise(between(u("beta"), 1.0, high))
    cutoff = between(u("cutoff"), F.when(size < 13, math.pi / 3).otherwise(math.pi / 5), math.pi)
    return F.struct(
        kind.alias("kind"),
        size.alias("size"),
        between(u("sigma_x"), *stage.sigma).alias("sigma_x"),
        between(u("sigma_y"), *stage.sigma).alias("sigma_y"),
        between(u("theta"), -math.pi, math.pi).alias("theta"),
        beta.alias("beta"),
        cutoff.alias("cutoff"),
    )


def stage_plan(key: Column, seed: int, name: str, stage: Stage, sizes: Sequence[int]) -> Column:
    u = lambda step: uniform(key, seed, f"{name}.{step}")
    way = weighted(u("way"), ("up", "down", "keep"), stage.ways)
    scale = F.when(way == "up", between(u("scale"), 1.0, stage.resize[1])).when(way == "down", between(u("scale"), stage.resize[0], 1.0)).otherwise(1.0)
    gaussian = u("noise") < stage.gaussian
    level = F.when(gaussian, between(u("level"), *stage.noise)).otherwise(between(u("level"), *stage.poisson))
    return F.struct(
        kernel_plan(key, seed, name, stage, sizes).alias("kernel"),
        (u("blur") < stage.blur).alias("blur"),
        F.struct(way.alias("way"), scale.alias("scale"), pick(u("mode"), MODES).alias("mode")).alias("resize"),
        F.struct(F.when(gaussian, "gaussian").otherwise("poisson").alias("kind"), level.alias("level"), (u("grey") < stage.grey).alias("grey")).alias("noise"),
        between(u("quality"), *stage.quality).alias("quality"),
    )


def plan(key: Column, seed: int, recipe: Recipe = Recipe()) -> Column:  # noqa: B008
    """The whole plan of an image: two stages and the last filter, all drawn from its key."""
    u = lambda step: uniform(key, seed, f"last.{step}")
    stages = F.array(*[stage_plan(key, seed, f"stage{k}", s, recipe.sizes) for k, s in enumerate(recipe.stages, 1)])
    last = F.struct(
        (u("sinc") < recipe.last_sinc).alias("sinc"),
        pick(u("size"), recipe.sizes).alias("size"),
        between(u("cutoff"), math.pi / 3, math.pi).alias("cutoff"),
        (u("order") < 0.5).alias("filter_first"),
        pick(u("mode"), MODES).alias("mode"),
    )
    return F.struct(stages.alias("stages"), last.alias("last"))


def degraded(images: DataFrame, key: str, image: str, height: str, width: str, seed: int, scale: int = 4, recipe: Recipe = Recipe(), sharpen: bool = True) -> DataFrame:  # noqa: B008
    """key, status, lq_height, lq_width, lq (0..255, row-major, channels last), plan. Images are row-major arrays of 0..255 with three
    channels last; one of another size than it says gets the status `bad_size` and nulls, its neighbours are not touched by it."""
    rows = images.select(F.col(key), F.col(image).cast("array<double>").alias("image"), F.col(height).cast("int").alias("h"), F.col(width).cast("int").alias("w"), plan(F.col(key), seed, recipe).alias("plan"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, plans, out = batch.column(0).to_pylist(), batch.column(4).to_pylist(), []
            for k, values, h, w, p in zip(keys, batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), plans, strict=True):
                flat = values.values.to_numpy(zero_copy_only=False) if values.is_valid else np.zeros(0)
                if not h or not w or min(h, w) < 1 or len(flat) != 3 * h * w:
                    out.append(("bad_size", None, None, None))
                    continue
                lq = degrade.executed(flat.reshape(h, w, 3) / 255, p, k, seed, scale, sharpen)
                out.append(("ok", *lq.shape[:2], np.rint(lq.ravel() * 255).astype(np.int16)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int16())]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(4)], [key, "status", "lq_height", "lq_width", "lq", "plan"])

    kind = rows.schema[key].dataType.simpleString()
    shape = rows.schema["plan"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, status string, lq_height int, lq_width int, lq array<smallint>, plan {shape}")
