"""Named functions: registries with a decorator, lookups with a suffix, and metric dispatch by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import arrays, images


class Registry:
    """Names to objects. A name is taken once; `suffix` is tried where the plain name is unknown."""

    def __init__(self, kind: str):
        self.kind, self._held = kind, {}

    def register(self, thing: Callable | None = None, name: str | None = None, suffix: str | None = None):
        def put(x):
            key = (name or x.__name__) + (f"_{suffix}" if suffix else "")
            if key in self._held:
                raise ValueError(f"{self.kind} {key} is there already")
            self._held[key] = x
            return x

        return put if thing is None else put(thing)

    def get(self, name: str, suffix: str = "quarrystone"):
        for key in (name, f"{name}_{suffix}"):
            if key in self._held:
                return self._held[key]
        raise KeyError(f"no {self.kind} named {name}; there are {', '.join(sorted(self._held))}")

    def __contains__(self, name: str) -> bool:
        return name in self._held

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._held))


METRICS, LOSSES, SOURCES, OPERATORS = Registry("metric"), Registry("loss"), Registry("source"), Registry("operator")

METRICS.register(lambda a, b, **_: arrays.psnr(arrays.mse(a, b)), "psnr")
METRICS.register(lambda a, b, **_: arrays.psnr_unit(arrays.mse(a, b)), "psnr_unit")
METRICS.register(lambda a, b, width, **_: images.measure(images.ssim_of, a, b, width=width), "ssim")
LOSSES.register(lambda a, b: arrays.mae(a, b), "l1")
LOSSES.register(lambda a, b: arrays.mse(a, b), "mse")
LOSSES.register(lambda a, b: arrays.charbonnier(a, b), "charbonnier")


def metric(config: dict, a: Column, b: Column) -> Column:
    """A metric column by its config: `type`, and what else it takes. An unknown name is an error, not a zero."""
    options = dict(config)
    return METRICS.get(options.pop("type"))(a, b, **options)


def weighted_losses(config: list[dict], a: Column, b: Column) -> Column:
    """Sum of weight times loss over configured losses."""
    return sum((F.lit(float(c.get("weight", 1.0))) * LOSSES.get(c["type"])(a, b) for c in config), F.lit(0.0))


def register_sql(spark: SparkSession) -> list[str]:
    """Make the kernels that are not built in callable from SQL; returns their names."""

    @F.pandas_udf("double")
    def q_ssim(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([images.ssim_of(np.asarray(x).reshape(-1, w), np.asarray(y).reshape(-1, w)) for x, y, w in zip(a, b, width, strict=True)])

    spark.udf.register("q_ssim", q_ssim)
    return ["q_ssim"]


#: How many images a loss takes: its prediction alone, the target as well, or the target and weights.
ARITY: dict[str, int] = {}


def declare(name: str, takes: int, f: Callable) -> None:
    """Register a loss with its arity."""
    LOSSES.register(f, name)
    ARITY[name] = takes


declare("weighted_l1", 3, lambda a, b, w: arrays.weighted(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), w))
declare("mean", 1, lambda a: F.try_divide(arrays.exact_sum(a), F.size(a)))


def evaluated(name: str, prediction: Column, target: Column | None = None, weight: Column | None = None) -> Column:
    """A loss by name with as many arguments as it declares (two, if it says nothing); a missing one is an error."""
    given = [x for x in (prediction, target, weight)][: ARITY.get(name, 2)]
    if any(x is None for x in given):
        raise ValueError(f"loss {name} takes {len(given)} columns")
    return LOSSES.get(name)(*given)


def metric_in_space(config: dict, prediction: Column, target: Column, spaces: dict[str, Callable[[Column], Column]]) -> Column:
    """A metric in the space that its config names (`space`: latent by default): both sides go through that space's function first. An unknown
    space or metric is an error, not a zero."""
    options = dict(config)
    space = options.pop("space", "latent")
    if space not in spaces:
        raise KeyError(f"no space named {space}; there are {', '.join(sorted(spaces))}")
    return metric(options, spaces[space](prediction), spaces[space](target))


def built(config: dict, kind: Registry, *given):
    """What a config names (`type`), called with what is given and the config's other entries."""
    options = dict(config)
    return kind.get(options.pop("type"))(*given, **options)
