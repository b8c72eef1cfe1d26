"""Scores of images by models that the caller brings: batched inference in tasks, and a table of scores that grows by key.

A scorer is a function without arguments that loads a model and gives a function from a batch (n, side, side, ...) to n numbers. Spark's
batched prediction calls the first once in each Python worker and the second with at most `batch` images. Scores meet their rows by key, never by
position. A scores table holds (key, metric, score, run); each run appends what it scored, so it is safe to repeat, and the last
run of a key and metric counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from quarrystone.functions import images, resample

SCORES = "metric string, score double, run long"
Scorer = Callable[[], Callable[[np.ndarray], np.ndarray]]


def model_input(image: Column | str, height: Column | str, width: Column | str, side: int, channels: int = 1, pad: str = "constant", eight_bit: bool = False) -> Column:
    """A row-major image (channels last) brought to side x side by cubic weights, antialiased, with `pad` (see `resample.folded`) around it; null
    where it has another size than it says. Images of 0..255 that models get as 8-bit images (`eight_bit`) are cut to whole levels and divided by 255."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(pixels, tall, wide):
        import pandas as pd

        def one(x, h, w):
            if x is None or pd.isna(h) or pd.isna(w) or min(h, w) < 1 or len(x) != int(h) * int(w) * channels:
                return None
            plane = np.asarray(x, np.float64).reshape(int(h), int(w), channels)
            rows, columns = (resample.axis_matrix(n, side, side / n, pad=pad) for n in plane.shape[:2])
            small = np.einsum("ah,hwc,bw->abc", rows, plane, columns, optimize=True).ravel()
            return np.floor(np.clip(small, 0, 255)) / 255 if eight_bit else small

        return pd.Series([one(*row) for row in zip(pixels, tall, wide, strict=True)], dtype=object)

    return run(image, height, width)


def predicted(rows: DataFrame, key: str, tensor: str, shape: list[int], scorers: dict[str, Scorer], batch: int = 100) -> DataFrame:
    """key, metric, score: one row for each row and scorer. `tensor` holds prod(shape) numbers; rows where it is null get null scores."""
    if not scorers:
        return rows.select(key, F.lit("").alias("metric"), F.lit(None).cast("double").alias("score")).limit(0)
    names = sorted(scorers)
    functions = [scorers[n] for n in names]

    def load():
        models = [f() for f in functions]

        def score(inputs: np.ndarray) -> dict[str, np.ndarray]:
            return {f"s{k}": np.asarray(m(inputs), np.float64).reshape(len(inputs)) for k, m in enumerate(models)}

        return score

    kind = StructType([StructField(f"s{k}", DoubleType()) for k in range(len(names))])
    udf = predict_batch_udf(load, return_type=kind, batch_size=batch, input_tensor_shapes=[shape])
    known = rows.where(F.col(tensor).isNotNull()).select(key, udf(F.col(tensor)).alias("__s"))
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"__s.s{k}").alias("score")) for k, n in enumerate(names)])
    found = known.select(key, F.explode(pairs).alias("__p")).select(key, "__p.metric", "__p.score")
    none = rows.where(F.col(tensor).isNull()).select(key, F.explode(F.array(*map(F.lit, names))).alias("metric"), F.lit(None).cast("double").alias("score"))
    return found.unionByName(none)


def read_scores(spark: SparkSession, path: str, key: str, kind: str = "long") -> DataFrame:
    """The last score of each key and metric; without a table there, no rows."""
    try:
        rows = spark.read.schema(f"`{key}` {kind}, {SCORES}").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], f"`{key}` {kind}, {SCORES}")
    last = F.max(F.struct("run", "score")).alias("__l")
    return rows.groupBy(key, "metric").agg(last).select(key, "metric", "__l.score", "__l.run")


def upsert_scores(scores: DataFrame, path: str, key: str, run: int) -> None:
    """Append the scores of a run. A run that is written again gives equal rows, of which one counts."""
    scores.select(key, "metric", "score", F.lit(run).cast("long").alias("run")).write.mode("append").parquet(path)


def unscored(rows: DataFrame, path: str, key: str, metrics: list[str]) -> DataFrame:
    """Rows whose key lacks one of the metrics. Keys join by shuffle or broadcast as their sizes say."""
    kind = rows.schema[key].dataType.simpleString()
    done = read_scores(rows.sparkSession, path, key, kind).where(F.col("metric").isin(metrics)).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") == len(metrics))
    return rows.join(done.select(key), key, "left_anti")


def score_new(rows: DataFrame, path: str, key: str, tensor: str, shape: list[int], scorers: dict[str, Scorer], run: int, batch: int = 100) -> None:
    """Score what the table at `path` doesn't have yet. A run that failed on the way is repeated by calling this again."""
    upsert_scores(predicted(unscored(rows, path, key, sorted(scorers)), key, tensor, shape, scorers, batch), path, key, run)


def with_scores(manifest: DataFrame, scores: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """The manifest with a column for each metric, by key; a key without a score gets null, a key that repeats gets it each time."""
    wide = scores.groupBy(key).agg(*[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in metrics])
    kept = [c for c in manifest.columns if c not in metrics]
    return manifest.select(*kept).join(wide, key, "left")


def sharpness() -> Callable[[np.ndarray], np.ndarray]:
    """A scorer that needs no trained model: the mean step between neighbours in a row."""
    return lambda x: np.abs(np.diff(x.reshape(len(x), x.shape[1], -1), axis=2)).mean((1, 2))


def contrast() -> Callable[[np.ndarray], np.ndarray]:
    """The mean square around the mean."""
    return lambda x: x.reshape(len(x), -1).var(1)


def artifacts() -> Callable[[np.ndarray], np.ndarray]:
    """The mean local variance around pixels, which grows with noise."""
    return lambda x: np.array([images.local_variance(p.reshape(p.shape[0], -1), 3).mean() for p in x])
