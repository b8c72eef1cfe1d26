"""Aggregates over metric rows: micro and macro means, best so far, moments, covariance, Frechet distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

EXACT = "decimal(30,10)"


def exact_mean(value: Column) -> Column:
    """Mean with a decimal sum, equal whatever the order of the rows; null over no rows."""
    return F.try_divide(F.sum(value.cast(EXACT)).cast("double"), F.count(value))


def micro(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(exact_mean(F.col(value)).alias("micro"))


def macro(rows: DataFrame, folder: str, value: str) -> DataFrame:
    """Unweighted mean of the folders' means."""
    return rows.groupBy(folder).agg(exact_mean(F.col(value)).alias("mean")).agg(exact_mean(F.col("mean")).alias("macro"))


def grouped_and_overall(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean per group, and over all rows in a row whose group is null and `overall` true; 0.0 over no rows."""
    out = rows.rollup(group).agg(F.grouping(group).alias("g"), F.coalesce(exact_mean(F.col(value)), F.lit(0.0)).alias("mean"), F.count(value).alias("n"))
    return out.select(group, (F.col("g") == 1).alias("overall"), "mean", "n")


def best(rows: DataFrame, keys: list[str], value: str, at: str, better: str = "higher") -> DataFrame:
    """Best value of each key and where it was; of ties the latest."""
    sign = 1 if better == "higher" else -1
    top = F.max(F.struct((F.col(value) * sign).alias("v"), F.col(at).alias("at")))
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(top.alias("t")).select(*keys, (F.col("t.v") * sign).alias("best"), F.col("t.at").alias("best_at"))


def moments(rows: DataFrame, vector: str, keys: list[str] | None = None) -> DataFrame:
    """dim, mean, var (unbiased) of each vector component; NaN and null count as missing."""
    long = rows.select(*(keys or []), F.posexplode(vector).alias("dim", "x")).withColumn("x", F.nanvl(F.col("x").cast("double"), F.lit(None).cast("double")))
    n, s, q = F.count("x"), F.sum(F.col("x").cast("decimal(28,12)")).cast("double"), F.sum((F.col("x") * F.col("x")).cast("decimal(28,12)")).cast("double")
    out = long.groupBy(*(keys or []), "dim").agg(n.alias("n"), s.alias("s"), q.alias("q"))
    return out.select(*(keys or []), "dim", "n", F.try_divide("s", "n").alias("mean"), F.try_divide(F.col("q") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.col("n") - 1).alias("var"))


#: Most (key, vector length) pairs whose sums a task holds before it gives them away.
HELD = 256


def _partial_sums(names: list[str], kinds: list):
    """Sums of values and products of a task's vectors, by key and vector length, as rows of the upper triangle."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (*key, d), (n, sums, products) in held.items():
                i, j = np.triu_indices(d)
                own = [pa.array([k] * len(i), kind) for k, kind in zip(key, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n)), *map(pa.array, (sums[i], sums[j], products[i, j]))], [*names, "i", "j", "n", "sx", "sy", "sxy"])
            held.clear()

        for batch in batches:
            values, sizes = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False), batch.column(len(names)).value_lengths().to_numpy()
            ends, members = np.cumsum(sizes), {}
            for row, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(len(names))), sizes.tolist(), strict=True)):
                members.setdefault(key, []).append(row)
            for key, rows in members.items():
                d = key[-1]
                vectors = values[(ends[rows] - d)[:, None] + np.arange(d)]
                before = held.get(key, (0, 0.0, 0.0))
                held[key] = [before[0] + len(rows), before[1] + vectors.sum(0), before[2] + vectors.T @ vectors]
            if len(held) > HELD:
                yield from given()
        yield from given()

    return summed


def covariance(rows: DataFrame, vector: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, cov) for i <= j over rows without NaN. A task gives d * (d + 1) / 2 sums a key, whatever the number of its rows."""
    keys = keys or []
    clean = rows.where(~F.exists(vector, lambda x: x.isNull() | F.isnan(x))).select(*keys, F.transform(vector, lambda x: x.cast("double")).alias("v"))
    kinds = [to_arrow_type(clean.schema[k].dataType) for k in keys]
    schema = StructType([*(clean.schema[k] for k in keys), *StructType.fromDDL("i int, j int, n long, sx double, sy double, sxy double")])
    parts = clean.mapInArrow(_partial_sums(keys, kinds), schema)
    sums = parts.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    return sums.select(*keys, "i", "j", F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("n") - 1).alias("cov"))


def frechet(mean1: np.ndarray, cov1: np.ndarray, mean2: np.ndarray, cov2: np.ndarray, eps: float = 1e-6) -> float:
    """|m1 - m2|^2 + tr(c1 + c2 - 2 sqrt(c1 c2)), the trace of the root from eigenvalues; eps is added to singular ones."""
    if min(np.linalg.eigvalsh(cov1)[0], np.linalg.eigvalsh(cov2)[0]) <= 0:
        cov1, cov2 = cov1 + eps * np.eye(len(cov1)), cov2 + eps * np.eye(len(cov2))
    values, vectors = np.linalg.eigh(cov1)
    root = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T
    inner = np.linalg.eigvalsh(root @ cov2 @ root)
    return float(((mean1 - mean2) ** 2).sum() + np.trace(cov1) + np.trace(cov2) - 2 * np.sqrt(np.maximum(inner, 0)).sum())


def frechet_to_rest(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, distance) of each key's vectors to all vectors. Spark sums the moments; what remains is one small matrix a key."""
    d = rows.select(F.max(F.size(vector)).alias("d"))
    tagged = rows.select(F.explode(F.array(F.col(key).cast("string"), F.lit("*"))).alias("part"), vector)
    mean = moments(tagged, vector, ["part"]).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("m"))
    cov = covariance(tagged, vector, ["part"]).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))).alias("c"))
    stats = mean.join(cov, "part").crossJoin(F.broadcast(d))  # one row
    whole = stats.where("part = '*'").select(F.col("m").alias("m2"), F.col("c").alias("c2"))
    pairs = stats.where("part <> '*'").crossJoin(F.broadcast(whole))  # one row of moments

    def measure(batches):
        import pandas as pd

        def matrix(cells, n):
            out = np.zeros((n, n))
            for c in cells:
                out[c["i"], c["j"]] = out[c["j"], c["i"]] = c["cov"] or 0.0
            return out

        for batch in batches:
            got = [frechet(np.array([x["mean"] for x in m]), matrix(c, n), np.array([x["mean"] for x in m2]), matrix(c2, n)) for m, c, m2, c2, n in zip(batch.m, batch.c, batch.m2, batch.c2, batch.d, strict=True)]
            yield pd.DataFrame({key: batch.part, "distance": got})

    return pairs.mapInPandas(measure, f"{key} string, distance double")
