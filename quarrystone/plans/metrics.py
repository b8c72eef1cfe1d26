"""Metric queries over events (scalar metrics) and embeddings (feature vectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import metrics
from quarrystone.plans.base import query, table

E = "sum({0}::DECIMAL(30,10))::DOUBLE / count({0})"


@query(f"SELECT round({E.format('value')}, 6) AS micro FROM events")
def micro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.micro(table(spark, sf_dir, "events"), "value").select(F.round("micro", 6).alias("micro"))


@query(f"SELECT round({E.format('m')}, 6) AS macro FROM (SELECT user_id, {E.format('value')} AS m FROM events GROUP BY user_id)")
def macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(table(spark, sf_dir, "events"), "user_id", "value").select(F.round("macro", 6).alias("macro"))


@query(f"SELECT event_type, grouping(event_type) = 1 AS overall, round({E.format('value')}, 6) AS mean, count(value) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")
def grouped_and_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped_and_overall(table(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, t.v AS best, t.i AS best_at FROM (SELECT event_type, max({'v': value, 'i': event_id}) AS t FROM events GROUP BY event_type)")
def best_metric_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")


@query("SELECT event_type, -t.v AS best, t.i AS best_at FROM (SELECT event_type, max({'v': -value, 'i': event_id}) AS t FROM events GROUP BY event_type)")
def best_metric_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id", "lower")


@query("SELECT l_returnflag, round(sum((abs(l_extendedprice - l_quantity * 1000) * l_discount)::DECIMAL(30,10))::DOUBLE / sum(l_discount::DECIMAL(30,10))::DOUBLE, 4) AS loss FROM lineitem GROUP BY l_returnflag")
def weighted_mean_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000)
    exact = lambda c: F.sum(c.cast(metrics.EXACT)).cast("double")
    value = F.try_divide(exact(loss * F.col("l_discount")), exact(F.col("l_discount")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(value, 4).alias("loss"))


LONG = "x AS (SELECT vec_id, label, unnest(range(0, len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
D = "sum(({0})::DECIMAL(28,12))::DOUBLE"


@query(f"WITH {LONG}, s AS (SELECT dim, count(*) AS n, {D.format('x')} AS s, {D.format('x * x')} AS q FROM x GROUP BY dim) SELECT dim, n, round(s / n, 8) AS mean, round((q - s * s / n) / (n - 1), 8) AS var FROM s")
def gauss_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.moments(table(spark, sf_dir, "embeddings"), "embedding")
    return out.select("dim", "n", F.round("mean", 8).alias("mean"), F.round("var", 8).alias("var"))


@query(f"WITH {LONG}, s AS (SELECT a.dim AS i, b.dim AS j, count(*) AS n, {D.format('a.x')} AS sx, {D.format('b.x')} AS sy, {D.format('a.x * b.x')} AS sxy FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2) SELECT i, j, round((sxy - sx * sy / n) / (n - 1), 8) AS cov FROM s")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.covariance(table(spark, sf_dir, "embeddings"), "embedding").select("i", "j", F.round("cov", 8).alias("cov"))


@query()
def frechet_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.frechet_to_rest(table(spark, sf_dir, "embeddings"), "embedding", "label")


@query(f"WITH {LONG}, s AS (SELECT label, dim, count(*) AS n, {D.format('x')} AS s, {D.format('x * x')} AS q FROM x GROUP BY ALL) SELECT label, dim, round(s / n, 8) AS mean, round(sqrt((q - s * s / n) / (n - 1) + 1e-5), 8) AS std FROM s")
def channel_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.moments(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return out.select("label", "dim", F.round("mean", 8).alias("mean"), F.round(F.sqrt(F.col("var") + 1e-5), 8).alias("std"))


@query("SELECT label, pow(2, ceil(log2(count(DISTINCT round(embedding[1]::DOUBLE, 1)))))::BIGINT AS levels FROM embeddings GROUP BY label")
def distinct_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct(F.round(F.col("embedding")[0].cast("double"), 1))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.pow(F.lit(2), F.ceil(F.log2(n))).cast("long").alias("levels"))
