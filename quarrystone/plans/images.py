"""Image queries: vectors of 256 values, made of four embeddings, are 16 x 16 grey images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import arrays, images, layout
from quarrystone.plans.base import query, table
from quarrystone.sources import files


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images in 0..255 with a degraded copy."""
    v = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("image_id"), "vec_id", F.transform("embedding", lambda x: F.round(F.least(F.greatest(x.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255)).alias("e"))
    whole = v.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "e"))).alias("s")).where(F.size("s") == 4)
    a = F.flatten(F.transform("s", lambda x: x["e"]))
    return whole.select("image_id", a.alias("a"), F.transform(a, lambda x, i: F.when(i % 5 == 0, x * 0.8).otherwise(x)).alias("b"))


@query()
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("image_id", images.measure(images.ssim_of, "a", "b", width=16).alias("ssim"))


@query()
def niqe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def features(a):
        import numpy as np
        import pandas as pd

        return pd.Series([images.niqe_features(np.asarray(x).reshape(16, 16)) for x in a])

    return _images(spark, sf_dir).select("image_id", features("a").alias("features"))


@query()
def jpeg_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _images(spark, sf_dir)
    return rows.select("image_id", images.changed(images.jpeg_grey, "a", F.lit(50.0), width=16).alias("jpeg"))


@query()
def poisson_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _images(spark, sf_dir).select("image_id", F.transform("a", lambda x: x / 255).alias("a"))
    return rows.select("image_id", images.changed(images.poisson_noise, "a", "image_id", width=16).alias("noisy"))


@query()
def artifact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def score(a, b):
        import numpy as np
        import pandas as pd

        shape = lambda v: np.asarray(v).reshape(16, 16) / 255
        return pd.Series([images.artifact_map(shape(x), shape(y), images.filtered(shape(y), np.full((3, 3), 1 / 9))).ravel() for x, y in zip(a, b, strict=True)])

    return _images(spark, sf_dir).select("image_id", score("a", "b").alias("weights"))


#: Dictionary entries a label.
ENTRIES = 8

CLIP_LINES = "l AS (SELECT user_id, printf('%03d %d (%d,%d,3)', user_id, count(*), 720, 1280) AS value FROM events GROUP BY user_id)"


@query(f"WITH {CLIP_LINES} SELECT regexp_extract(value, '^(\\S+)', 1) AS folder, regexp_extract(value, '^\\S+ (\\d+)', 1)::INT AS frames, 720 AS h, 1280 AS w, 3 AS c FROM l")
def parse_meta_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(F.format_string("%03d %d (%d,%d,3)", "user_id", "n", F.lit(720), F.lit(1280)).alias("value"))
    return files.parse_clips(lines)


@query("SELECT event_id AS step, value::DECIMAL(10,2)::DOUBLE AS value FROM events WHERE event_type = 'view'")
def parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(": iter "), F.col("event_id").cast("string"), F.lit(", loss "), F.col("value").cast("decimal(10,2)").cast("string")).alias("value"))
    return files.parse_log(lines, r"view: iter ([\d,]+), loss (\S+)")


@query("SELECT vec_id, lpad(vec_id::VARCHAR, 8, '0') || '.png' AS key FROM embeddings")
def synthetic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", files.synthetic_key(F.col("vec_id")).alias("key"))


@query(
    """WITH d AS (SELECT label, list(e ORDER BY vec_id) AS es, list(vec_id ORDER BY vec_id) AS ids FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 8 GROUP BY label),
s AS (SELECT q.vec_id, i.range::INT AS i, ids[i.range] AS near, round(list_sum(list_transform(range(1, 65), lambda k: (q.embedding[k]::DOUBLE * es[i.range][k])::DECIMAL(28,12)))::DOUBLE, 7) AS score FROM embeddings q JOIN d ON d.label = q.label, range(1, 9) i WHERE i.range <= len(ids))
SELECT vec_id, t.n * -1 AS near, t.s AS score FROM (SELECT vec_id, max({'s': score, 'n': -near}) AS t FROM s GROUP BY vec_id)"""
)
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the dictionary of its label: ENTRIES of them, the label's first vectors."""
    from pyspark.sql import Window

    from quarrystone.functions import arrays

    v = table(spark, sf_dir, "embeddings")
    # labels x ENTRIES: the dictionary's size is a parameter, and it is broadcast
    entries = v.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("r") <= ENTRIES).select("label", F.col("vec_id").alias("near"), F.col("embedding").alias("d"))
    scored = v.join(F.broadcast(entries), "label").select("vec_id", F.struct(F.round(arrays.pair_sum(F.col("embedding"), F.col("d"), lambda x, y: x * y), 7).alias("s"), (-F.col("near")).alias("n")).alias("t"))
    return scored.groupBy("vec_id").agg(F.max("t").alias("t")).select("vec_id", (-F.col("t.n")).alias("near"), F.col("t.s").alias("score"))


def _separable(name: str, tables: str, size: int, change, factor: str = "1"):
    """Both axes of the 8 x 8 images that vectors stand for, by one table w(o, i, w) in SQL; `change` gives the column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select("vec_id", change(spark, F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
        return rows.select("vec_id", F.posexplode("v").alias("o", "value")).select("vec_id", "o", F.round("value", 7).alias("value"))

    run.__name__ = name
    query(
        f"""WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), {tables}
SELECT vec_id, (r.o * {size} + c.o)::INT AS o, round(sum(x * r.w * c.w) * {factor}, 7) AS value FROM x JOIN w r ON r.i = x.i // 8 JOIN w c ON c.i = x.i % 8 GROUP BY ALL"""
    )(run)


def _resize_2d(spark: SparkSession, image):
    w = images.dense(arrays.resize_weights(spark, 8, 4), 4, 8)
    return images.changed(lambda x: images.resized(x, w, w), image, width=8)


def _blur_down(spark: SparkSession, image):
    w = images.blur_weights(8, 2)
    return images.changed(lambda x: images.resized(x, w, w), image, width=8)


def _up_filter_down(spark: SparkSession, image):
    k = np.outer([1, 3, 2, 1], [1, 3, 2, 1]) / 49 * 4
    return images.changed(lambda x: images.up_filter_down(x, k, up=2, pad=(2, 1)), image, width=8)


CUBIC_SQL = "CASE WHEN abs(d) <= 1 THEN 1.5 * abs(d) ** 3 - 2.5 * d * d + 1 WHEN abs(d) <= 2 THEN -0.5 * abs(d) ** 3 + 2.5 * d * d - 4 * abs(d) + 2 ELSE 0 END"
_separable(
    "resize_2d",
    f"""d AS (SELECT o.range AS o, p.range AS p, (o.range * 2 + 0.5::DOUBLE - p.range) / 2 AS d FROM range(0, 4) o, range(-8, 16) p),
k AS (SELECT o, least((p + 16) % 16, 15 - (p + 16) % 16) AS i, sum({CUBIC_SQL}) AS w FROM d GROUP BY ALL), w AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM k)""",
    4,
    _resize_2d,
)
_separable(
    "blur_downsample",
    """g AS (SELECT j.range AS j, exp(-(j.range * j.range) / 1.28::DOUBLE) AS g FROM range(-3, 4) j),
w AS (SELECT o.range AS o, least((o.range * 2 + j + 14) % 14, 14 - (o.range * 2 + j + 14) % 14) AS i, sum(g) / (SELECT sum(g) FROM g) AS w FROM range(0, 4) o, g GROUP BY ALL)""",
    4,
    _blur_down,
)
_separable(
    "up_filter_down",
    "w AS (SELECT o.range AS o, i.range AS i, [1, 2, 3, 1][k.range + 1] / 7::DOUBLE AS w FROM range(0, 16) o, range(0, 8) i, range(0, 4) k WHERE o.range + k.range - 2 = i.range * 2)",
    16,
    _up_filter_down,
    "4",
)


def _grown(name: str, side: int, change):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        image = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("image"))
        return image.select("vec_id", F.array_join(F.transform(change(F.col("image")), lambda x: x.cast("string")), ",").alias("image"))

    run.__name__ = name
    at = f"least(i // {side} % 14, 14 - i // {side} % 14) * 8 + least(i % {side} % 14, 14 - i % {side} % 14)"
    query(f"SELECT vec_id, array_to_string(list_transform(range(0, {side * side}), lambda i: floor(embedding[{at} + 1]::DOUBLE * 1000)::INT), ',') AS image FROM embeddings")(run)


_grown("pad_multiple", 10, lambda x: layout.pad_multiple(x, 8, 8, 5))
_grown("fit_square", 18, lambda x: layout.fit_square(x, 8, 8, 18))
