"""Samples of image datasets, values and all: a vector is an image of 4 x 4 pixels in four channels, 8 x 8 grey pixels, or a latent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import samples
from quarrystone.plans.base import query, table
from quarrystone.plans.datasets import SEED, _draw

COIN = {k: f"{_draw('vec_id', k, '2')} = 0" for k in ("hflip", "vflip", "transpose")}
V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.lit(4).alias("four"), F.lit(8).alias("eight"))


def _values(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """A row for each value of the one sample column, which comes last."""
    *kept, last = columns
    return rows.select(*kept, F.posexplode(last).alias("i", "value")).withColumn("value", F.round("value", 6))


@query(f"WITH {V} SELECT vec_id, i::INT AS i, round(e[i % 16 * 4 + [2, 1, 0, 3][i // 16 + 1] + 1] / 2, 6) AS value FROM v, range(0, 64) r(i)")
def single_image_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(samples.single_images(_vectors(spark, sf_dir), "e", "four", "four", 4, [2, 1, 0, 3], unit=2.0), "vec_id", "lq")


@query(f"WITH {V} SELECT vec_id, hflip, i::INT AS i, round((e[(i % 16 // 4 * 4 + CASE WHEN hflip THEN 3 - i % 4 ELSE i % 4 END) * 4 + [2, 1, 0, 3][i // 16 + 1] + 1] - [0.1, 0.2, 0.3, 0.4][i // 16 + 1]::DOUBLE) / 0.5, 6) AS value FROM (SELECT *, {COIN['hflip']} AS hflip FROM v), range(0, 64) r(i)")
def ffhq_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.face_images(_vectors(spark, sf_dir), "vec_id", "e", "four", "four", 4, SEED, [2, 1, 0, 3], [0.1, 0.2, 0.3, 0.4], [0.5] * 4, unit=1.0)
    return _values(rows, "vec_id", "hflip", "gt")


@query(
    f"""WITH {V}, d AS (SELECT *, {COIN['hflip']} AS hf, {COIN['vflip']} AS vf, {COIN['transpose']} AS tr, {_draw('vec_id', 'top', '2')} AS t, {_draw('vec_id', 'left', '2')} AS l FROM v WHERE vec_id % 7 <> 0),
p AS (SELECT vec_id, e, hf, vf, tr, t, l, k, s, i, CASE WHEN tr THEN i % s ELSE i // s END AS y, CASE WHEN tr THEN i // s ELSE i % s END AS x FROM d, (VALUES ('gt', 6), ('lq', 3)) q(k, s), range(0, 36) r(i) WHERE i < s * s)
SELECT vec_id, k AS side, i::INT AS i, round(e[(CASE k WHEN 'gt' THEN 1 ELSE 2 END * (t * CASE k WHEN 'gt' THEN 2 ELSE 1 END + CASE WHEN vf THEN s - 1 - y ELSE y END)) * 8
  + CASE k WHEN 'gt' THEN 1 ELSE 2 END * (l * CASE k WHEN 'gt' THEN 2 ELSE 1 END + CASE WHEN hf THEN s - 1 - x ELSE x END) + 1], 6) AS value, 'ok' AS crop_status FROM p
UNION ALL SELECT vec_id, 'none', NULL, NULL, 'scale_mismatch' FROM v WHERE vec_id % 7 = 0"""
)
def paired_patch_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 targets with inputs of every other pixel: patches of 6 and 3. Every seventh target says that it is larger than it is."""
    half = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get("e", (F.floor(i / 4) * 16 + i % 4 * 2).cast("int")))
    rows = _vectors(spark, sf_dir).withColumns({"lq": half, "gt_width": F.when(F.col("vec_id") % 7 == 0, 9).otherwise(8)})
    cut = samples.paired_patches(rows, "vec_id", "lq", "e", "four", "four", "eight", "gt_width", 1, 3, 2, SEED, unit=1.0)
    sides = F.when(F.col("crop_status") == "ok", F.array(F.struct(F.lit("lq").alias("side"), F.col("lq_patch").alias("v")), F.struct(F.lit("gt").alias("side"), F.col("gt_patch").alias("v")))).otherwise(F.array(F.struct(F.lit("none").alias("side"), F.lit(None).cast("array<double>").alias("v"))))
    each = cut.select("vec_id", "crop_status", F.explode(sides).alias("s")).select("vec_id", "crop_status", "s.side", F.posexplode_outer("s.v").alias("i", "value"))
    return each.withColumn("value", F.round("value", 6))


@query(
    f"""WITH {V}, d AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 4 END AS h, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 16 END AS w, {COIN['hflip']} AS hf, {COIN['vflip']} AS vf, {COIN['transpose']} AS tr FROM v),
s AS (SELECT *, CASE WHEN tr THEN w ELSE h END AS hh, CASE WHEN tr THEN h ELSE w END AS ww FROM d),
t AS (SELECT *, {_draw('vec_id', 'top', 'greatest(hh - 9, 1)')} AS t, {_draw('vec_id', 'left', 'greatest(ww - 9, 1)')} AS l FROM s),
a AS (SELECT *, least((t + i // 10) % (2 * hh - 2), 2 * hh - 2 - (t + i // 10) % (2 * hh - 2)) AS y, least((l + i % 10) % (2 * ww - 2), 2 * ww - 2 - (l + i % 10) % (2 * ww - 2)) AS x FROM t, range(0, 100) r(i)),
b AS (SELECT *, CASE WHEN tr THEN x ELSE y END AS r, CASE WHEN tr THEN y ELSE x END AS c FROM a)
SELECT vec_id, i::INT AS i, round(e[CASE WHEN vf THEN h - 1 - r ELSE r END * w + CASE WHEN hf THEN w - 1 - c ELSE c END + 1], 6) AS value FROM b"""
)
def degradation_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 and 4 x 16 images turned, extended or cut to 10 x 10. Their plans are `degradation_plan`'s."""
    even = F.col("vec_id") % 2 == 0
    rows = _vectors(spark, sf_dir).withColumns({"h": F.when(even, 8).otherwise(4), "w": F.when(even, 8).otherwise(16)})
    return _values(samples.degradation_samples(rows, "vec_id", "e", "h", "w", 1, SEED, side=10, unit=1.0), "vec_id", "gt")


@query(
    f"""WITH {V}, p AS (SELECT a.vec_id, b.e[1:16] AS lq, a.e AS gt FROM v a JOIN v b ON b.vec_id = a.vec_id + 1), d AS (SELECT *, {COIN['hflip']} AS hf, {COIN['vflip']} AS vf FROM p),
q AS (SELECT vec_id, 'lq' AS side, i, lq[i // 4 * 4 + CASE WHEN vf THEN 1 - i % 4 // 2 ELSE i % 4 // 2 END * 2 + CASE WHEN hf THEN 1 - i % 2 ELSE i % 2 END + 1] AS x, i // 4 AS c FROM d, range(0, 16) r(i)
  UNION ALL SELECT vec_id, 'gt', i, gt[i // 16 * 16 + CASE WHEN vf THEN 3 - i % 16 // 4 ELSE i % 16 // 4 END * 4 + CASE WHEN hf THEN 3 - i % 4 ELSE i % 4 END + 1], i // 16 FROM d, range(0, 64) r(i))
SELECT vec_id, side, i::INT AS i, round((x - [0.1, 0.2, 0.3, 0.4][c + 1]::DOUBLE) / [1, 2, 4, 8][c + 1], 6) AS value FROM q"""
)
def paired_latent_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latents of 4 x 2 x 2 beside their targets of 4 x 4 x 4."""
    v = _vectors(spark, sf_dir).select("vec_id", "e")
    rows = v.withColumnRenamed("e", "gt").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.slice("e", 1, 16).alias("lq")), "vec_id")
    made = samples.paired_latents(rows, "vec_id", "lq", "gt", (4, 2, 2), 2, SEED, mean=[0.1, 0.2, 0.3, 0.4], std=[1.0, 2.0, 4.0, 8.0])
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_latent").alias("v")) for s in ("lq", "gt")])
    each = made.select("vec_id", F.explode(sides).alias("s")).select("vec_id", "s.side", F.posexplode("s.v").alias("i", "value"))
    return each.withColumn("value", F.round("value", 6))


@query(
    """WITH c AS (SELECT DISTINCT conv_id AS clip FROM conversations), n AS (SELECT clip, row_number() OVER (ORDER BY clip) - 1 AS n, count(*) OVER () AS total FROM c)
SELECT clip, 'gt/' || clip || '/im4.png' AS gt_path, array_to_string(list_transform(range(2, 7), lambda k: 'lq/' || clip || '/im' || k || '.png'), ',') AS lq_paths, 'vimeo90k' AS folder, n || '/' || total AS idx, 0 AS border, 'lq/' || clip || '/im4.png' AS lq_path FROM n"""
)
def vimeo_test_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip")).distinct()
    return samples.septuplet_tests(clips, "clip", 5, "gt", "lq").withColumn("lq_paths", F.array_join("lq_paths", ","))
