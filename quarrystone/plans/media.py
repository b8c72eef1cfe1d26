"""Queries over stores, event files, names with alternatives, decoding with statuses, turned images, resized flow, online state."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import images, png
from quarrystone.operators import lookup, resizing
from quarrystone.operators.storage import shared_dir
from quarrystone.plans.base import query, table
from quarrystone.sources import events, keyvalue
from quarrystone.streaming import jobs, online


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, doc_id % 1000 // 100 = 1 AND doc_id < 1000 AS in_range FROM documents")
def kv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a key-value store, read back whole, and by a range of keys."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("%010d", "doc_id").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("value"))
    path = f"{shared_dir(spark)}/kv-{uuid.uuid4().hex}".removeprefix("file:")
    keyvalue.write_store(docs, path)
    some = keyvalue.read_store(spark, path, [(">=", "0000000100"), ("<", "0000000200")]).select("key", F.lit(True).alias("in_range"))
    rows = keyvalue.read_store(spark, path).join(some, "key", "left")
    return rows.select(F.col("key").cast("long").alias("doc_id"), F.sha2("value", 256).alias("sha"), F.coalesce("in_range", F.lit(False)).alias("in_range"))


@query("SELECT (event_id // 1000)::BIGINT AS log, event_id AS step, event_type AS tag, round(value::FLOAT::DOUBLE, 5) AS value, epoch_us(ts) AS wall_us, 'ok' AS status FROM events")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files of a training log, a thousand each, and their scalars read back."""
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("log"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("wall"), "event_id", "event_type", "value")
    found = events.parse_events(events.write_events(rows, "log", "wall", "event_id", "event_type", "value"), "log")
    return found.select("log", "step", "tag", F.round("value", 5).alias("value"), F.round(F.col("wall_time") * 1e6).cast("long").alias("wall_us"), "status")


NAMES_SQL = """asked AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN upper(source) WHEN 2 THEN source || ' X' WHEN 3 THEN 'nobody' END AS name FROM documents),
known AS (SELECT 0 AS registry, CASE n_nationkey % 3 WHEN 0 THEN 'src' WHEN 1 THEN 'SRC' ELSE 'src' END || n_nationkey || CASE n_nationkey % 3 WHEN 2 THEN '_x' ELSE '' END AS key, n_name AS spec FROM nation
  UNION ALL SELECT 1, 'src' || n_nationkey, 'auto ' || n_regionkey FROM nation UNION ALL SELECT 1, 'src' || n_nationkey, 'auto 9' FROM nation)"""


@query(
    f"""WITH {NAMES_SQL}, v AS (SELECT DISTINCT name, unnest([0, 1, 2, 3]) AS variant, unnest([name, lower(name), regexp_replace(trim(name), '[^\\w.-]', '_', 'g'), lower(regexp_replace(trim(name), '[^\\w.-]', '_', 'g'))]) AS key FROM asked WHERE name IS NOT NULL),
best AS (SELECT name, min({{'registry': registry, 'variant': variant, 'spec': spec}}) AS b FROM v JOIN known USING (key) GROUP BY name)
SELECT doc_id, a.name, b.spec AS spec, b.registry::INT AS registry FROM asked a LEFT JOIN best USING (name)"""
)
def sample_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved through four spellings and two registries."""
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.col("source")).when(k == 1, F.upper("source")).when(k == 2, F.concat("source", F.lit(" X"))).when(k == 3, "nobody")
    asked = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    nation = table(spark, sf_dir, "nation")
    n = F.col("n_nationkey")
    first = nation.select(F.concat(F.when(n % 3 == 1, "SRC").otherwise("src"), n.cast("string"), F.when(n % 3 == 2, "_x").otherwise("")).alias("key"), F.col("n_name").alias("spec"))
    auto = nation.select(F.concat(F.lit("src"), n.cast("string")).alias("key"), F.explode(F.array(F.concat(F.lit("auto "), F.col("n_regionkey").cast("string")), F.lit("auto 9"))).alias("spec"))
    return lookup.resolved(asked, "name", [first, auto], "key", "spec").select("doc_id", "name", "spec", "registry")


@query(
    """WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: round(least(greatest(v + 0.5, 0), 1) * 255)) AS e FROM embeddings)
SELECT vec_id, CASE vec_id % 6 WHEN 1 THEN 'file is truncated' WHEN 2 THEN 'skipped: palette transparency (bytes)' WHEN 3 THEN 'no PNG file' WHEN 4 THEN 'too many pixels' ELSE 'ok' END AS status,
  CASE WHEN vec_id % 6 IN (0, 5) THEN 8 END::INT AS width, CASE vec_id % 6 WHEN 0 THEN list_sum(e) * 3 WHEN 5 THEN list_sum(list_transform(e, lambda v: floor(v / 64) * 10)) * 3 END::BIGINT AS total FROM x"""
)
def resize_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images as files of which some are broken, in every batch; what decoding says of each, and the sum of what was read."""

    @F.pandas_udf("binary")
    def file(number: pd.Series, image: pd.Series) -> pd.Series:
        def one(k, x):
            plane = np.asarray(x, int).reshape(8, 8)
            greys = np.arange(4)[:, None].repeat(3, 1) * 10
            return [png.encoded(plane), png.encoded(plane)[:-30], png.encoded(plane // 64, greys, b"\x80"), b"\0" * 40, png.encoded(np.zeros((20, 20))), png.encoded(plane // 64, greys, b"\xff\x00")][k % 6]

        return pd.Series([one(*r) for r in zip(number, image, strict=True)], dtype=object)

    @F.pandas_udf("long")
    def total(data: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else int(png.decoded(bytes(d))[0].sum()) for d in data], dtype="Int64")

    level = lambda x: F.round(F.least(F.greatest(x.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    made = table(spark, sf_dir, "embeddings").select("vec_id", file("vec_id", F.transform("embedding", level)).alias("content"))
    found = resizing.resize_files(made, 8, "vec_id", most_pixels=100)
    return found.select("vec_id", "status", "width", total("image").alias("total"))


@query(
    """WITH p AS (SELECT o, (o % 8 - 4) * cos(radians(30)) - (o // 8 - 4) * sin(radians(30)) + 4 AS sx, (o % 8 - 4) * sin(radians(30)) + (o // 8 - 4) * cos(radians(30)) + 4 AS sy FROM range(0, 64) r(o)),
t AS (SELECT o, floor(sy)::INT + a AS y, floor(sx)::INT + b AS x, (1 - abs(sy - floor(sy) - a)) * (1 - abs(sx - floor(sx) - b)) AS w FROM p, range(0, 2) q(a), range(0, 2) s(b)),
x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
s AS (SELECT vec_id, o, sum(v * w) AS v FROM x JOIN t ON t.y BETWEEN 0 AND 7 AND t.x BETWEEN 0 AND 7 AND x.i = t.y * 8 + t.x GROUP BY ALL)
SELECT e.vec_id, o.o::INT AS o, round(coalesce(s.v, 0), 7) AS value FROM embeddings e CROSS JOIN range(0, 64) o(o) LEFT JOIN s ON s.vec_id = e.vec_id AND s.o = o.o"""
)
def rotated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images turned by 30 degrees about their centre, black outside."""
    turned = images.changed(lambda x: images.rotated(x, 30.0), F.transform("embedding", lambda x: x.cast("double")), width=8)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(turned).alias("o", "value"))
    return rows.select("vec_id", "o", F.round("value", 7).alias("value"))


def _half_sql(n_in: int, n_out: int) -> str:
    at = f"greatest((o + 0.5::DOUBLE) * {n_in} / {n_out} - 0.5, 0)"
    return f"(SELECT o, least(floor({at})::INT + a, {n_in - 1}) AS i, sum(1 - abs({at} - floor({at}) - a)) AS w FROM range(0, {n_out}) r(o), range(0, 2) s(a) GROUP BY ALL)"


@query(
    f"""WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, ((r.o * 6 + c.o) * 2 + x.i % 2)::INT AS o, round(sum(v * r.w * c.w) * CASE x.i % 2 WHEN 0 THEN 6 / 8::DOUBLE ELSE 7 / 4::DOUBLE END, 7) AS value
FROM x JOIN {_half_sql(4, 7)} r ON r.i = x.i // 16 JOIN {_half_sql(8, 6)} c ON c.i = x.i % 16 // 2 GROUP BY vec_id, r.o, c.o, x.i % 2"""
)
def flow_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 x 8 flow fields brought to 7 x 6, their vectors with them."""
    grown = images.changed(lambda x: images.flow_resized(x.reshape(4, 8, 2), 7, 6), F.transform("embedding", lambda x: x.cast("double")), width=16)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(grown).alias("o", "value"))
    return rows.select("vec_id", "o", F.round("value", 7).alias("value"))


@query("SELECT event_type AS key, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS best, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE / count(*) * greatest(200000 - count(*), 0), 2) AS eta FROM events WHERE value IS NOT NULL GROUP BY 1")
def running_mean_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online means with the time left, and the last of each key."""
    stream = jobs.open_stream(spark, f"{sf_dir}/events.parquet")
    out = jobs.run_to_end(online.running_means(stream, "event_type", "value", "ts", 200_000), "update", "means")
    last = out.groupBy("key").agg(F.max_by(F.struct("n", "mean", "best", "eta"), "n").alias("l"))
    return last.select("key", "l.n", F.round("l.mean", 6).alias("mean"), "l.best", F.round("l.eta", 2).alias("eta"))


@query()
def ordered_pool_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool whose order is that of events; tests hold it against the same by hand."""
    stream = jobs.open_stream(spark, f"{sf_dir}/events.parquet")
    return jobs.run_to_end(online.ordered_pool(stream, "event_id", "ts", "1 hour", 8, 32, 7), "append", "pool")
