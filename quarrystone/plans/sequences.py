"""Sequence queries: a conversation is a clip, a turn a frame; events are a scalar log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import curate, sequence
from quarrystone.plans.base import query, table


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("idx"), F.length("text").alias("size"), "role")


FRAMES = "f AS (SELECT conv_id AS clip, turn AS idx, length(text)::INT AS size, role, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"
PAD = {
    "replicate": ("0", "last"),
    "reflection": ("-i", "last * 2 - i"),
    "reflection_circle": ("idx + 2 - i", "(idx - 2) - (i - last)"),
    "circle": ("i + 5", "i - 5"),
}


def _pad_sql(mode: str) -> str:
    before, after = PAD[mode]
    return f"WITH {FRAMES}, w AS (SELECT clip, idx, last, o.range::INT AS \"offset\", idx + o.range AS i FROM f, range(-2, 3) o) SELECT clip, idx, \"offset\", CASE WHEN i < 0 THEN {before} WHEN i > last THEN {after} ELSE i END AS source FROM w"


def _pad(mode: str):
    def frame_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sequence.padded_windows(_frames(spark, sf_dir), "clip", "idx", 5, mode)

    frame_pad.__name__ = f"frame_pad_{mode}"
    return query(_pad_sql(mode))(frame_pad)


for _mode in PAD:
    _pad(_mode)


@query(f"WITH {FRAMES}, n AS (SELECT clip, idx, row_number() OVER (PARTITION BY clip ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY clip) AS size FROM f) SELECT clip, idx, pos, size, pos || '/' || size AS label, (pos < 2 OR size - 1 - pos < 2)::INT AS border FROM n")
def frame_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.positions(_frames(spark, sf_dir).select("clip", "idx"), "clip", "idx", 2)


@query(f"WITH {FRAMES} SELECT a.clip, a.idx, o.unnest AS \"offset\", b.size AS near_size FROM f a, unnest([-2, -1, 1, 2]) o JOIN f b ON b.clip = a.clip AND b.idx = a.idx + o.unnest")
def neighbor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.neighbours(_frames(spark, sf_dir), "clip", "idx", [-2, -1, 1, 2], ["size"])


@query(f"WITH {FRAMES}, s AS (SELECT clip, idx, last, 1 + clip % 2 AS stride FROM f) SELECT clip, idx, stride, array_to_string(list_transform(range(0, 3), lambda k: least(idx, last - 2 * stride) + k * stride), ',') AS frames FROM s WHERE last >= 2 * stride")
def neighbor_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.strided_windows(_frames(spark, sf_dir).select("clip", "idx"), "clip", "idx", 3, 1 + F.col("clip") % 2)
    return rows.withColumn("frames", F.array_join(F.transform("frames", lambda x: x.cast("string")), ","))


@query("WITH n AS (SELECT conv_id, 1 + 2 * (count(*) % 4) AS frames FROM conversations GROUP BY conv_id) SELECT conv_id, frames, array_to_string(list_transform(range(0, frames), lambda i: i + (9 - frames) // 2), ',') AS numbers FROM n")
def centred_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1, 3, 5 or 7 frames around the centre, as many as a conversation's turns say."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((1 + 2 * (F.count("*") % 4)).alias("frames"))
    return rows.select("conv_id", "frames", F.array_join(F.transform(sequence.centred_frames(F.col("frames")), lambda x: x.cast("string")), ",").alias("numbers"))


@query("WITH s AS (SELECT conv_id, list(length(text)::INT ORDER BY turn) AS v FROM conversations GROUP BY conv_id) SELECT conv_id, array_to_string(list_concat(v, list_reverse(v)), ',') AS flipped FROM s")
def sequence_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("s"))
    values = F.transform("s", lambda x: x["n"].cast("string"))
    return clips.select("conv_id", F.array_join(sequence.flipped(values), ",").alias("flipped"))


@query(
    """WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role = 'assistant')
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.pos, a.pos) AS pos, u.turn, a.turn AS other_turn FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.pos = a.pos"""
)
def positional_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    side = lambda role: rows.where(F.col("role") == role).select("conv_id", "turn")
    return curate.positional_pairs(side("user"), side("assistant"), ["turn"], ["conv_id"])


@query("WITH n AS (SELECT o_orderkey, 1 + o_orderkey % 5 AS n FROM orders) SELECT o_orderkey AS clip, i.range::INT AS idx, o_orderkey || '/' || lpad(i.range::VARCHAR, 8, '0') AS frame_key FROM n, range(0, 5) i WHERE i.range < n.n")
def frame_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.frame_keys(table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 5).alias("n")), "o_orderkey", "n")


@query("WITH n AS (SELECT event_id, ts, value::DECIMAL(20,6) AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events) SELECT event_id, round((sum(v) OVER w)::DOUBLE / count(*) OVER w, 6) AS mean FROM n WINDOW w AS (PARTITION BY pos // 201 ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def avg_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return sequence.resetting_mean(rows, ["ts", "event_id"], "value", 200).select("event_id", (F.round(F.col("mean") * 1e6) / 1e6).alias("mean"))


@query(
    """WITH RECURSIVE n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
s AS (SELECT user_id, pos, value AS y FROM n WHERE pos = 0 UNION ALL SELECT n.user_id, n.pos, s.y * 0.9::DOUBLE + (1 - 0.9::DOUBLE) * n.value FROM s JOIN n ON n.user_id = s.user_id AND n.pos = s.pos + 1)
SELECT user_id, pos, round(y + 1e-9, 4) AS smooth FROM s"""
)
def iir_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return sequence.smoothed(rows, ["user_id"], ["ts", "event_id"], "value", 0.9).select("user_id", "pos", F.round(F.col("smooth") + 1e-9, 4).alias("smooth"))


@query("WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events) SELECT event_id, round((us - (SELECT min(us) FROM e)) / 1e6 / nullif(event_id, 0) * ((SELECT max(event_id) FROM e) - event_id), 3) AS eta FROM e")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.functions.scalars import eta_seconds

    rows = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    ends = rows.agg(F.min("us").alias("first"), F.max("event_id").alias("total"))
    left = eta_seconds((F.col("us") - F.col("first")) / 1e6, F.col("event_id"), F.col("total"))
    return rows.crossJoin(F.broadcast(ends)).select("event_id", F.round(left, 3).alias("eta"))  # one row


@query("SELECT conv_id, count(*) AS frames FROM conversations GROUP BY conv_id")
def rows_per_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("frames"))


@query("SELECT min(n) AS common FROM (SELECT count(*) AS n FROM conversations GROUP BY role)")
def min_common_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n")).agg(F.min("n").alias("common"))


@query("SELECT i.range AS i, s.sample FROM range(0, 1000) i JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, r_name AS sample FROM region) s ON s.pos = i.range % (SELECT count(*) FROM region)")
def cycle_to_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrystone.operators.ordering import numbered

    samples = numbered(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("sample")), "r_regionkey")
    n = samples.count()
    ids = spark.range(1000).select(F.col("id").alias("i"), F.pmod("id", F.lit(max(n, 1))).alias("pos"))
    return ids.join(samples.select("pos", "sample"), "pos").select("i", "sample")


@query("SELECT conv_id, turn FROM conversations WHERE conv_id >= 20 AND conv_id < 30")
def partition_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("conv_id between 20 and 29").select("conv_id", "turn")


@query("SELECT conv_id, turn FROM conversations WHERE NOT (conv_id >= 20 AND conv_id < 30)")
def partition_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("not conv_id between 20 and 29").select("conv_id", "turn")
