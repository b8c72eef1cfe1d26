"""Dataset plans over the driver's tables: a conversation is a clip and a turn a frame; a document stands for a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import arrays, layout, scalars
from quarrystone.operators import datasets
from quarrystone.plans.base import FILES_SQL, files, query, table

SEED = 5
CLIPS = "c AS (SELECT conv_id AS clip, count(*) AS n FROM conversations GROUP BY conv_id)"
SAMPLES = f"{CLIPS}, k AS (SELECT clip, i.range AS idx, n, printf('%d/%08d', clip, i.range) AS frame_key FROM c, range(0, 8) i WHERE i.range < n AND clip NOT IN (0, 11, 15, 20))"


def _draw(key: str, purpose: str, n: str) -> str:
    return f"(('0x' || substr(md5({key} || ':{SEED}:{purpose}'), 1, 8))::BIGINT % ({n}))"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("clip")).agg(F.count("*").alias("n"))
    return datasets.frame_samples(clips, "clip", "n", ["0", "11", "15", "20"])


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


@query(f"WITH {SAMPLES} SELECT clip, idx, frame_key, n AS n_frames FROM k")
def reds_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir)


@query(
    f"""WITH {SAMPLES}, i AS (SELECT *, 1 + {_draw('frame_key', 'interval', '2')} AS step FROM k), f AS (SELECT * FROM i WHERE n > 2 * step),
m AS (SELECT *, CASE WHEN idx >= step AND idx + step < n THEN idx ELSE step + {_draw('frame_key', 'centre', 'n - 2 * step')} END AS centre FROM f)
SELECT frame_key, step AS "interval", centre, CASE WHEN {_draw('frame_key', 'reverse', '2')} = 0 THEN concat_ws(',', centre + step, centre, centre - step) ELSE concat_ws(',', centre - step, centre, centre + step) END AS frames FROM m"""
)
def reds_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.centred_samples(_samples(spark, sf_dir), 3, [1, 2], SEED, reverse=True)
    return rows.select("frame_key", "interval", "centre", _joined("frames"))


@query(
    f"""WITH {SAMPLES}, i AS (SELECT *, 1 + {_draw('frame_key', 'interval', '2')} AS step FROM k), f AS (SELECT *, n - 3 * step AS last FROM i WHERE n - 3 * step >= 0),
m AS (SELECT *, CASE WHEN idx <= last THEN idx ELSE {_draw('frame_key', 'start', 'last + 1')} END AS "start" FROM f)
SELECT frame_key, step AS "interval", "start", concat_ws(',', "start", "start" + step, "start" + 2 * step) AS frames FROM m"""
)
def reds_recurrent_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.recurrent_samples(_samples(spark, sf_dir), 3, [1, 2], SEED)
    return rows.select("frame_key", "interval", "start", _joined("frames"))


KEYS = "k AS (SELECT DISTINCT printf('%05d/%04d', conv_id, turn) AS key FROM conversations)"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.format_string("%05d/%04d", "conv_id", "turn").alias("key")).distinct()


@query(f"WITH {KEYS}, r AS (SELECT key, {_draw('key', 'reverse', '2')} = 0 AS back FROM k) SELECT key, key || '/im4.png' AS target, array_to_string(list_transform(CASE WHEN back THEN [6, 5, 4, 3, 2] ELSE [2, 3, 4, 5, 6] END, lambda i: key || '/im' || i || '.png'), ',') AS inputs FROM r")
def vimeo_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.septuplets(_keys(spark, sf_dir), "key", 5, SEED, reverse=True).withColumn("inputs", F.array_join("inputs", ","))


@query(f"WITH {KEYS} SELECT key, key || '/im4.png' AS target, array_to_string(list_transform([1, 2, 3, 4, 5, 6, 7, 7, 6, 5, 4, 3, 2, 1], lambda i: key || '/im' || i || '.png'), ',') AS inputs FROM k")
def vimeo_recurrent_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.septuplets(_keys(spark, sf_dir), "key", 7, SEED, flip_sequence=True).withColumn("inputs", F.array_join("inputs", ","))


def _windows(name: str, padding: str, before: str, after: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("idx"))
        return datasets.test_windows(frames, "clip", "idx", 5, padding).withColumn("frames", _joined("frames"))

    run.__name__ = name
    at = f"CASE WHEN pos + o < 0 THEN {before} WHEN pos + o > last THEN {after} ELSE pos + o END"
    sql = f"""WITH f AS (SELECT conv_id AS clip, turn AS idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) - 1 AS last FROM conversations)
SELECT clip, idx, pos || '/' || (last + 1) AS label, (pos < 2 OR last - pos < 2)::INT AS border, array_to_string(list_transform([-2, -1, 0, 1, 2], lambda o: {at}), ',') AS frames FROM f"""
    query(sql)(run)


_windows("video_test_dataset", "reflection_circle", "pos + 2 - (pos + o)", "(pos - 2) - (pos + o - last)")
_windows("video_test_duf_dataset", "reflection", "-(pos + o)", "last * 2 - (pos + o)")


@query("WITH w AS (SELECT conv_id, count(*) AS n_frames, array_to_string(list(turn ORDER BY turn), ',') AS frames FROM conversations GROUP BY conv_id) SELECT conv_id AS clip, row_number() OVER (ORDER BY conv_id) - 1 AS \"index\", n_frames, frames FROM w")
def video_recurrent_test_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("idx"))
    return datasets.clip_folders(frames, "clip", "idx").withColumn("frames", _joined("frames"))


LATENTS = "l AS (SELECT printf('cache%d/%dpx/%06d.pt', vec_id % 3, CASE WHEN vec_id % 2 = 0 THEN 256 ELSE 512 END, vec_id // 4) AS path FROM embeddings)"


@query(f"WITH {LATENTS}, p AS (SELECT path, string_split(path, '/') AS s FROM l) SELECT a.s[1] AS cache, a.s[3] AS name, a.path AS lq_path, b.path AS gt_path FROM p a JOIN p b ON b.s[1] = a.s[1] AND b.s[3] = a.s[3] WHERE a.s[2] = '256px' AND b.s[2] = '512px'")
def latent_cache_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = F.when(F.col("vec_id") % 2 == 0, 256).otherwise(512)
    paths = table(spark, sf_dir, "embeddings").select(F.format_string("cache%d/%dpx/%06d.pt", F.col("vec_id") % 3, res, F.expr("vec_id div 4")).alias("path"))
    return datasets.latent_pairs(paths, 256, 512)


@query(
    f"""WITH {FILES_SQL}, g AS (SELECT doc_id, path, regexp_extract(path, '([^/]+)$', 1) AS file FROM files),
n AS (SELECT path AS gt_path, regexp_replace(file, '\\.[^.]+$', '') AS name, regexp_extract(file, '(\\.[^.]+)$', 1) AS suffix FROM g),
l AS (SELECT 'low/' || replace(file, '.', 'x4.') AS path, replace(file, '.', 'x4.') AS file FROM g WHERE doc_id % 7 <> 0)
SELECT n.gt_path, n.name, n.suffix, l.path AS lq_path FROM n LEFT JOIN l ON l.file = n.name || 'x4' || n.suffix"""
)
def paired_image_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = files(spark, sf_dir).select("doc_id", "path")
    lq = gt.where(F.col("doc_id") % 7 != 0).select(F.concat(F.lit("low/"), F.replace(F.element_at(F.split("path", "/"), -1), F.lit("."), F.lit("x4."))).alias("path"))
    return datasets.image_pairs(gt, lq, "{}x4")


def _coin(purpose: str) -> str:
    return f"{_draw('doc_id::VARCHAR', purpose, '2')} = 0"


@query(
    f"""WITH {FILES_SQL}, t AS (SELECT doc_id, height, width, height >= 3 AND width >= 3 AS fits FROM files), c AS (SELECT *, CASE WHEN fits THEN {_draw('doc_id::VARCHAR', 'top', 'greatest(height - 2, 1)')} END AS top, CASE WHEN fits THEN {_draw('doc_id::VARCHAR', 'left', 'greatest(width - 2, 1)')} END AS "left" FROM t)
SELECT doc_id, top, "left", top * 4 AS gt_top, "left" * 4 AS gt_left, CASE WHEN fits THEN 'ok' ELSE 'too_small' END AS crop_status, {_coin('hflip')} AS hflip, {_coin('vflip')} AS vflip, {_coin('transpose')} AS transpose FROM c"""
)
def training_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = datasets.crop_window(files(spark, sf_dir), "doc_id", SEED, "height", "width", 3, 4)
    return datasets.augmentation(rows, "doc_id", SEED).select("doc_id", "top", "left", "gt_top", "gt_left", "crop_status", "hflip", "vflip", "transpose")


@query(f"WITH {FILES_SQL} SELECT path, regexp_replace(path, '\\.[^./]+$', '') AS key FROM files WHERE lower(path) LIKE '%.png' AND doc_id % 3 <> 0")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    done = rows.where(F.col("doc_id") % 3 == 0).select(F.regexp_replace("path", r"\.[^./]+$", "").alias("key"))
    return datasets.pending_files(rows, done, ["png"]).select("path", "key")


@query(
    """WITH e AS (SELECT vec_id // 8 AS clip, vec_id, list_transform(range(0, 36), lambda i: embedding[i // 6 * 8 + i % 6 + 1]::DOUBLE) AS v FROM embeddings)
SELECT clip, array_to_string(list(vec_id ORDER BY vec_id), ',') AS names, round(sum(list_sum(list_transform(v, lambda x: (x * (vec_id % 8 + 1))::DECIMAL(28,12)))::DOUBLE), 6) AS weighted FROM e GROUP BY clip"""
)
def image_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of eight 8 x 8 images, cut to multiples of 3; every value counts in the sum, with its image's place as a weight."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("clip"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("image"), F.lit(8).alias("h"), F.lit(8).alias("w"))
    whole = datasets.stacked_clips(rows, "clip", "vec_id", "image", 8, 3, "h", "w")
    place = lambda k: F.get("names", k) % 8 + 1
    sums = F.transform("images", lambda v, k: arrays.exact_sum(F.transform(v, lambda x: x * place(k))))
    summed = whole.withColumn("weighted", F.round(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x.cast("double")), 6))
    return summed.withColumn("names", _joined("names")).select("clip", "names", "weighted")


@query("WITH s AS (SELECT doc_id, 2048 AS width, CASE WHEN doc_id % 5 = 0 THEN 2047 ELSE 2048 END AS height FROM documents) SELECT doc_id, t.i AS tile, t.x AS \"left\", t.y AS top, t.x + 512 AS \"right\", t.y + 512 AS bottom FROM s, (VALUES (1, 256, 256), (2, 1280, 256), (3, 256, 1280), (4, 1280, 1280)) t(i, x, y) WHERE height = 2048")
def collage_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(2048).alias("width"), F.when(F.col("doc_id") % 5 == 0, 2047).otherwise(2048).alias("height"))
    return rows.select("doc_id", F.inline(layout.tiles_of(F.col("width"), F.col("height"))))


V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _moved(name: str, n: int, index: str, change):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        image = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int"))
        return table(spark, sf_dir, "embeddings").select("vec_id", image.alias("image")).select("vec_id", F.array_join(F.transform(change(F.col("image")), lambda x: x.cast("string")), ",").alias("image"))

    run.__name__ = name
    query(f"WITH {V} SELECT vec_id, array_to_string(list_transform(range(0, {n}), lambda i: floor(e[{index} + 1] * 1000)::INT), ',') AS image FROM v")(run)


_moved("merge_blocks", 64, "((i // 32) * 2 + (i % 8) // 4) * 16 + (i // 8) % 4 * 4 + i % 4", lambda x: layout.merge_blocks(x, 8, 4))
_moved("pixel_unshuffle", 64, "((i % 16) // 4 * 2 + (i // 16) // 2) * 8 + (i % 4) * 2 + (i // 16) % 2", lambda x: layout.pixel_unshuffle(x, 8, 2))
_moved("crop_multiple", 36, "(i // 6) * 8 + i % 6", lambda x: layout.crop_multiple(x, 8, 8, 3))
_moved("channels_first", 64, "i % 16 * 4 + i // 16", lambda x: layout.channels_first(x, 4))
_moved("reorder_channels", 64, "i - i % 4 + [2, 1, 0, 3][i % 4 + 1]", lambda x: layout.reorder_channels(x, [2, 1, 0, 3]))
_moved("side_by_side", 128, "(CASE WHEN i % 16 < 8 THEN (i // 16) * 8 + i % 8 ELSE 63 - ((i // 16) * 8 + i % 8) END)", lambda x: layout.side_by_side(x, F.reverse(x), 8))


def _stepped(image):
    """A model that knows left from right: each pixel and its right neighbour, around the edge."""
    return layout.gather(image, lambda i, _: i - i % 8 + (i + 1) % 8)


def _summed(image):
    return layout.let(image, lambda x: F.zip_with(x, _stepped(x), lambda a, b: a + b))


#: Over all orientations the neighbours of the four sides count alike: four times the mean is a whole number.
SIDES = [f"e[i // 8 * 8 + (i + {k}) % 8 + 1]" for k in (1, 7)] + [f"e[(i // 8 + {k}) % 8 * 8 + i % 8 + 1]" for k in (1, 7)]


@query(f"WITH {V} SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda i: (4 * floor(e[i + 1] * 1000) + {' + '.join(f'floor({x} * 1000)' for x in SIDES)})::INT), ',') AS image FROM v")
def self_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int"))
    turned = F.transform(layout.orientations(F.col("image"), 8), _summed)
    found = table(spark, sf_dir, "embeddings").select("vec_id", image.alias("image")).select("vec_id", layout.ensemble(turned, 8).alias("mean"))
    return found.select("vec_id", F.array_join(F.transform("mean", lambda x: F.round(x * 4).cast("int").cast("string")), ",").alias("image"))



MEAN, DEV = "list_sum(list_transform({0}, lambda x: x::DECIMAL(28,12)))::DOUBLE / 64", "sqrt(list_sum(list_transform({0}, lambda x: ((x - {1}) * (x - {1}))::DECIMAL(28,12)))::DOUBLE / 63 + 1e-5::DOUBLE)"


@query(
    f"""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), m AS (SELECT *, {MEAN.format('a')} AS ma, {MEAN.format('b')} AS mb FROM p),
s AS (SELECT *, {DEV.format('a', 'ma')} AS sa, {DEV.format('b', 'mb')} AS sb FROM m) SELECT vec_id, i.range::INT AS dim, round((a[i.range + 1] - ma) / sa * sb + mb, 6) AS value FROM s, range(0, 64) i"""
)
def adaptive_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.select("vec_id", F.posexplode(layout.with_statistics_of(F.col("embedding"), F.col("b"))).alias("dim", "value")).withColumn("value", F.round("value", 6))


LEVEL = "least(floor(255::DOUBLE * (least(greatest(e[{0}] / 8, -0.02::DOUBLE), 0.02::DOUBLE) - -0.02::DOUBLE) / 0.04::DOUBLE), 254)::INT"


@query(f"WITH {V}, q AS (SELECT vec_id, i.range::INT AS pixel, {LEVEL.format('i.range + 1')} AS qx, {LEVEL.format('i.range + 33')} AS qy FROM v, range(0, 32) i) SELECT *, round(((qx + 0.5::DOUBLE) * 0.04::DOUBLE / 255 - 0.02::DOUBLE) * 8, 8) AS dx FROM q")
def flow_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda at: F.transform(F.slice("embedding", at, 32), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", layout.flow_levels(part(1), part(33), 8, 8).alias("q"))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip(F.col("q.dx").alias("qx"), F.col("q.dy").alias("qy"), layout.flow_of(F.col("q"), 8, 8)["dx"].alias("dx"))).alias("pixel", "z"))
    return rows.select("vec_id", "pixel", "z.qx", "z.qy", F.round("z.dx", 8).alias("dx"))


@query(f"WITH {V} SELECT vec_id, round(abs(e[1]), 6) AS red, round(abs(e[2]), 6) AS green, round(abs(e[3]), 6) AS blue FROM v")
def rgb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda k: F.abs(F.col("embedding")[k].cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.ycbcr(c(0), c(1), c(2)).alias("p")).select("vec_id", layout.rgb(F.col("p.y"), F.col("p.cb"), F.col("p.cr")).alias("q"))
    return rows.select("vec_id", *[F.round(f"q.{k}", 6).alias(k) for k in ("red", "green", "blue")])


@query(f"WITH {FILES_SQL} SELECT doc_id, 'out/' || regexp_replace(CASE WHEN starts_with(path, 'web/') THEN substr(path, 5) ELSE regexp_extract(path, '([^/]+)$', 1) END, '\\.[^./]+$', '') || '.npy' AS target, printf('%.2f MB', size_bytes / 1048576::DOUBLE) AS said FROM files")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", scalars.output_path(F.col("path"), "web", "out", ".npy").alias("target"), scalars.in_megabytes(F.col("size_bytes")).alias("said"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CASE event_id % 3 WHEN 0 THEN 'float16' WHEN 1 THEN 'bfloat16' ELSE 'float32' END AS kind FROM events")
def stamps_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, " Float 16").when(F.col("event_id") % 3 == 1, "torch.bfloat16")
    return table(spark, sf_dir, "events").select("event_id", scalars.time_stamp(F.col("ts")).alias("stamp"), scalars.dtype_name(said, ["float16", "bfloat16", "float32"], "float32").alias("kind"))
