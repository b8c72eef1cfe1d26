"""Degradation, colour JPEG and scores over images that embeddings stand for: 12 vectors make 16 x 16 pixels in three colours."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import degrade, images, resample
from quarrystone.operators import degradation, niqe, scoring
from quarrystone.operators.storage import shared_dir
from quarrystone.plans.base import query, table
from quarrystone.plans.images import CUBIC_SQL


def _levels(spark: SparkSession, sf_dir: str, vectors: int) -> DataFrame:
    """image_id, v: 0..255 levels of as many vectors on end; incomplete images go."""
    level = lambda x: F.round(F.least(F.greatest(x.cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)) * 255)
    rows = table(spark, sf_dir, "embeddings").select((F.expr(f"vec_id div {vectors}")).alias("image_id"), F.struct("vec_id", F.transform("embedding", level).alias("e")).alias("s"))
    whole = rows.groupBy("image_id").agg(F.array_sort(F.collect_list("s")).alias("s")).where(F.size("s") == vectors)
    return whole.select("image_id", F.flatten(F.transform("s", lambda x: x["e"])).alias("v"))


def _colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, image: 16 x 16 pixels, red, green and blue beside each other."""
    interleaved = F.transform(F.sequence(F.lit(0), F.lit(767)), lambda k: F.element_at("v", (k % 3 * 256 + F.floor(k / 3) + 1).cast("int")))
    return _levels(spark, sf_dir, 12).select("image_id", interleaved.alias("image"))


def _seed_sql(step: str) -> str:
    return f"(CAST('0x' || md5(vec_id || ':5:{step}')[1:8] AS BIGINT) / 4294967296::DOUBLE)"


def _choice_sql(u: str, values: tuple[str, ...], weights: tuple[float, ...]) -> str:
    at, cases = 0.0, []
    for v, w in list(zip(values, weights, strict=True))[:-1]:
        at += w
        cases.append(f"WHEN {u} < {at / sum(weights)}::DOUBLE THEN '{v}'")
    return f"CASE {' '.join(cases)} ELSE '{values[-1]}' END"


def _between_sql(u: str, low, high) -> str:
    return f"({low}::DOUBLE + {u} * ({high}::DOUBLE - {low}::DOUBLE))"


def _plan_sql() -> str:
    """The plan's columns from the same digests, with the recipe's numbers written out."""
    parts, shown = [], []
    for n, s in enumerate(degradation.Recipe().stages, 1):
        u = lambda step: _seed_sql(f"stage{n}.{step}")  # noqa: E731, B023
        kind = f"CASE WHEN {u('sinc')} < {s.sinc}::DOUBLE THEN 'sinc' ELSE {_choice_sql(u('kind'), degradation.KINDS, s.kinds)} END"
        size = f"[7, 9, 11, 13, 15, 17, 19, 21][floor({u('size')} * 8)::INT + 1]"
        low, high = (f"CASE WHEN starts_with({kind}, 'plateau') THEN {s.beta_plateau[k]} ELSE {s.beta_generalized[k]} END" for k in (0, 1))
        parts += [
            f"{kind} AS kind{n}",
            f"{size} AS size{n}",
            f"{_between_sql(u('sigma_x'), *s.sigma)} AS sigma_x{n}",
            f"{_between_sql(u('sigma_y'), *s.sigma)} AS sigma_y{n}",
            f"{_between_sql(u('theta'), -math.pi, math.pi)} AS theta{n}",
            f"CASE WHEN {u('side')} < 0.5 THEN {_between_sql(u('beta'), f'({low})', 1)} ELSE {_between_sql(u('beta'), 1, f'({high})')} END AS beta{n}",
            f"{_between_sql(u('cutoff'), f'(CASE WHEN {size} < 13 THEN pi() / 3 ELSE pi() / 5 END)', 'pi()')} AS cutoff{n}",
            f"{u('blur')} < {s.blur}::DOUBLE AS blur{n}",
            f"{_choice_sql(u('way'), ('up', 'down', 'keep'), s.ways)} AS way{n}",
            f"CASE way{n} WHEN 'up' THEN {_between_sql(u('scale'), 1, s.resize[1])} WHEN 'down' THEN {_between_sql(u('scale'), s.resize[0], 1)} ELSE 1 END AS scale{n}",
            f"['area', 'bilinear', 'bicubic'][floor({u('mode')} * 3)::INT + 1] AS mode{n}",
            f"CASE WHEN {u('noise')} < {s.gaussian}::DOUBLE THEN 'gaussian' ELSE 'poisson' END AS noise{n}",
            f"CASE WHEN noise{n} = 'gaussian' THEN {_between_sql(u('level'), *s.noise)} ELSE {_between_sql(u('level'), *s.poisson)} END AS level{n}",
            f"{u('grey')} < {s.grey}::DOUBLE AS grey{n}",
            f"{_between_sql(u('quality'), *s.quality)} AS quality{n}",
        ]
    u = lambda step: _seed_sql(f"last.{step}")
    parts += [
        f"{u('sinc')} < {degradation.Recipe().last_sinc}::DOUBLE AS last_sinc",
        f"[7, 9, 11, 13, 15, 17, 19, 21][floor({u('size')} * 8)::INT + 1] AS last_size",
        f"{_between_sql(u('cutoff'), 'pi() / 3', 'pi()')} AS last_cutoff",
        f"{u('order')} < 0.5 AS filter_first",
        f"['area', 'bilinear', 'bicubic'][floor({u('mode')} * 3)::INT + 1] AS last_mode",
    ]
    for p in parts:
        name = p.rsplit(" AS ", 1)[1]
        real = name.rstrip("12") in ("sigma_x", "sigma_y", "theta", "beta", "cutoff", "scale", "level", "quality") or name == "last_cutoff"
        shown.append(f"round({name}::DOUBLE, 9) AS {name}" if real else name)
    return f"SELECT vec_id, {', '.join(shown)} FROM (SELECT vec_id, {', '.join(parts)} FROM embeddings)"


@query(_plan_sql())
def degradation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is drawn for each image, as columns."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", degradation.plan(F.col("vec_id"), 5).alias("p"))
    out: list[Column] = [F.col("vec_id")]
    for n in (1, 2):
        stage = F.col("p.stages")[n - 1]
        kernel, resize, noise = stage["kernel"], stage["resize"], stage["noise"]
        out += [kernel["kind"].alias(f"kind{n}"), kernel["size"].alias(f"size{n}")]
        out += [F.round(kernel[c], 9).alias(f"{c}{n}") for c in ("sigma_x", "sigma_y", "theta", "beta", "cutoff")]
        out += [stage["blur"].alias(f"blur{n}"), resize["way"].alias(f"way{n}"), F.round(resize["scale"], 9).alias(f"scale{n}"), resize["mode"].alias(f"mode{n}")]
        out += [noise["kind"].alias(f"noise{n}"), F.round(noise["level"], 9).alias(f"level{n}"), noise["grey"].alias(f"grey{n}"), F.round(stage["quality"], 9).alias(f"quality{n}")]
    last = F.col("p.last")
    out += [last["sinc"].alias("last_sinc"), last["size"].alias("last_size"), F.round(last["cutoff"], 9).alias("last_cutoff"), last["filter_first"].alias("filter_first"), last["mode"].alias("last_mode")]
    return rows.select(*out)


@query()
def degraded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images through the whole of their plans, half as large; tests hold it against the steps by hand."""
    rows = _colour(spark, sf_dir).withColumns({"h": F.lit(16), "w": F.lit(16)})
    return degradation.degraded(rows, "image_id", "image", "h", "w", 5, scale=2).select("image_id", "status", "lq_height", "lq_width", "lq")


LUMA_SQL = str(images.LUMA.ravel().tolist())
CORNER_SQL = str(degrade.CHROMA_CORNER.ravel().tolist())


@query(
    f"""WITH v AS (SELECT vec_id // 12 AS image_id, vec_id % 12 // 4 AS c, vec_id % 4 * 64 + i AS p, round(least(greatest(embedding[i + 1]::DOUBLE + 0.5, 0), 1) * 255) AS v
  FROM embeddings, range(0, 64) r(i) WHERE vec_id // 12 IN (SELECT vec_id // 12 FROM embeddings GROUP BY 1 HAVING count(*) = 12)),
px AS (SELECT image_id, p // 16 AS y, p % 16 AS x, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b FROM v GROUP BY ALL),
planes AS (SELECT image_id, 0 AS c, y, x, 0.299 * r + 0.587 * g + 0.114 * b AS v FROM px
  UNION ALL SELECT image_id, 1, y // 2, x // 2, avg(-0.168736 * r - 0.331264 * g + 0.5 * b + 128) FROM px GROUP BY ALL
  UNION ALL SELECT image_id, 2, y // 2, x // 2, avg(0.5 * r - 0.418688 * g - 0.081312 * b + 128) FROM px GROUP BY ALL),
d AS (SELECT u, k, sqrt(CASE WHEN u = 0 THEN 0.125 ELSE 0.25 END::DOUBLE) * cos((2 * k + 1) * u * pi() / 16) AS w FROM range(0, 8) a(u), range(0, 8) b(k)),
f1 AS (SELECT image_id, c, y // 8 AS br, x // 8 AS bc, u, x % 8 AS x, sum((v - 128) * w) AS v FROM planes JOIN d ON k = y % 8 GROUP BY ALL),
f2 AS (SELECT image_id, c, br, bc, f1.u, d.u AS z, sum(v * w) AS v FROM f1 JOIN d ON d.k = f1.x GROUP BY ALL),
t AS (SELECT *, CASE WHEN c = 0 THEN {LUMA_SQL}[z * 8 + u + 1] WHEN u < 4 AND z < 4 THEN {CORNER_SQL}[u * 4 + z + 1] ELSE 99 END
  * CASE WHEN 30 + image_id % 5 * 15 < 50 THEN 5000 / (30 + image_id % 5 * 15)::DOUBLE ELSE 200 - 2 * (30 + image_id % 5 * 15) END / 100::DOUBLE AS q FROM f2),
b1 AS (SELECT image_id, c, br, bc, d.k AS y, z, sum(round_even(v / q, 0) * q * w) AS v FROM t JOIN d ON d.u = t.u GROUP BY ALL),
b2 AS (SELECT image_id, c, br * 8 + y AS y, bc * 8 + d.k AS x, sum(v * w) + 128 AS v FROM b1 JOIN d ON d.u = b1.z GROUP BY ALL),
m AS (SELECT l.image_id, (l.y * 16 + l.x) * 3 AS i, l.v AS y, cb.v - 128 AS cb, cr.v - 128 AS cr FROM b2 l JOIN b2 cb ON cb.image_id = l.image_id AND cb.c = 1 AND cb.y = l.y // 2 AND cb.x = l.x // 2
  JOIN b2 cr ON cr.image_id = l.image_id AND cr.c = 2 AND cr.y = l.y // 2 AND cr.x = l.x // 2 WHERE l.c = 0)
SELECT image_id, (i + k)::INT AS i, round(least(greatest(y + CASE k WHEN 0 THEN 1.402 * cr WHEN 1 THEN -0.344136 * cb - 0.714136 * cr ELSE 1.772 * cb END, 0), 255), 5) AS value FROM m, range(0, 3) r(k)"""
)
def jpeg_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images through JPEG's lossy steps, at a quality of 30 to 90 by image."""
    rows = _colour(spark, sf_dir).withColumn("q", 30 + F.col("image_id") % 5 * 15)
    coded = images.changed(lambda x, q: degrade.jpeg_colour(x.reshape(16, 16, 3) / 255, q) * 255, "image", "q", width=48)
    return rows.select("image_id", F.posexplode(coded).alias("i", "value")).select("image_id", "i", F.round("value", 5).alias("value"))


@query(
    f"""WITH d AS (SELECT o.range AS o, p.range AS p, (o.range * 2 + 0.5::DOUBLE - p.range) / 2 AS d FROM range(0, 4) o, range(-8, 16) p),
k AS (SELECT o, least((p + 16) % 16, 15 - (p + 16) % 16) AS i, sum({CUBIC_SQL}) AS w FROM d GROUP BY ALL), w AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM k),
x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
s AS (SELECT vec_id, r.o AS y, c.o AS x, sum(x.x * r.w * c.w) AS v FROM x JOIN w r ON r.i = x.i // 8 JOIN w c ON c.i = x.i % 8 GROUP BY ALL)
SELECT vec_id, 'contrast' AS metric, round(var_pop(v), 7) AS score FROM s GROUP BY vec_id
UNION ALL SELECT a.vec_id, 'sharpness', round(avg(abs(b.v - a.v)), 7) FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY a.vec_id"""
)
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers over 8 x 8 images brought to 4 x 4, in batches of 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", scoring.model_input("embedding", F.lit(8), F.lit(8), 4, pad="symmetric").alias("t"))
    found = scoring.predicted(rows, "vec_id", "t", [4, 4], {"contrast": scoring.contrast, "sharpness": scoring.sharpness})
    return found.select("vec_id", "metric", F.round("score", 7).alias("score"))


@query("SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS run, round((SELECT var_pop(u) FROM unnest(embedding::DOUBLE[]) t(u)), 7) AS contrast FROM embeddings")
def scores_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores appended to a manifest by key, in two runs: the second scores what the first left."""
    rows = table(spark, sf_dir, "embeddings").withColumn("t", F.transform("embedding", lambda x: x.cast("double")))
    path, scorers = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}", {"contrast": scoring.contrast}
    scoring.score_new(rows.where("vec_id % 2 = 0"), path, "vec_id", "t", [8, 8], scorers, 1)
    scoring.score_new(rows, path, "vec_id", "t", [8, 8], scorers, 2)
    scores = scoring.read_scores(spark, path, "vec_id")
    wide = scoring.with_scores(rows.select("vec_id", "label"), scores, "vec_id", ["contrast"])
    return wide.join(scores.select("vec_id", "run"), "vec_id").select("vec_id", "label", "run", F.round("contrast", 7).alias("contrast"))


@query()
def niqe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 x 32 images of 16 vectors in blocks of 16, against a model of the blocks of every other image."""
    rows = _levels(spark, sf_dir, 16).withColumn("w", F.lit(32))
    blocks = niqe.block_rows(rows, "image_id", "v", "w", block=16)
    return niqe.scores(blocks, "image_id", niqe.pristine_model(blocks.where("image_id % 2 = 0")))


def _axis_sql(n_in: int, n_out: int) -> str:
    """(o, i, w) of lanczos3 with antialiasing, ends reflected."""
    f, eps = n_out / n_in, resample.EPS
    s = min(f, 1.0)
    x = f"({s}::DOUBLE * (o / {f}::DOUBLE + {(n_in - 1) / 2}::DOUBLE - {(n_out - 1) / (2 * f)!r}::DOUBLE - p))"
    left = f"ceil(o / {f}::DOUBLE + {(n_in - 1) / 2}::DOUBLE - {(n_out - 1) / (2 * f)!r}::DOUBLE - {3 / s!r}::DOUBLE - {eps!r}::DOUBLE)"
    turn, taps = 2 * (n_in - 1), math.ceil(6 / s - eps)
    value = f"CASE WHEN abs({x}) < 3 THEN (sin(pi() * {x}) * sin(pi() * {x} / 3) + {eps!r}::DOUBLE) / (pi() * pi() * {x} * {x} / 3 + {eps!r}::DOUBLE) ELSE 0 END"
    return f"(SELECT o, least((p % {turn} + {turn}) % {turn}, {turn} - (p % {turn} + {turn}) % {turn}) AS i, sum(w) AS w FROM (SELECT o, p, {value} / sum({value}) OVER (PARTITION BY o) AS w FROM (SELECT o, {left}::INT + k AS p FROM range(0, {n_out}) a(o), range(0, {taps}) b(k))) GROUP BY ALL)"


@query(
    f"""WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, (r.o * 10 + c.o)::INT AS o, round(sum(v * r.w * c.w), 7) AS value FROM x JOIN {_axis_sql(8, 6)} r ON r.i = x.i // 8 JOIN {_axis_sql(8, 10)} c ON c.i = x.i % 8 GROUP BY ALL"""
)
def resize_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images by 3/4 down and 5/4 across, by banks of filters; the SQL has weights of each axis."""
    made = images.changed(lambda x: resample.resize(x, [0.75, 1.25], kernel="lanczos3", by_filters=True, pad="reflect"), F.transform("embedding", lambda x: x.cast("double")), width=8)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(made).alias("o", "value"))
    return rows.select("vec_id", "o", F.round("value", 7).alias("value"))
