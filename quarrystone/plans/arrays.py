"""Array queries: an embedding of 64 floats is an 8 x 8 latent; consecutive vectors are pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import arrays, layout, scalars
from quarrystone.plans.base import FILES_SQL, files, query, table

PAIRS = "p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
TERMS = "(list_sum(list_transform(range(1, 65), lambda i: ({0})::DECIMAL(28,12)))::DOUBLE)"
SQUARE = TERMS.format("(a[i] - b[i]) * (a[i] - b[i])")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


def _measure(name: str, sql: str, expression, digits: int = 8):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("vec_id", F.round(expression(F.col("a"), F.col("b")), digits).alias("value"))

    run.__name__ = name
    query(f"WITH {PAIRS} SELECT vec_id, round({sql}, {digits}) AS value FROM p")(run)


_measure("vec_mse", f"{SQUARE} / 64", arrays.mse)
_measure("vec_l1", TERMS.format("abs(a[i] - b[i])") + " / 64", arrays.mae)
_measure("vec_charbonnier", TERMS.format("sqrt((a[i] - b[i]) * (a[i] - b[i]) + 1e-12::DOUBLE)") + " / 64", arrays.charbonnier)
_measure("vec_psnr", f"10 * log10(65025 / ({SQUARE} / 64))", lambda a, b: arrays.psnr(arrays.mse(a, b)), 5)
_measure("vec_psnr_eps", f"10 * log10(1 / ({SQUARE} / 64 + 1e-8::DOUBLE))", lambda a, b: arrays.psnr_unit(arrays.mse(a, b)), 5)
_measure("vec_weighted_l1", TERMS.format("abs(a[i] - b[i]) * (i % 3)") + " / 64", lambda a, b: arrays.weighted(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i % 3).cast("double"))))

V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query(
    f"""WITH {V} SELECT vec_id, round((list_sum(list_transform(range(1, 57), lambda i: abs(e[i] - e[i + 8])::DECIMAL(28,12)))::DOUBLE) / 56
 + (list_sum(list_transform(list_filter(range(1, 65), lambda i: i % 8 <> 0), lambda i: abs(e[i] - e[i + 1])::DECIMAL(28,12)))::DOUBLE) / 56, 8) AS tv FROM v"""
)
def tv_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.total_variation(F.col("embedding"), 8), 8).alias("tv"))


SOFT = "(greatest({0}, 0::DOUBLE) + ln(1 + exp(-abs({0}))))"


@query(
    f"WITH s AS (SELECT vec_id, embedding[1]::DOUBLE * 5 AS x FROM embeddings) SELECT vec_id, round({SOFT.format('(-x)')}, 8) AS vanilla_real, round({SOFT.format('x')}, 8) AS vanilla_fake, round((x - 1) * (x - 1), 8) AS lsgan_real, round(-x, 8) AS wgan_real, round(greatest(0::DOUBLE, 1 + x), 8) AS hinge_fake, round(-x, 8) AS hinge_generator FROM s"
)
def gan_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 5).alias("x"))
    x, r = F.col("x"), lambda c: F.round(c, 8)
    return rows.select(
        "vec_id",
        r(arrays.gan_loss(x, "vanilla", True)).alias("vanilla_real"),
        r(arrays.gan_loss(x, "vanilla", False)).alias("vanilla_fake"),
        r(arrays.gan_loss(x, "lsgan", True)).alias("lsgan_real"),
        r(arrays.gan_loss(x, "wgan", True)).alias("wgan_real"),
        r(arrays.gan_loss(x, "hinge", False)).alias("hinge_fake"),
        r(arrays.gan_loss(x, "hinge", True, discriminator=False)).alias("hinge_generator"),
    )


@query(f"WITH {V}, ij AS (SELECT i.range AS i, j.range AS j FROM range(0, 4) i, range(0, 4) j) SELECT vec_id, (i * 4 + j)::INT AS cell, round(list_sum(list_transform(range(1, 17), lambda k: (e[i * 16 + k] * e[j * 16 + k])::DECIMAL(28,12)))::DOUBLE / 64, 8) AS value FROM v, ij")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.gram(F.col("embedding"), 4)).alias("cell", "value"))
    return rows.select("vec_id", "cell", F.round("value", 8).alias("value"))


@query(f"WITH {V}, x AS (SELECT vec_id, unnest(range(0, 64))::INT AS dim, unnest(e) AS x FROM v), q AS (SELECT *, least(floor(255 * (least(greatest(x, -0.3::DOUBLE), 0.3::DOUBLE) + 0.3::DOUBLE) / 0.6::DOUBLE), 254)::INT AS q FROM x) SELECT vec_id, dim, q, round((q + 0.5) * 0.6::DOUBLE / 255 - 0.3::DOUBLE, 8) AS back FROM q")
def quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    q = rows.select("vec_id", "dim", scalars.quantize(F.col("x").cast("double"), -0.3, 0.3, 255).alias("q"))
    return q.withColumn("back", F.round(scalars.dequantize(F.col("q"), -0.3, 0.3, 255), 8))


@query(f"WITH {V}, x AS (SELECT vec_id, unnest(range(0, 64))::INT AS dim, unnest(e) AS x FROM v) SELECT vec_id, dim, round_even((least(greatest(x * 4, -1::DOUBLE), 1::DOUBLE) + 1) / 2 * 255, 0)::INT AS rounded, floor((least(greatest(x * 4, -1::DOUBLE), 1::DOUBLE) + 1) / 2 * 255)::INT AS truncated FROM x")
def to_uint8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    x = F.col("x").cast("double") * 4
    return rows.select("vec_id", "dim", scalars.to_uint8(x).alias("rounded"), scalars.to_uint8(x, truncate=True).alias("truncated"))


@query(f"WITH {V} SELECT vec_id, round(16::DOUBLE + 65.481::DOUBLE * abs(e[1]) + 128.553::DOUBLE * abs(e[2]) + 24.966::DOUBLE * abs(e[3]), 6) AS y, round(128::DOUBLE - 37.797::DOUBLE * abs(e[1]) - 74.203::DOUBLE * abs(e[2]) + 112::DOUBLE * abs(e[3]), 6) AS cb, round(128::DOUBLE + 112::DOUBLE * abs(e[1]) - 93.786::DOUBLE * abs(e[2]) - 18.214::DOUBLE * abs(e[3]), 6) AS cr FROM v")
def ycbcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda k: F.abs(F.col("embedding")[k].cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.ycbcr(c(0), c(1), c(2)).alias("p"))
    return rows.select("vec_id", *[F.round(f"p.{k}", 6).alias(k) for k in ("y", "cb", "cr")])


def _text(values) -> F.Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def _layout_sql(index: str, n: int = 64) -> str:
    return f"WITH {V} SELECT vec_id, array_to_string(list_transform(range(0, {n}), lambda i: floor(e[{index} + 1] * 1000)::INT), ',') AS image FROM v"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-major 8 x 8 images of whole numbers, one a vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("image"))


def _layout(name: str, sql: str, change):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _images(spark, sf_dir).select("vec_id", layout.let(F.col("image"), lambda x: _text(change(x))).alias("image"))

    run.__name__ = name
    query(sql)(run)


_layout("flip_horizontal", _layout_sql("(i // 8) * 8 + 7 - i % 8"), lambda x: arrays.flip_rows(x, 8))
_layout("flip_vertical", _layout_sql("(7 - i // 8) * 8 + i % 8"), lambda x: arrays.flip_columns(x, 8))
_layout("transpose_image", _layout_sql("(i % 8) * 8 + i // 8"), lambda x: arrays.transpose(x, 8))
_layout("crop_border", _layout_sql("(i // 4 + 2) * 8 + i % 4 + 2", 16), lambda x: arrays.crop(x, 8, 2, 2, 4, 4))
_layout("window_partition", _layout_sql("((i // 16) // 2 * 4 + (i % 16) // 4) * 8 + (i // 16) % 2 * 4 + i % 4"), lambda x: F.flatten(arrays.blocks(x, 8, 4)))

N = "sqrt(CASE WHEN o.range = 0 THEN 1 / 8::DOUBLE ELSE 2 / 8::DOUBLE END)"


@query(f"WITH {V}, x AS (SELECT vec_id, unnest(range(0, 64)) // 8 AS line, unnest(range(0, 64)) % 8 AS i, unnest(e) AS x FROM v), w AS (SELECT o.range::INT AS o, i.range AS i, {N} * cos((2 * i.range + 1) * o.range * pi() / 16) AS w FROM range(0, 8) o, range(0, 8) i) SELECT vec_id, line::INT AS line, o, round(sum((x * w)::DECIMAL(28,12))::DOUBLE, 8) AS value FROM x JOIN w USING (i) GROUP BY vec_id, line, o")
def dct8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the eight rows of a vector's 8 x 8 block."""
    lines = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))).alias("line", "v"))
    rows = lines.select(F.struct("vec_id", "line").alias("at"), "v")
    return arrays.apply_weights(rows, "at", "v", arrays.dct_weights(spark)).select("at.vec_id", "at.line", "o", F.round("value", 8).alias("value"))


A = "abs(d)"
CUBIC = f"CASE WHEN {A} <= 1 THEN 1.5 * {A} * {A} * {A} - 2.5 * {A} * {A} + 1 WHEN {A} <= 2 THEN -0.5 * {A} * {A} * {A} + 2.5 * {A} * {A} - 4 * {A} + 2 ELSE 0 END"


@query(
    f"""WITH {V}, x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(e) AS x FROM v),
d AS (SELECT o.range::INT AS o, p.range AS p, ((o.range + 0.5::DOUBLE) * 2 - 0.5::DOUBLE - p.range) * 0.5::DOUBLE AS d FROM range(0, 32) o, range(-8, 72) p WHERE p.range BETWEEN floor((o.range + 0.5) * 2 - 0.5 - 4) AND ceil((o.range + 0.5) * 2 - 0.5 + 4)),
k AS (SELECT o, least((p + 128) % 128, 127 - (p + 128) % 128) AS i, sum({CUBIC}) AS w FROM d GROUP BY ALL),
w AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM k)
SELECT vec_id, o, round(sum((x * w)::DECIMAL(28,12))::DOUBLE, 8) AS value FROM x JOIN w USING (i) GROUP BY vec_id, o"""
)
def resize_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return arrays.apply_weights(rows, "vec_id", "v", arrays.resize_weights(spark, 64, 32)).select("vec_id", "o", F.round("value", 8).alias("value"))


C, S = math.cos(0.5), math.sin(0.5)
GRID = f"g AS (SELECT y.range::INT AS y, x.range::INT AS x, pow(x.range * {C!r}::DOUBLE + y.range * {S!r}::DOUBLE, 2) / 4 + pow(y.range * {C!r}::DOUBLE - x.range * {S!r}::DOUBLE, 2) / 2.25 AS q FROM range(-10, 11) y, range(-10, 11) x)"


def _kernel(name: str, density: str, function):
    """8 x 8 images blurred by a kernel of 21 x 21 values, edges reflected."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        weights = arrays.convolution_weights(arrays.grid_kernel(spark, 21, function), 8, 8)
        rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
        # as DuckDB rounds: the scaled double, not its shortest decimal
        return arrays.apply_weights(rows, "vec_id", "v", weights).select("vec_id", "o", (F.round(F.col("value") * 1e7) / 1e7).alias("value"))

    run.__name__ = name
    mirrored = lambda i: f"least((({i}) % 14 + 14) % 14, 14 - (({i}) % 14 + 14) % 14)"
    query(
        f"""WITH {GRID}, d AS (SELECT y, x, {density} AS d FROM g), k AS (SELECT y, x, d / sum(d) OVER () AS w FROM d),
w AS (SELECT o, {mirrored('o // 8 + y')} * 8 + {mirrored('o % 8 + x')} AS i, sum(w) AS w FROM k, range(0, 64) r(o) GROUP BY ALL), {V}, x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(e) AS x FROM v)
SELECT vec_id, o::INT AS o, round(sum((x * w)::DECIMAL(28,12))::DOUBLE, 7) AS value FROM x JOIN w USING (i) GROUP BY vec_id, o"""
    )(run)


_kernel("gauss_kernel", "exp(-0.5 * q)", arrays.gaussian(2.0, 1.5, 0.5))
_kernel("generalized_kernel", "exp(-0.5 * pow(q, 0.7))", arrays.gaussian(2.0, 1.5, 0.5, 0.7))
_kernel("plateau_kernel", "1 / (pow(q, 1.4) + 1)", arrays.plateau(2.0, 1.5, 0.5, 1.4))


@query(f"WITH {V}, p AS (SELECT vec_id, unnest(range(0, 64))::INT AS i, unnest(e) * 10 AS x FROM v) SELECT vec_id, i, round(CASE WHEN abs(x) <= 1 THEN 1.5 * abs(x) * abs(x) * abs(x) - 2.5 * abs(x) * abs(x) + 1 WHEN abs(x) <= 2 THEN -0.5 * abs(x) * abs(x) * abs(x) + 2.5 * abs(x) * abs(x) - 4 * abs(x) + 2 ELSE 0 END, 9) AS cubic, round(greatest(0::DOUBLE, 1 - abs(x)), 9) AS linear, CASE WHEN abs(x) <= 1 THEN 1::DOUBLE ELSE 0 END AS box, round(CASE WHEN x = 0 THEN 1 WHEN abs(x) < 3 THEN sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) ELSE 0 END, 9) AS lanczos3 FROM p")
def interpolation_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernels at ten times the values of vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    x = F.col("e").cast("double") * 10
    return rows.select("vec_id", "i", *[F.round(arrays.kernel(n, x), 9).alias(n) for n in ("cubic", "linear", "box", "lanczos3")])


STEPS = "s AS (SELECT event_id, event_id % 1000 AS step FROM events)"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of runs of a thousand."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000).alias("step"))


@query(f"WITH {STEPS} SELECT event_id, step, round(CASE WHEN step >= 600 THEN 0.5::DOUBLE * pow(0.1::DOUBLE, (step >= 700)::INT + (step >= 800)::INT) ELSE pow(0.1::DOUBLE, (step >= 200)::INT * 2 + (step >= 400)::INT) END, 10) AS lr FROM s")
def lr_multistep(spark: SparkSession, sf_dir: str) -> DataFrame:
    lr = scalars.multistep_lr(F.col("step"), 1.0, [200, 200, 400, 700, 800], 0.1, (0, 600), (1.0, 0.5))
    return _steps(spark, sf_dir).select("event_id", "step", F.round(lr, 10).alias("lr"))


@query(f"WITH {STEPS} SELECT event_id, step, (CASE WHEN step <= 400 THEN 0 WHEN step <= 1000 THEN 1 END)::INT AS period, round(CASE WHEN step <= 400 THEN 1e-7::DOUBLE + 0.5::DOUBLE * (1e-3::DOUBLE - 1e-7::DOUBLE) * (1 + cos(pi() * step / 400)) ELSE 1e-7::DOUBLE + 0.25::DOUBLE * (1e-3::DOUBLE - 1e-7::DOUBLE) * (1 + cos(pi() * (step - 400) / 600)) END, 12) AS lr FROM s")
def lr_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("step")
    return _steps(spark, sf_dir).select("event_id", "step", scalars.period_index(s, [400, 1000]).alias("period"), F.round(scalars.cosine_lr(s, 1e-3, [400, 600], [1.0, 0.5], 1e-7), 12).alias("lr"))


@query(f"WITH {STEPS} SELECT event_id, step, round(CASE WHEN step < 100 THEN 0.01::DOUBLE * step / 100 ELSE 0.01 END, 10) AS lr FROM s")
def lr_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("event_id", "step", F.round(scalars.warmup(F.col("step"), F.lit(0.01), 100), 10).alias("lr"))


@query("SELECT doc_id, substr(lower(regexp_replace(coalesce(text, ''), '\\W+', '_', 'g')), 1, 50) AS slug FROM documents")
def prompt_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slug has 50 characters, and a run of any length counts as one."""
    return table(spark, sf_dir, "documents").select("doc_id", scalars.prompt_slug(F.coalesce("text", F.lit("")), unicode=False).alias("slug"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(trim(url), '[^\\w.-]', '_', 'g'), ''), 'run') AS slug, regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages")
def run_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.run_slug(F.col("url"), unicode=False).alias("slug"), scalars.url_basename(F.col("url")).alias("name"))


WORDS = "w AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN value::DECIMAL(10,2)::VARCHAR WHEN 3 THEN event_type ELSE '' END AS t FROM events)"


@query(f"WITH {WORDS} SELECT event_id, CASE WHEN lower(t) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(t, '[+-]?\\d+') THEN 'int' WHEN try_cast(t AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS kind FROM w")
def parse_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    t = F.when(k == 0, "true").when(k == 1, F.col("event_id").cast("string")).when(k == 2, F.col("value").cast("decimal(10,2)").cast("string")).when(k == 3, F.col("event_type")).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", scalars.literal_kind(t).alias("kind"))


@query(f"WITH {FILES_SQL}, b AS (SELECT doc_id, size_bytes * (1 + doc_id % 900) AS n FROM files) SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576::DOUBLE) ELSE printf('%.1f GB', n / 1073741824::DOUBLE) END AS said FROM b")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", scalars.human_size(F.col("size_bytes") * (1 + F.col("doc_id") % 900)).alias("said"))


@query(f"WITH {FILES_SQL}, s AS (SELECT doc_id, width, height, least(1::DOUBLE, 256 / greatest(width, height, 1)::DOUBLE) AS s FROM files) SELECT doc_id, greatest(round_even(width * s, 0), 1)::INT AS width, greatest(round_even(height * s, 0), 1)::INT AS height FROM s")
def fit_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", scalars.fit_size(F.col("width"), F.col("height"), 256).alias("s")).select("doc_id", "s.width", "s.height")


@query("WITH q AS (SELECT doc_id, (n_chars % 100 + 1)::INT AS quality FROM documents) SELECT doc_id, quality, round(CASE WHEN quality < 50 THEN 5000 / quality::DOUBLE ELSE 200 - quality * 2 END / 100, 8) AS factor, round(round_even(quality / 8::DOUBLE, 0) + pow(quality / 8::DOUBLE - round_even(quality / 8::DOUBLE, 0), 3), 9) AS soft FROM q")
def quality_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG factors of qualities from 1 to 100, and their eighths rounded softly."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100 + 1).cast("int").alias("quality"))
    return rows.select("doc_id", "quality", F.round(scalars.quality_to_factor(F.col("quality").cast("double")), 8).alias("factor"), F.round(scalars.soft_round(F.col("quality") / 8.0), 9).alias("soft"))


@query()
def gaussian_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", arrays.gaussian_noise(F.transform("embedding", lambda x: x.cast("double")), F.col("vec_id"), 0.1, -1.0, 1.0).alias("noisy"))
