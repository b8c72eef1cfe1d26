"""Curation queries: documents stand for image files, labels and events for their embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import scalars
from quarrystone.operators import curate, sampling
from quarrystone.plans.base import FILES_SQL, files, query, table

IMAGES = [".png", ".jpg", ".jpeg", ".webp"]
MAX_BYTES, MAX_PIXELS, MAX_SUM = 8000, 12_000, 900

STATUS_SQL = f"CASE WHEN size_bytes > {MAX_BYTES} THEN 'too_large' WHEN width * height > {MAX_PIXELS} THEN 'too_many_pixels' WHEN NOT decodable THEN 'unreadable' ELSE 'ok' END"
IMAGE_SQL = "lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.png', '.jpg', '.jpeg', '.webp')"


@query(f"WITH {FILES_SQL} SELECT path, regexp_replace(path, '\\.[^./]+$', '') AS key FROM files WHERE {IMAGE_SQL}")
def file_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curate.with_suffix(files(spark, sf_dir), IMAGES)
    return found.select("path", curate.path_key(F.col("path")).alias("key"))


@query(f"WITH {FILES_SQL} SELECT path, size_bytes, size_bytes > {MAX_BYTES} AS over_limit FROM files")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", "size_bytes", (F.col("size_bytes") > MAX_BYTES).alias("over_limit"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = curate.validity(F.col("size_bytes"), F.col("width"), F.col("height"), F.col("decodable"), MAX_BYTES, MAX_PIXELS)
    return files(spark, sf_dir).select("doc_id", "path", "size_bytes", "width", "height", status.alias("status"))


@query(f"WITH {FILES_SQL} SELECT doc_id, path, size_bytes, width, height, {STATUS_SQL} AS status FROM files")
def file_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir)


@query(f"WITH {FILES_SQL} SELECT path, {STATUS_SQL} AS reason, size_bytes FROM files WHERE {STATUS_SQL} <> 'ok'")
def deletion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.deletion_plan(_validated(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT {STATUS_SQL} AS status, count(*) AS n FROM files GROUP BY 1")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.status_counts(_validated(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT count(*) FILTER (starts_with({STATUS_SQL}, 'ok')) AS ok, count(*) FILTER (starts_with({STATUS_SQL}, 'too')) AS too, count(*) FILTER (starts_with({STATUS_SQL}, 'un')) AS un FROM files")
def status_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.prefix_counts(_validated(spark, sf_dir), "status", ["ok", "too", "un"])


REPORT_SQL = f"""report AS (SELECT 'collect' AS stage, path, NULL::BIGINT AS size_bytes, NULL::INT AS width, NULL::INT AS height, NULL::BOOLEAN AS over_limit FROM files
UNION ALL SELECT 'sizes', path, size_bytes, NULL, NULL, size_bytes > {MAX_BYTES} FROM files
UNION ALL SELECT 'validate', path, size_bytes, CASE WHEN decodable THEN width END, CASE WHEN decodable THEN height END, size_bytes > {MAX_BYTES} FROM files)"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan serves the three stages."""
    rows = files(spark, sf_dir).withColumn("over_limit", F.col("size_bytes") > MAX_BYTES)
    known = rows.select("path", "size_bytes", F.when(F.col("decodable"), F.col("width")).alias("width"), F.when(F.col("decodable"), F.col("height")).alias("height"), "over_limit")
    return curate.union_report(curate.report_rows("collect", rows.select("path")), curate.report_rows("sizes", rows.select("path", "size_bytes", "over_limit")), curate.report_rows("validate", known))


@query(f"WITH {FILES_SQL}, {REPORT_SQL} SELECT * FROM report")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir)


@query(f"WITH {FILES_SQL}, {REPORT_SQL} SELECT * FROM report WHERE stage = 'validate' AND width IS NOT NULL AND height IS NOT NULL AND size_bytes <= {MAX_BYTES} AND width + height <= {MAX_SUM}")
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.filter_manifest(_report(spark, sf_dir), "validate", MAX_BYTES, MAX_SUM)


@query("SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.html', '.htm')")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.with_suffix(table(spark, sf_dir, "pages").select("page_id", "url"), ["HTML", ".htm"], "url")


#: Every labelled document has embeddings by one or two models, under '<model>/<n>px/<key>.pt'.
FOUND_SQL = f"""{FILES_SQL}, found AS (SELECT regexp_replace(path, '\\.[^./]+$', '') AS key, unnest(CASE WHEN quality = 1 AND toxic = 0 THEN ['vae_a', 'vae_b'] WHEN quality = 1 THEN ['vae_a'] ELSE ['vae_b'] END) AS model,
  CASE WHEN doc_id % 3 = 0 THEN '128px' ELSE '256px' END AS resolution FROM files JOIN labels USING (doc_id)),
idx AS (SELECT key, list_sort(list(DISTINCT {{'model': model, 'resolution': resolution}})) AS e FROM found GROUP BY key)"""
AS_TEXT = "array_to_string(list_transform(e, lambda x: x.model || ':' || x.resolution), ',')"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    models = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.array(F.lit("vae_a"), F.lit("vae_b"))).when(F.col("quality") == 1, F.array(F.lit("vae_a"))).otherwise(F.array(F.lit("vae_b")))
    rows = files(spark, sf_dir).join(labels, "doc_id").select(curate.path_key(F.col("path")).alias("key"), F.explode(models).alias("model"), F.when(F.col("doc_id") % 3 == 0, "128px").otherwise("256px").alias("px"))
    paths = rows.select(F.concat_ws("/", "model", "px", F.concat("key", F.lit(".pt"))).alias("path"))
    return paths.select(curate.embedding_key(F.col("path")).alias("e")).where("e is not null").select("e.*")


def _as_text(column: str):
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["model"], x["resolution"])), ",")


@query(f"WITH {FOUND_SQL} SELECT key, {AS_TEXT} AS embeddings FROM idx")
def manifest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.index_embeddings(_found(spark, sf_dir)).select("key", _as_text("embeddings").alias("embeddings"))


PATHS_SQL = """p AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'vae/256px/' || source || '/' || doc_id || '.tar.pt' WHEN 1 THEN 'vae/extra/128px/' || doc_id || '.pt' WHEN 2 THEN lang || '/x/' || doc_id || '.pt'
  WHEN 3 THEN 'vae/' || doc_id || 'px' WHEN 4 THEN 'vae//bigpx/64px/' || source || '.' || doc_id WHEN 5 THEN '128px/' || doc_id || '/a.pt' WHEN 6 THEN './vae/./px/.' || doc_id ELSE 'vae/a/128px/' || source || '/' || doc_id END AS path FROM documents),
c AS (SELECT doc_id, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM p), l AS (SELECT *, parts[2:] AS later, list_position(list_transform(parts[2:], lambda x: ends_with(x, 'px')), true) AS spot FROM c)"""


@query(f"WITH {PATHS_SQL} SELECT doc_id, parts[1] AS model, later[spot] AS resolution, regexp_replace(array_to_string(later[spot + 1:], '/'), '([^/])\\.[^./]+$', '\\1') AS key FROM l WHERE len(parts) >= 3 AND coalesce(spot, 0) > 0 AND spot < len(later)")
def embedding_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model, resolution and key of paths of many forms."""
    k, doc = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    joined = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    source, lang = F.col("source"), F.col("lang")
    forms = [joined("vae/256px/", source, "/", doc, ".tar.pt"), joined("vae/extra/128px/", doc, ".pt"), joined(lang, "/x/", doc, ".pt"), joined("vae/", doc, "px"), joined("vae//bigpx/64px/", source, ".", doc), joined("128px/", doc, "/a.pt"), joined("./vae/./px/.", doc), joined("vae/a/128px/", source, "/", doc)]
    path = F.when(k == 0, forms[0])
    for n, form in enumerate(forms[1:], 1):
        path = path.when(k == n, form)
    rows = table(spark, sf_dir, "documents").select("doc_id", curate.embedding_key(path).alias("e")).where("e is not null")
    return rows.select("doc_id", "e.model", "e.resolution", "e.key")


REQUIRED = curate.parse_requirement("vae_a: 256px") + curate.parse_requirement("vae_b:256px")
MATCH_SQL = f"""WITH {FOUND_SQL}, m AS (SELECT doc_id, path, regexp_replace(path, '\\.[^./]+$', '') AS key FROM files),
j AS (SELECT m.*, e, CASE WHEN e IS NULL THEN 'missing' WHEN list_contains(e, {{'model': 'vae_a', 'resolution': '256px'}}) AND list_contains(e, {{'model': 'vae_b', 'resolution': '256px'}}) THEN 'matched' ELSE 'filtered' END AS status FROM m LEFT JOIN idx USING (key))"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = files(spark, sf_dir).select("doc_id", "path", curate.path_key(F.col("path")).alias("key"))
    return curate.match_manifest(manifest, curate.index_embeddings(_found(spark, sf_dir)), REQUIRED)


@query(f"{MATCH_SQL} SELECT doc_id, path, status, {AS_TEXT} AS embeddings FROM j")
def manifest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("doc_id", "path", "status", _as_text("embeddings").alias("embeddings"))


@query(f"{MATCH_SQL} SELECT status, count(*) AS n FROM j GROUP BY status")
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.status_counts(_matched(spark, sf_dir))


@query("SELECT user_id FROM (SELECT DISTINCT user_id, event_type || '_' || (event_id % 7) AS v FROM events) WHERE v IN ('click_0', 'view_3', 'purchase_5') GROUP BY user_id HAVING count(*) = 3")
def division_required_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.lit("_"), (F.col("event_id") % 7).cast("string")).alias("v"))
    return curate.divide(rows, "user_id", "v", ["click_0", "view_3", "purchase_5"])


PAIR_SQL = "WITH low AS (SELECT concat(vec_id // 2, '.pt') AS name, vec_id, label FROM embeddings WHERE vec_id % 2 = 0), high AS (SELECT concat(vec_id // 2, '.pt') AS name, vec_id, label FROM embeddings WHERE vec_id % 2 = 1 AND label <> 3)"


def _pair_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.expr("vec_id div 2").cast("string"), F.lit(".pt")).alias("name"), "vec_id", "label")
    return rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1 and label <> 3")


@query(f"{PAIR_SQL} SELECT name, low.vec_id, low.label, high.vec_id AS high_vec_id, high.label AS high_label FROM low JOIN high USING (name)")
def pair_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.pair_by_name(*_pair_sides(spark, sf_dir), "name")


@query(f"{PAIR_SQL} SELECT name, 'left' AS side FROM low WHERE name NOT IN (SELECT name FROM high) UNION ALL SELECT name, 'right' FROM high WHERE name NOT IN (SELECT name FROM low)")
def pair_cardinality_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.pairing_faults(*_pair_sides(spark, sf_dir), "name")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def keyset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.pairing_faults(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.missing_outputs(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT * FROM (SELECT p_partkey, p_name, p_retailprice, p_size FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100)")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.top_k(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size"), "p_retailprice", 100, "p_partkey")


@query("WITH p AS (SELECT p_partkey, p_size, p_retailprice, (p_retailprice + p_size) / 2 AS score FROM part) SELECT * FROM (SELECT * FROM p ORDER BY p_retailprice DESC, p_partkey LIMIT 50) UNION SELECT * FROM (SELECT * FROM p ORDER BY p_size DESC, p_partkey LIMIT 50) UNION SELECT * FROM (SELECT * FROM p ORDER BY score DESC, p_partkey LIMIT 50)")
def topk_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").withColumn("score", (F.col("p_retailprice") + F.col("p_size")) / 2)
    return curate.top_k_union(rows, ["p_retailprice", "p_size", "score"], 50, "p_partkey")


MAX_FILES, SHARD_BYTES = 40, 60_000


@query(
    f"""WITH RECURSIVE {FILES_SQL}, n AS (SELECT doc_id, size_bytes, row_number() OVER (ORDER BY doc_id) AS r FROM files),
p AS (SELECT r, doc_id, size_bytes, 1 AS files_in, size_bytes AS bytes_in, 0::BIGINT AS shard FROM n WHERE r = 1
UNION ALL SELECT n.r, n.doc_id, n.size_bytes, CASE WHEN p.files_in >= {MAX_FILES} OR p.bytes_in + n.size_bytes > {SHARD_BYTES} THEN 1 ELSE p.files_in + 1 END,
  CASE WHEN p.files_in >= {MAX_FILES} OR p.bytes_in + n.size_bytes > {SHARD_BYTES} THEN n.size_bytes ELSE p.bytes_in + n.size_bytes END,
  CASE WHEN p.files_in >= {MAX_FILES} OR p.bytes_in + n.size_bytes > {SHARD_BYTES} THEN p.shard + 1 ELSE p.shard END FROM p JOIN n ON n.r = p.r + 1)
SELECT doc_id, size_bytes, shard FROM p"""
)
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("doc_id", "size_bytes")
    return curate.greedy_shards(rows, ["doc_id"], "size_bytes", MAX_FILES, SHARD_BYTES).select("doc_id", "size_bytes", "shard")


@query("SELECT max(regexp_extract(c_name, '(\\d+)$', 1)::BIGINT) AS step FROM customer")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.max(F.regexp_extract("c_name", r"(\d+)$", 1).try_cast("bigint")).alias("step"))


@query("SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"))


@query("SELECT DISTINCT coalesce(source, '') AS folder FROM documents")
def distinct_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("folder")).distinct().orderBy("folder")


@query("SELECT * FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) AS pos, (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS rank FROM orders)")
def rank_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rank_shards(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("WITH n AS (SELECT count(*) AS n FROM orders), t AS (SELECT ceil(n * 3 / 8)::BIGINT * 8 AS total, n FROM n), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT o_orderkey, r.range AS slot, r.range % 8 AS rank FROM t, range((SELECT total FROM t)) r JOIN o ON o.pos = r.range % (SELECT n FROM n)")
def enlarged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.enlarged(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], ratio=3, ranks=8)


@query()
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: the limit is the feature."""
    return sampling.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500, seed=11)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 100 = 0")
def every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.every_kth(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("SELECT page_id, concat('image_', lpad(page_id::VARCHAR, 8, '0'), '_', substr(md5(url), 1, 16), '.jpg') AS filename FROM pages")
def download_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.download_name(F.col("url"), F.col("page_id")).alias("filename"))


@query(f"WITH {FILES_SQL} SELECT status, count(*) AS files, sum(size_bytes) AS bytes FROM (SELECT {STATUS_SQL} AS status, size_bytes FROM files) GROUP BY status")
def total_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).groupBy("status").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query(
    f"""WITH {FOUND_SQL}, v AS (SELECT doc_id, path, regexp_replace(path, '\\.[^./]+$', '') AS key, size_bytes, width, height FROM files WHERE {STATUS_SQL} = 'ok'),
m AS (SELECT doc_id, size_bytes, width * height AS pixels FROM v JOIN idx USING (key))
SELECT doc_id, size_bytes, pixels FROM (SELECT * FROM m ORDER BY size_bytes DESC, doc_id LIMIT 200) UNION SELECT doc_id, size_bytes, pixels FROM (SELECT * FROM m ORDER BY pixels DESC, doc_id LIMIT 200)"""
)
def curation_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validate, match with embeddings, and take the distinct union of the largest by two measures."""
    valid = _validated(spark, sf_dir).where("status = 'ok'").withColumn("key", curate.path_key(F.col("path")))
    matched = curate.match_manifest(valid, curate.index_embeddings(_found(spark, sf_dir)), []).where("status = 'matched'")
    rows = matched.select("doc_id", "size_bytes", (F.col("width") * F.col("height")).alias("pixels"))
    return curate.top_k_union(rows, ["size_bytes", "pixels"], 200, "doc_id")
