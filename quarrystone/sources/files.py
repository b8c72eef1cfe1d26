"""Sources: file sets, manifests, meta files, logs, records, remote fetches. Paths go to Spark's readers only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALIDATION = "stage string, path string, size_bytes bigint, width int, height int, over_limit boolean"
URLS = "image_url string, prompt string"
CLIPS = "folder string, frames int, h int, w int, c int"
LATENT = "version int, latents struct<shape:array<int>,data:array<float>>, variant int, dataset struct<high_resolution:int,model_resolution:int,resize_long_side:int>, storage_dtype string, mean array<float>, logvar array<float>"


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """A manifest with an explicit schema; fails early if the header lacks a required column."""
    if required:
        found = spark.read.option("header", True).csv(path).columns
        if missing := [c for c in required if c not in found]:
            raise ValueError(f"columns missing in {path}: {missing}")
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if missing := [c for c in required or [] if c not in rows.columns]:
        raise ValueError(f"columns missing in {path}: {missing}")
    return rows


def list_files(spark: SparkSession, root: str, suffixes: list[str] | None = None, recursive: bool = True, hidden: bool = False, contents: bool = False) -> DataFrame:
    """path, modified, size_bytes (and content): without it the reader lists only. Suffixes ignore case."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    rows = rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), *(["content"] if contents else []))
    if not hidden:
        rows = rows.where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    if suffixes:
        ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
        rows = rows.where(ending.isin([("" if s.startswith(".") else ".") + s.lower() for s in suffixes]))
    return rows


def list_archives(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    return list_files(spark, root, recursive=False).where(F.element_at(F.split("path", "/"), -1).startswith(prefix) & F.col("path").endswith(".tar.gz"))


def png_size(content: Column) -> Column:
    """struct(width, height) from a PNG's header; null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: path, height, width, channels, data (blue, green, red); those that can't be decoded have height -1."""
    return spark.read.format("image").option("dropInvalid", False).load(root).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def unit_pixels(data: Column) -> Column:
    """Image bytes as values in [-1, 1]."""
    pairs = F.sequence(F.lit(1), F.octet_length(data))
    value = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("double")
    return F.transform(pairs, lambda i: (value(i) / 255.0 - 0.5) / 0.5)


def parse_clips(lines: DataFrame, column: str = "value") -> DataFrame:
    """'000 100 (720,1280,3)' -> folder, frames, h, w, c; lines of another form give nulls but the folder."""
    v, pattern = F.col(column), r"^(\S+)\s+(\d+)\s+\((\d+),\s*(\d+),\s*(\d+)\)"
    part = lambda k: F.regexp_extract(v, pattern, k).try_cast("int")
    return lines.select(F.split(v, r"\s+")[0].alias("folder"), *[part(k).alias(n) for k, n in ((2, "frames"), (3, "h"), (4, "w"), (5, "c"))])


def parse_pairs(lines: DataFrame, column: str = "value") -> DataFrame:
    """'gt, lq' lines."""
    parts = F.split(column, ", ")
    return lines.select(F.get(parts, 0).alias("gt"), F.get(parts, 1).alias("lq"))


def parse_keys(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keys of a key-value store's meta file: what stands before the first dot."""
    return lines.select(F.split(column, r"\.")[0].alias("key"))


def synthetic_key(number: Column) -> Column:
    """The key that a store without a list of keys gives to its n-th image."""
    return F.format_string("%08d.png", number)


def synthetic_keys(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(synthetic_key(F.col("id")).alias("key"))


def parse_log(lines: DataFrame, pattern: str, step: bool = True, column: str = "value", step_one: bool = False) -> DataFrame:
    """(step, value) or (value) of lines that match from their beginning."""
    anchored = "^(?:" + pattern + ")"
    rows = lines.where(F.col(column).rlike(anchored))
    get = lambda k: F.regexp_extract(column, anchored, k)
    if not step:
        return rows.select(get(1).try_cast("double").alias("value"))
    return rows.select(F.lit(1).cast("long").alias("step") if step_one else F.regexp_replace(get(1), ",", "").try_cast("long").alias("step"), get(2).try_cast("double").alias("value"))


def latent_of(record: Column, names: list[str]) -> Column:
    """The first of the fields latents, tensor, latent that the record has."""
    return F.coalesce(*[record[n] for n in ("latents", "tensor", "latent") if n in names])


def fetch(urls: DataFrame, url: str, key: str, get: Callable[[str], bytes], retries: int = 3, wait: float = 0.0) -> DataFrame:
    """(key, url, ok, content, error): get is called in tasks, up to `retries` times with a wait that grows by steps."""
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, u in zip(batch[key], batch[url], strict=True):
                content, error = None, None
                for attempt in range(retries):
                    try:
                        content, error = get(u), None
                        break
                    except Exception as e:  # the caller's function may raise anything; the row says what
                        error = str(e)
                        time.sleep(wait * (attempt + 1))
                out.append((k, u, content is not None, content, error))
            yield pd.DataFrame(out, columns=[key, url, "ok", "content", "error"])

    kind = dict(urls.dtypes)[key]
    return urls.select(key, url).mapInPandas(run, f"{key} {kind}, {url} string, ok boolean, content binary, error string")
