"""Sinks: manifests, records, key-value tables, tar shards; and their extraction."""

from __future__ import annotations

import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Array columns become comma-joined text."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode(mode).option("header", True).csv(path)


def write_parquet(rows: DataFrame, path: str, mode: str = "error", by: list[str] | None = None) -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_failed(rows: DataFrame, index: str, ok: str, path: str, mode: str = "error") -> None:
    rows.where(~F.coalesce(F.col(ok), F.lit(False))).select(F.col(index).cast("string")).write.mode(mode).text(path)


def write_latents(records: DataFrame, path: str, mode: str = "error") -> None:
    """Records with model and resolution, partitioned by them."""
    write_parquet(records, path, mode, ["model", "resolution"])


def write_missing(rows: DataFrame, path: str, key: str) -> int:
    """Append rows whose key isn't there yet; returns how many. A key column makes reruns safe."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path).select(key).distinct()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        there = None
    fresh = rows.join(there, key, "left_anti") if there is not None else rows
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def key_values(rows: DataFrame, key: str, content: str, shape: list[str]) -> DataFrame:
    """(key, h, w, c, content) of encoded images."""
    return rows.select(F.col(key).alias("key"), *[F.col(s).cast("int").alias(n) for s, n in zip(shape, ("h", "w", "c"), strict=True)], F.col(content).alias("content"))


def tar_shards(rows: DataFrame, shard: str, name: str, content: str, level: int = 3) -> DataFrame:
    """(shard, files, archive): a gzipped tar per shard; shards are bounded by how they were cut."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz", compresslevel=level) as tar:
            for n, c in part[[name, content]].sort_values(name).itertuples(index=False):
                info = tarfile.TarInfo(n)
                info.size = len(c)
                tar.addfile(info, io.BytesIO(c))
        return pd.DataFrame({"shard": [part[shard].iloc[0]], "files": [len(part)], "archive": [out.getvalue()]})

    return rows.select(shard, name, content).groupBy(shard).applyInPandas(pack, "shard long, files long, archive binary")


def extract_tars(archives: DataFrame, done: DataFrame | None = None, key: str = "shard") -> DataFrame:
    """(key, name, content) of regular files; archives whose key is in `done` are left out. Names that leave the folder are errors."""
    todo = archives.join(done.select(key), key, "left_anti") if done is not None else archives

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, data in zip(batch[key], batch["archive"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    for member in tar:
                        if member.name.startswith("/") or ".." in member.name.split("/"):
                            raise ValueError(f"unsafe name {member.name} in archive {k}")
                        if member.isfile():
                            yield pd.DataFrame({key: [k], "name": [member.name], "content": [tar.extractfile(member).read()]})

    return todo.select(key, "archive").mapInPandas(unpack, f"{key} long, name string, content binary")


def png_bytes(pixels: bytes, height: int, width: int, channels: int) -> bytes:
    """An 8-bit PNG (grey or RGB) of row-major pixels."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    row = width * channels
    lines = b"".join(b"\0" + pixels[k * row : (k + 1) * row] for k in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encode_png(rows: DataFrame, pixels: str, height: str, width: str, channels: str) -> DataFrame:
    """rows with a column `png`."""

    @F.pandas_udf("binary")
    def encode(p: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([png_bytes(bytes(x), int(a), int(b), int(d)) for x, a, b, d in zip(p, h, w, c, strict=True)], dtype=object)

    return rows.withColumn("png", encode(pixels, height, width, channels))
