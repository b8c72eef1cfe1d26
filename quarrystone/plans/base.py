"""Registration of queries, and SQL fragments that their DuckDB forms share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A document stands for a file: its suffix by id, size in bytes, width of its longest line, height in lines.
FILES_SQL = """files AS (SELECT doc_id, concat(source, '/', lang, '/', lpad(doc_id::VARCHAR, 8, '0'), CASE doc_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' ELSE '.txt' END) AS path,
  octet_length(encode(coalesce(text, ''))) AS size_bytes,
  list_max(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)))::INT AS width,
  len(string_split(coalesce(text, ''), chr(10)))::INT AS height, NOT contains(coalesce(text, ''), '%%%') AS decodable FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    suffix = F.element_at(F.array(F.lit(".png"), F.lit(".JPG"), F.lit(".webp"), F.lit(".txt")), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), suffix).alias("path"),
        F.octet_length(text).cast("long").alias("size_bytes"),
        F.array_max(F.transform(lines, F.length)).alias("width"),
        F.size(lines).alias("height"),
        (~text.contains("%%%")).alias("decodable"),
    )
