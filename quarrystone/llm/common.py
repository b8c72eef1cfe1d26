"""Helpers shared by the operators: shared storage, size-checked broadcasts, Arrow text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a broadcast side may have; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local master, as in tests, may do without and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quarrystone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # shuffle files of a finished write are of no more use; without this they stay until the driver collects garbage
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    _stored_at[out] = path
    return out


_stored_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of tables that `stored` wrote here and that nothing reads any more. Others are left alone."""
    for table in tables:
        path = _stored_at.pop(table, None)
        if path:
            hadoop = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else df as it is (the join then shuffles)."""
    few = df.select(F.lit(1).alias("one")).limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key isn't in dropped; rows with a null key stay."""
    gone = stored(dropped.select(F.col(key).alias("__gone")).where("__gone is not null").distinct(), "dropped")
    return docs.join(small_side(gone), F.col(key) == F.col("__gone"), "left_anti")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Give Python workers at most `rows` rows at a time: long texts would make batches of the default size large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def binary_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without making Python objects; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Row ranges of about `most` bytes each, one row at least, in order."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def starts_of(lengths: Column, block: int = 256) -> Column:
    """Where parts of these lengths (one at least) begin: running sums, a block at a time, as each sum copies those before it."""

    def sums(zero: Column, numbers: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(numbers, F.struct(zero.cast("int").alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def of(numbers: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")), lambda k: F.slice(numbers, k * block + 1, F.lit(block)))
        tops = lambda parts: sums(F.lit(0), F.transform(parts, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x)))
        return let(blocks, lambda parts: F.flatten(F.zip_with(parts, tops(parts), lambda b, top: sums(top, b))))

    return let(lengths, of)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
