"""Streaming jobs: a pair pool with state, best-so-far values, and (beyond the reference) event-time windows and sessions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.storage import shared_dir


def open_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream, with its own schema. (The pattern at the end lets the reader take single files.)"""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path + "*")


def run_to_end(stream: DataFrame, mode: str, name: str, folder: str | None = None) -> DataFrame:
    """Process all that is there, then return the result: all rows that were appended, or the last complete result. State and
    progress lie in `folder`: a job that is started again with it goes on where it was. Without one, each run begins anew in the
    shared folder."""
    spark = stream.sparkSession
    base = folder or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # one folder a batch: a batch that is repeated after a failure overwrites its own
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


POOL_OUT, POOL_STATE = "shard long, emitted long, seen long", "held array<long>, seen long"


def pair_pool(rows: DataFrame, key: str, shards: int, size: int, seed: int) -> DataFrame:
    """Each shard fills a pool of `size` keys; once full, every new key replaces one that a hash picks, which is emitted."""
    import xxhash

    def step(shard: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out = []
        # all keys that a micro-batch has for the shard, however Arrow cuts them
        for k in sorted(k for batch in batches for k in batch[key]):
            seen += 1
            if len(held) < size:
                held.append(int(k))
            else:
                at = xxhash.xxh64_intdigest(f"{k}:{seed}") % size
                out.append((shard[0], held[at], seen))
                held[at] = int(k)
        state.update((held, seen))
        yield pd.DataFrame(out, columns=["shard", "emitted", "seen"])

    dealt = rows.select(key, F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandasWithState(step, POOL_OUT, POOL_STATE, "append", "NoTimeout")


def best_so_far(events: DataFrame, key: str, value: str, at: str) -> DataFrame:
    top = F.max(F.struct(F.col(value).alias("v"), F.col(at).alias("at")))
    return events.groupBy(key).agg(top.alias("t")).select(key, F.col("t.v").alias("best"), F.col("t.at").alias("best_at"))


def tumbling_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    found = timed.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), "n")
