"""Samples and shards: every choice is a hash of the key and a seed, every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.ordering import numbered


def head(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """First n in order; 0 means all."""
    return rows.orderBy(*order).limit(n) if n else rows


def hash_sample(rows: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """n rows by the hash of key and seed, or all if there are fewer."""
    picked = rows.withColumn("__h", F.xxhash64(*key, F.lit(seed)))
    return picked.orderBy("__h", *key).limit(n).drop("__h")


def every_kth(rows: DataFrame, step: str, k: int) -> DataFrame:
    return rows.where(F.col(step) % k == 0)


def rank_shards(rows: DataFrame, order: list[str], ranks: int) -> DataFrame:
    """pos and rank = pos mod ranks."""
    return numbered(rows, *order).withColumn("rank", F.pmod("pos", F.lit(ranks)))


def padded_shards(rows: DataFrame, order: list[str], ranks: int) -> DataFrame:
    """rank_shards in which the first rows come again, flagged, until all ranks have as many."""
    at = rank_shards(rows, order, ranks).withColumn("padding", F.lit(False))
    n = at.count()
    again = at.where(F.col("pos") < (-n) % ranks).withColumn("pos", F.col("pos") + n)
    return at.unionByName(again.withColumn("rank", F.pmod("pos", F.lit(ranks))).withColumn("padding", F.lit(True)))


def enlarged(rows: DataFrame, order: list[str], ratio: int, ranks: int, epoch: int | None = None) -> DataFrame:
    """ceil(n * ratio / ranks) * ranks slots, each a row (slot mod n), dealt to ranks; an epoch shuffles the slots by hash."""
    at = numbered(rows, *order)
    n = at.count()
    total = -(-n * ratio // ranks) * ranks
    # a row's slots are pos, pos + n, ... below total
    slots = at.withColumn("slot", F.explode(F.sequence("pos", F.lit(total - 1), F.lit(n)))) if n else at.withColumn("slot", F.col("pos"))
    if epoch is not None:
        slots = numbered(slots.withColumn("__h", F.xxhash64("slot", F.lit(epoch))), "__h", "slot", name="place").drop("__h", "slot").withColumnRenamed("place", "slot")
    return slots.drop("pos").withColumn("rank", F.pmod("slot", F.lit(ranks)))
