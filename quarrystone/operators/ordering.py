"""Global order without a single task: positions, positions within keys, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.storage import stored


def numbered(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """df with its 0-based position in the order, which must be total: range partitions are numbered each, plus an offset for
    all partitions before (a table of one row a partition)."""
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = stored(parts, "ranges")  # the range bounds are sampled; storing them makes later reads agree
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn(name, local.cast("long")).join(F.broadcast(offsets), "__part").withColumn(name, F.col(name) + F.col("__offset")).drop("__part", "__offset")


def ranked(df: DataFrame, keys: list[str], *order: str | Column, few: int = 200_000, block: int = 65_536) -> DataFrame:
    """df with `pos` (0-based, in its key) and `size` (rows of the key). A key may span many tasks: few keys are broadcast; of
    many, rows and bounds meet by key and block of positions, so that a large key is dealt over tasks there too."""
    at = numbered(df, *keys, *order, name="__pos")
    bounds = stored(at.groupBy(*keys).agg(F.min("__pos").alias("__low"), F.count("*").alias("size")), "bounds")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    if bounds.count() <= few:
        bounds = F.broadcast(bounds)
    else:
        # a key of n rows has at most n / block + 1 blocks of positions, so its bounds are repeated no more often than that
        at = at.withColumn("__salt", F.floor(F.col("__pos") / block))
        first, last = F.floor(F.col("__low") / block), F.floor((F.col("__low") + F.col("size") - 1) / block)
        bounds = bounds.withColumn("__salt", F.explode(F.sequence(first, last)))
        on.append(F.col("l.__salt") == F.col("r.__salt"))
    joined = at.alias("l").join(bounds.alias("r"), on)
    return joined.select("l.*", (F.col("__pos") - F.col("__low")).alias("pos"), "size").drop("__pos", "__salt")
