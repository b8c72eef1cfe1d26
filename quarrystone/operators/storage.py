"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local master, as in tests, may do without and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quarrystone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else as it is."""
    return F.broadcast(df) if df.select(F.lit(1).alias("one")).limit(limit + 1).count() <= limit else df


def archived(spark: SparkSession, path: str, stamp: str) -> str | None:
    """Rename what is at `path` so that a run can begin anew there; the new name, or None where nothing was. Nothing is deleted."""
    source = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(source):
        return None
    name = f"{path.rstrip('/')}_archived_{stamp}"
    target = spark._jvm.org.apache.hadoop.fs.Path(name)
    if system.exists(target) or not system.rename(source, target):
        raise ValueError(f"{path} can't be renamed to {name}")
    return name
