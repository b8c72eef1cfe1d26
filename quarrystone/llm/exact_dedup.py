"""Exact dedup by content-defined chunk recipes.

Texts are cut where a hash of the last eight bytes says so, so equal stretches give equal chunks. Each distinct chunk
travels once (with a map-side distinct) to get a verified identifier: its 64-bit hash, plus a rank among the
different contents that share that hash (0 unless hashes collide). A document then is the ordered list of its
chunks' identifiers, and two documents are equal when the lists are. Long texts never move again.

Cases: a null text is empty; empty texts are equal to each other; a null id loses against any id; rows that repeat
id and text are one document and share their flag; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quarrystone.llm.common import binary_buffers, read_table, slices, small_batches, stored, text_of

LEAST, MEAN_BITS, MOST = 256, 10, 16384
#: Rows from which a group of equal documents is large; how many of the largest are broadcast, and the longest recipe that one of them may have.
LARGE, MOST_LARGE, LONGEST = 1000, 1000, 4096


def cut_points(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Starts of the chunks of each row, a 0 first; byte positions depend on nearby bytes only."""
    out: list[np.ndarray] = []
    for lo, hi in slices(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        at = np.zeros(0, np.int64)
        if len(part) > 8:
            marks = np.zeros(len(part) + 1, bool)
            for k in range(8):  # all windows that begin at k, k + 8, ...
                words = part[k : k + (len(part) - k) // 8 * 8].view("<u8")
                marks[k + 8 :: 8][: len(words)] = words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MEAN_BITS) == 0
            at = np.flatnonzero(marks) + offsets[lo]
        for i in range(lo, hi):
            a, b = int(offsets[i]), int(offsets[i + 1])
            cuts, last = [0], 0
            # a window that reaches back over the row's start is no cut of this row
            for c in at[np.searchsorted(at, a + LEAST) : np.searchsorted(at, b)] - a if b - a > LEAST else ():
                c = int(c)
                while c - last > MOST:
                    last += MOST
                    cuts.append(last)
                if c - last >= LEAST:
                    cuts.append(c)
                    last = c
            while b - a - last > MOST:
                last += MOST
                cuts.append(last)
            out.append(np.array(cuts, np.int32))
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def chunk_starts(texts: pd.Series) -> pd.Series:
    raw, offsets = binary_buffers(pa.array(texts, pa.large_binary()))
    return pd.Series(cut_points(raw, offsets))


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).cast("binary").alias("raw"))
    rows = rows.withColumn("starts", chunk_starts("raw"))
    piece = lambda s, i: F.substring(F.col("raw"), s + 1, F.coalesce(F.get(F.col("starts"), i + 1), F.octet_length("raw")) - s)
    return rows.withColumn("chunks", F.transform("starts", piece))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    cut = _chunked(docs, id_col, text_col)
    # distinct chunks, combined map-side; only their 8-byte hashes move again to find contents that share one
    contents = cut.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk").distinct()
    shared = contents.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = stored(shared, "shared-hashes")
    recipes = cut.select(
        "doc_id",
        F.unhex(F.sha2("raw", 256)).alias("sha"),
        F.transform("chunks", lambda c: F.struct(F.xxhash64(c).alias("h"), F.lit(0).alias("rank"))).alias("recipe"),
    )
    if not shared.isEmpty():
        recipes = _ranked(cut, shared)
    # cut once: from here on a document is its recipe, which the two readers below share
    recipes = stored(recipes.select("doc_id", "sha", "recipe", F.xxhash64("recipe").alias("h")), "recipes")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select(F.col("recipe").alias("same"), F.xxhash64("recipe").alias("g"), "top", "n"), "groups")
    # rows of the largest groups, which may be a third of all, meet their group's row in their own task: at most MOST_LARGE recipes of LONGEST
    # identifiers, some 64 MB. What is left are groups of less rows than those, or of texts of megabytes; adaptive execution splits them.
    large = groups.where((F.col("n") > LARGE) & (F.size("same") <= LONGEST)).orderBy(F.desc("n"), "g").limit(MOST_LARGE)
    match = (F.col("h") == F.col("g")) & (F.col("recipe") == F.col("same"))
    met = recipes.join(F.broadcast(stored(large, "large")), match, "left")
    rest = met.where("n is null").select(*recipes.columns).join(groups, match, "left")
    joined = met.where("n is not null").unionByName(rest)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _ranked(cut: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes when some hashes stand for several contents: those contents get ranks, the documents that use them are rebuilt."""
    from pyspark.sql import Window

    rows = cut.withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows.select("row", "doc_id", F.unhex(F.sha2("raw", 256)).alias("sha"), "chunks"), "chunked")
    parts = rows.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", F.xxhash64("chunk"))
    ranks = parts.join(shared, "h", "left_semi").select("h", "chunk").distinct()
    ranks = ranks.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    ids = parts.join(ranks, ["h", "chunk"], "left").select("row", "pos", "h", F.coalesce("rank", F.lit(0)).alias("rank"))
    lists = ids.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "rank"))).alias("l"))
    lists = lists.select("row", F.transform("l", lambda x: F.struct(x["h"].alias("h"), x["rank"].alias("rank"))).alias("recipe"))
    return rows.select("row", "doc_id", "sha").join(lists, "row").drop("row")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
