"""Clips and frames: padded windows, neighbours, borders, running values over ordered rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.ordering import numbered, ranked
from quarrystone.operators.storage import stored


def frame_keys(clips: DataFrame, clip: str, frames: str, template: str = "%s/%08d") -> DataFrame:
    """One row per frame: clip, idx, frame_key."""
    rows = clips.where(F.col(frames) > 0).select(F.col(clip).alias("clip"), F.explode(F.sequence(F.lit(0), F.col(frames).cast("int") - 1)).alias("idx"))
    return rows.withColumn("frame_key", F.format_string(template, F.col("clip").cast("string"), "idx"))


def padded_index(i: Column, centre: Column, last: Column, frames: int, padding: str) -> Column:
    """The frame that stands for position i of a centred window over 0..last."""
    half = frames // 2
    before, after = {
        "replicate": (F.lit(0), last),
        "reflection": (-i, last * 2 - i),
        "reflection_circle": (centre + half - i, (centre - half) - (i - last)),
        "circle": (i + frames, i - frames),
    }[padding]
    return F.when(i < 0, before).when(i > last, after).otherwise(i)


def padded_windows(frames: DataFrame, clip: str, idx: str, window: int, padding: str) -> DataFrame:
    """clip, idx, offset, source: the source frame of each place of each frame's window; idx is 0-based and gapless."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    last = frames.groupBy(clip).agg(F.max(idx).alias("last"))
    rows = frames.select(clip, idx).join(last, clip)
    half = window // 2
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    return rows.select(clip, idx, "offset", padded_index(F.col(idx) + F.col("offset"), F.col(idx), F.col("last"), window, padding).alias("source"))


def neighbours(frames: DataFrame, clip: str, idx: str, offsets: list[int], payload: list[str]) -> DataFrame:
    """Self-join with the frames at the offsets; those outside the clip are left out."""
    wanted = frames.select(clip, idx, F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset")).withColumn("at", F.col(idx) + F.col("offset"))
    other = frames.select(clip, F.col(idx).alias("at"), *[F.col(c).alias(f"near_{c}") for c in payload])
    return wanted.join(other, [clip, "at"]).drop("at")


def strided_windows(frames: DataFrame, clip: str, idx: str, n: int, stride: Column) -> DataFrame:
    """Forward windows of n frames: the start is clamped so that the window ends in the clip; clips too short for it give none."""
    last = frames.groupBy(clip).agg(F.max(idx).alias("last"))
    rows = frames.join(last, clip).withColumn("stride", stride).where(F.col("last") >= (n - 1) * F.col("stride"))
    start = F.least(F.col(idx), F.col("last") - (n - 1) * F.col("stride"))
    return rows.select(clip, idx, "stride", F.sequence(start, start + (n - 1) * F.col("stride"), F.col("stride")).alias("frames"))


def centred_list(frames: int, most: int = 7) -> list[int]:
    """1-based frame numbers around the centre of a clip of `most` frames."""
    return [i + (most + 2 - frames) // 2 for i in range(frames)]


def centred_frames(frames: Column, most: int = 7) -> Column:
    """`centred_list` of a column of lengths."""
    first = F.floor((most + 2 - frames) / 2)
    return F.sequence(first, first + frames - 1)


def positions(frames: DataFrame, clip: str, order: str, border: int) -> DataFrame:
    """pos, size, label 'pos/size', and border = 1 in the first and last `border` frames of a clip."""
    at = ranked(frames, [clip], order)
    edge = (F.col("pos") < border) | (F.col("size") - 1 - F.col("pos") < border)
    return at.withColumn("label", F.concat_ws("/", "pos", "size")).withColumn("border", edge.cast("int"))


def flipped(values: Column) -> Column:
    """A sequence with its reverse after it."""
    return F.concat(values, F.reverse(values))


def mean_of_flips(forward: Column, backward: Column) -> Column:
    return F.zip_with(forward, F.reverse(backward), lambda a, b: (a + b) / 2)


def resetting_mean(rows: DataFrame, order: list[str], value: str, window: int) -> DataFrame:
    """Running mean that starts anew after window + 1 rows; sums are decimal, so exact. Blocks are spread over tasks."""
    at = numbered(rows, *order).withColumn("block", F.floor(F.col("pos") / (window + 1)))
    w = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    total, n = F.sum(F.col(value).cast("decimal(20,6)")).over(w), F.count(F.lit(1)).over(w)
    return at.withColumn("mean", total.cast("double") / n)


def recurrence(rows: DataFrame, keys: list[str], pos: str, value: str, weight: float, block: int = 4096) -> DataFrame:
    """keys, pos, y with y = weight * y_before + value along gapless positions from 0, per key, beginning with y = value.

    Positions are dealt in blocks, each scanned by doubling in its task. What blocks end with is such a recurrence again, with the weight of a
    block, so keys of any length take as many rounds as their length has digits in base `block`, and none of them is one row or one task.
    """
    names = [*keys, "block"]
    placed = rows.select(*keys, F.floor(F.col(pos) / block).alias("block"), F.struct(F.col(pos).alias("pos"), F.col(value).cast("double").alias("v")).alias("r"))
    blocks = placed.groupBy(*names).agg(F.array_sort(F.collect_list("r")).alias("rows"))

    @F.pandas_udf("array<double>")
    def scanned(values: pd.Series) -> pd.Series:
        def one(v):
            y, step = np.array(v, np.float64), 1
            while step < len(y):
                y[step:] += weight**step * y[:-step].copy()
                step *= 2
            return y

        return pd.Series([one(v) for v in values], dtype=object)

    own = stored(blocks.select(*names, F.col("rows")[0]["pos"].alias("from"), scanned(F.transform("rows", lambda r: r["v"])).alias("ys")), "recurrence")
    if own.where("block > 0").isEmpty():
        return own.select(*keys, F.posexplode("ys").alias("k", "y")).select(*keys, F.col("k").cast("long").alias("pos"), "y")
    ends = own.select(*names, F.element_at("ys", -1).alias("end"))
    before = recurrence(ends, keys, "block", "end", weight**block, block).withColumn("block", F.col("pos") + 1).select(*names, F.col("y").alias("before"))
    on = [F.col(f"o.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    joined = own.alias("o").join(before.alias("b"), on, "left").select("o.*", F.coalesce("b.before", F.lit(0.0)).alias("before"))
    each = joined.select(*keys, "from", "before", F.posexplode("ys").alias("k", "y"))
    return each.select(*keys, (F.col("from") + F.col("k")).alias("pos"), (F.col("y") + F.col("before") * F.pow(F.lit(weight), F.col("k") + 1)).alias("y"))


def smoothed(rows: DataFrame, keys: list[str], order: list[str], value: str, weight: float, block: int = 4096) -> DataFrame:
    """y = weight * y_before + (1 - weight) * x, beginning with y = x, per key; see `recurrence`."""
    at = ranked(rows, keys, *order)
    entered = at.select(*keys, "pos", F.when(F.col("pos") == 0, F.col(value)).otherwise(F.col(value) * (1 - weight)).alias("__v"))
    return recurrence(entered, keys, "pos", "__v", weight, block).withColumnRenamed("y", "smooth")
