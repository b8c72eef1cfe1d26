"""Dataset plans: which files make a sample, as rows. Images are read later, by path, with the readers of `sources`.

Clips are rows (clip, frames); file sets are rows with a `path`. What a training loop would draw at random is a hash of the sample's
key and a seed (an epoch's number, say), so that a task that is repeated draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators import curate, sequence
from quarrystone.operators.ordering import numbered


def draw(key: Column, seed: int, purpose: str, n: int | Column) -> Column:
    """A number in 0..n-1 for a key: 32 bits of a digest, which other engines have as well."""
    said = F.concat_ws(":", key.cast("string"), F.lit(f"{seed}:{purpose}"))
    return F.pmod(F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def augmentation(rows: DataFrame, key: str, seed: int, hflip: bool = True, rotate: bool = True) -> DataFrame:
    """Adds hflip, vflip, transpose: one choice for all images of a sample. The last two make the rotations."""
    coin = lambda purpose, on: (draw(F.col(key), seed, purpose, 2) == 0) if on else F.lit(False)
    return rows.withColumns({"hflip": coin("hflip", hflip), "vflip": coin("vflip", rotate), "transpose": coin("transpose", rotate)})


def crop_window(rows: DataFrame, key: str, seed: int, height: str, width: str, patch: int, scale: int) -> DataFrame:
    """Adds top and left of a patch of the low-resolution image, and gt_top and gt_left, scale times that. A status says where the
    image is smaller than the patch (then all four are null); the high-resolution patch has scale * patch pixels a side."""
    fits = (F.col(height) >= patch) & (F.col(width) >= patch)
    at = lambda side, purpose: F.when(fits, draw(F.col(key), seed, purpose, F.greatest(F.col(side) - patch + 1, F.lit(1))))
    out = rows.withColumns({"top": at(height, "top"), "left": at(width, "left")})
    return out.withColumns({"gt_top": F.col("top") * scale, "gt_left": F.col("left") * scale, "crop_status": F.when(fits, "ok").otherwise("too_small")})


def latent_pairs(files: DataFrame, low: int, high: int, suffix: str = ".pt", path: str = "path") -> DataFrame:
    """(cache, name, lq_path, gt_path): files '<cache>/<low>px/<name>' with their namesakes of the high resolution. Several caches
    make one set; a cache without one of the two folders gives no rows (`empty_caches` names it)."""
    pattern = r"^(.*)/(\d+)px/([^/]+)$"
    part = lambda k: F.regexp_extract(path, pattern, k)
    rows = files.where(F.col(path).endswith(suffix) & F.col(path).rlike(pattern)).select(part(1).alias("cache"), part(2).alias("res"), part(3).alias("name"), F.col(path).alias("path"))
    side = lambda res, name: rows.where(F.col("res") == str(res)).select("cache", "name", F.col("path").alias(name))
    return side(low, "lq_path").join(side(high, "gt_path"), ["cache", "name"])


def empty_caches(pairs: DataFrame, caches: DataFrame, cache: str = "cache") -> DataFrame:
    """Caches that give no pair."""
    return curate.missing_outputs(caches, pairs, cache)


def image_pairs(gt: DataFrame, lq: DataFrame, template: str = "{}", path: str = "path") -> DataFrame:
    """(name, suffix, gt_path, lq_path): each target with the input named by the template, '{}' being the target's name. An input that
    is absent gives null, so that nothing is dropped unsaid."""
    last = F.element_at(F.split(path, "/"), -1)
    named = gt.select(F.regexp_replace(last, r"\.[^.]+$", "").alias("name"), F.regexp_extract(last, r"(\.[^.]+)$", 1).alias("suffix"), F.col(path).alias("gt_path"))
    named = named.withColumn("file", F.concat(F.replace(F.lit(template), F.lit("{}"), F.col("name")), "suffix"))
    return named.join(lq.select(last.alias("file"), F.col(path).alias("lq_path")), "file", "left").drop("file")


def frame_samples(clips: DataFrame, clip: str, frames: str, held_out: list[str], inverse: bool = False) -> DataFrame:
    """A row per frame (clip, idx, frame_key) of the clips that aren't held out, or, if inverse, of those only."""
    inside = F.col(clip).cast("string").isin(held_out)
    return sequence.frame_keys(clips.where(inside if inverse else ~inside).select(clip, frames), clip, frames).join(clips.select(F.col(clip).alias("clip"), F.col(frames).cast("int").alias("n_frames")), "clip")


def centred_samples(samples: DataFrame, window: int, intervals: list[int], seed: int, reverse: bool = False) -> DataFrame:
    """Adds interval, centre and frames (window indexes, interval apart). A frame too near an end of its clip gives place to a
    frame drawn among those that fit; clips too short for the interval give no row."""
    half, key = window // 2, F.col("frame_key")
    rows = samples.withColumn("interval", F.element_at(F.array(*map(F.lit, intervals)), (draw(key, seed, "interval", len(intervals)) + 1).cast("int")))
    margin = F.lit(half) * F.col("interval")
    rows = rows.where(F.col("n_frames") > 2 * margin)
    fits = (F.col("idx") >= margin) & (F.col("idx") + margin < F.col("n_frames"))
    rows = rows.withColumn("centre", F.when(fits, F.col("idx")).otherwise((margin + draw(key, seed, "centre", F.col("n_frames") - 2 * margin)).cast("int")))
    found = F.sequence(F.col("centre") - margin, F.col("centre") + margin, F.col("interval"))
    return rows.withColumn("frames", F.when(draw(key, seed, "reverse", 2) == 0, F.reverse(found)).otherwise(found) if reverse else found)


def recurrent_samples(samples: DataFrame, length: int, intervals: list[int], seed: int, reverse: bool = False) -> DataFrame:
    """Adds interval, start and frames: `length` frames on from the sample's own, or from one drawn where the clip ends before."""
    key = F.col("frame_key")
    rows = samples.withColumn("interval", F.element_at(F.array(*map(F.lit, intervals)), (draw(key, seed, "interval", len(intervals)) + 1).cast("int")))
    last = F.col("n_frames") - F.lit(length) * F.col("interval")
    rows = rows.where(last >= 0)
    rows = rows.withColumn("start", F.when(F.col("idx") <= last, F.col("idx")).otherwise(draw(key, seed, "start", last + 1).cast("int")))
    found = F.sequence(F.col("start"), F.col("start") + F.lit(length - 1) * F.col("interval"), F.col("interval"))
    return rows.withColumn("frames", F.when(draw(key, seed, "reverse", 2) == 0, F.reverse(found)).otherwise(found) if reverse else found)


def septuplets(keys: DataFrame, key: str, frames: int, seed: int, reverse: bool = False, flip_sequence: bool = False) -> DataFrame:
    """(key, target, inputs): the middle picture of seven and its neighbours by number; with flip_sequence the inputs are followed
    by their reverse."""
    inputs = F.array(*map(F.lit, sequence.centred_list(frames)))
    inputs = F.when(draw(F.col(key), seed, "reverse", 2) == 0, F.reverse(inputs)).otherwise(inputs) if reverse else inputs
    inputs = sequence.flipped(inputs) if flip_sequence else inputs
    name = lambda n: F.concat(F.col(key), F.lit("/im"), n.cast("string"), F.lit(".png"))
    return keys.select(key, name(F.lit(4)).alias("target"), F.transform(inputs, name).alias("inputs"))


def test_windows(frames: DataFrame, clip: str, idx: str, window: int, padding: str) -> DataFrame:
    """A row per frame of a test clip: label 'pos/size', border, and the window's frames in order. idx is 0-based and gapless."""
    at = sequence.positions(frames.select(clip, idx), clip, idx, window // 2)
    offsets = F.sequence(F.lit(-(window // 2)), F.lit(window // 2))
    pick = lambda o: sequence.padded_index(F.col("pos") + o, F.col("pos"), F.col("size") - 1, window, padding)
    return at.select(clip, idx, "label", "border", F.transform(offsets, pick).alias("frames"))


def clip_folders(frames: DataFrame, clip: str, idx: str) -> DataFrame:
    """(clip, index, n_frames, frames): whole clips as samples, numbered by name."""
    whole = frames.groupBy(clip).agg(F.count("*").alias("n_frames"), F.array_sort(F.collect_list(idx)).alias("frames"))
    return numbered(whole, clip, name="index")


def pending_files(files: DataFrame, done: DataFrame, suffixes: list[str], path: str = "path") -> DataFrame:
    """Files with one of the suffixes whose key isn't among those done."""
    named = curate.with_suffix(files, suffixes, path).withColumn("key", curate.path_key(F.col(path)))
    return curate.missing_outputs(named, done, "key")


def stacked_clips(frames: DataFrame, clip: str, idx: str, image: str, most_frames: int = 1000, multiple: int = 1, height: str | None = None, width: str | None = None) -> DataFrame:
    """(clip, names, images): a clip's images in order, as one row. Rows are counted before any image moves: a clip of more than most_frames is
    an error, as its images make one row. With height and width, images are cut to a multiple of `multiple` on each side, from their first pixel."""
    sizes = frames.groupBy(clip).agg(F.count("*").alias("__n"))
    large = sizes.where(F.col("__n") > most_frames).limit(1).collect()
    if large:
        raise ValueError(f"clip {large[0][0]} has too many frames for one row: {large[0][1]}")
    taken = F.col(image)
    if height and width:
        row = F.col(width) - F.col(width) % multiple
        lines = F.floor(F.col(height) / multiple) * multiple
        taken = F.flatten(F.transform(F.sequence(F.lit(0), (lines - 1).cast("int")), lambda y: F.slice(F.col(image), y * F.col(width) + 1, row)))
    rows = frames.select(F.col(clip), F.struct(F.col(idx).alias("idx"), taken.alias("image")).alias("s")).groupBy(clip).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(clip, F.col("s.idx").alias("names"), F.col("s.image").alias("images"))
