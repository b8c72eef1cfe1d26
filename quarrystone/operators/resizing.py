"""Decoding in tasks with a status for each file: one broken file says so in its row, and its neighbours are read all the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import png

PALETTE = "skipped: palette transparency (bytes)"


def _isolated(files: DataFrame, path: str, content: str, schema: str, kinds: list, work: Callable[[bytes | None], tuple]) -> DataFrame:
    """(path, *schema): `work` on each content; whatever it raises becomes the text of its row's status, the other columns are null."""
    names = [path, *(f.split()[0] for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1):
                try:
                    out.append(work(data.as_py()))
                except Exception as error:  # a file may be broken in any way; its row says how
                    out.append((str(error) or type(error).__name__, *[None] * (len(kinds) - 1)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return files.select(path, content).mapInArrow(run, f"`{path}` {files.schema[path].dataType.simpleString()}, {schema}")


def probe(files: DataFrame, path: str = "path", content: str = "content", load: Callable[[bytes], object] | None = None) -> DataFrame:
    """(path, status, failed): whether `load` (decoding a PNG by default) gets through; `failed` is empty or the path, as lists of broken files have it."""
    read = load or png.decoded

    def work(data: bytes | None) -> tuple:
        if data is None:
            raise ValueError("no content")
        read(data)
        return ("ok",)

    found = _isolated(files, path, content, "status string", [pa.string()], work)
    return found.withColumn("failed", F.when(F.col("status") == "ok", "").otherwise(F.col(path).cast("string")))


def resize_files(files: DataFrame, long_side: int, path: str = "path", content: str = "content", most_pixels: int | None = None) -> DataFrame:
    """(path, status, width, height, image): PNG files as colours, the longer side at most `long_side` pixels, encoded again.

    Status `ok`; for palettes with transparency in bytes, which can't become colours faithfully, `skipped: ...`; else the error.
    """

    def work(data: bytes | None) -> tuple:
        if data is None:
            raise ValueError("no content")
        header, _ = png.parts(data)
        if header.byte_transparency():
            return PALETTE, None, None, None
        pixels, _ = png.decoded(data, most_pixels)
        width, height = png.new_size(header.width, header.height, long_side)
        return "ok", width, height, png.encoded(png.resized(pixels, width, height))

    return _isolated(files, path, content, "status string, width int, height int, image binary", [pa.string(), pa.int32(), pa.int32(), pa.binary()], work)


def outcome_counts(statuses: DataFrame, status: str = "status") -> DataFrame:
    """One row: ok, errors, skipped."""
    s = F.col(status)
    skipped = F.coalesce(s.startswith("skipped:"), F.lit(False))
    count = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")
    ok = F.coalesce(s == "ok", F.lit(False))
    return statuses.agg(count(ok).alias("ok"), count(~ok & ~skipped).alias("errors"), count(skipped).alias("skipped"))
