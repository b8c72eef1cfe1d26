"""Curation of file manifests: validate, filter, index, match, divide, pick, pack.

Rows are files: path, size_bytes, width, height. Nothing is deleted or dropped silently: statuses say why.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.ordering import numbered
from quarrystone.operators.storage import stored

REPORT = ["stage", "path", "size_bytes", "width", "height", "over_limit"]


def suffix_of(path: str | Column) -> Column:
    """Lower-case suffix with its dot, '' if the name has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def normal_suffixes(suffixes: list[str]) -> list[str]:
    """With a leading dot, in lower case."""
    return [("" if s.startswith(".") else ".") + s.lower() for s in suffixes]


def with_suffix(files: DataFrame, suffixes: list[str], path: str = "path", fold_case: bool = True) -> DataFrame:
    found = suffix_of(path) if fold_case else F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return files.where(found.isin(normal_suffixes(suffixes) if fold_case else suffixes))


def display_path(path: Column, root: str, relative: bool = True) -> Column:
    """Relative to root where it lies below it, else unchanged."""
    base = root.rstrip("/") + "/"
    return F.when(F.lit(relative) & path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def path_key(path: Column, root: str = "") -> Column:
    """Join key: the path below root without its last suffix."""
    return F.regexp_replace(display_path(path, root, bool(root)), r"\.[^./]+$", "")


def embedding_key(path: Column) -> Column:
    """struct(key, model, resolution) of a path below the cache: the model is its first part, the resolution the first later part that ends in
    'px', the key all that follows, without its last suffix. Null with fewer than three parts, no such part, or nothing after it."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    later = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.array_position(F.transform(later, lambda p: p.endswith("px")), F.lit(True)).cast("int")
    rest = F.array_join(F.slice(later, at + 1, F.size(later)), "/")
    found = F.struct(F.regexp_replace(rest, r"(?<=[^/])\.[^./]+$", "").alias("key"), F.get(parts, F.lit(0)).alias("model"), F.get(later, at - 1).alias("resolution"))
    return F.when((F.size(parts) >= 3) & (at > 0) & (at < F.size(later)), found)


def after_marker(path: Column, marker: str) -> Column:
    """What follows the first segment equal to marker; an error where there is none."""
    parts = F.split(path, "/")
    at = F.array_position(parts, marker).cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, at + 1, F.size(parts)), "/")).otherwise(F.raise_error(F.concat(F.lit(f"no segment {marker} in "), path)))


def validity(size: Column, width: Column, height: Column, decodable: Column, max_bytes: int, max_pixels: int) -> Column:
    """The first check that fails, in this order, else 'ok'. Limits are strict: a value equal to one is fine. A header may give
    the size of an image that can't be decoded, so pixels are counted first."""
    return F.when(size > max_bytes, "too_large").when(width * height > max_pixels, "too_many_pixels").when(~decodable, "unreadable").otherwise("ok")


def report_rows(stage: str, rows: DataFrame) -> DataFrame:
    """Rows of a stage with the report's columns; what a stage doesn't know is null."""
    kinds = {"path": "string", "size_bytes": "long", "width": "int", "height": "int", "over_limit": "boolean"}
    return rows.select(F.lit(stage).alias("stage"), *[(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


def union_report(*stages: DataFrame) -> DataFrame:
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


def filter_manifest(report: DataFrame, stage: str | None = None, max_bytes: int | None = None, max_dimension_sum: int | None = None) -> DataFrame:
    """Complete rows of a stage within the limits, which are inclusive; what is left out isn't asked for."""
    need = ["width", "height", "size_bytes"]
    if missing := [c for c in ([*need, "stage"] if stage is not None else need) if c not in report.columns]:
        raise ValueError(f"columns missing: {missing}")
    rows = (report if stage is None else report.where(F.col("stage") == stage)).dropna(subset=need)
    rows = rows if max_bytes is None else rows.where(F.col("size_bytes") <= max_bytes)
    return rows if max_dimension_sum is None else rows.where(F.col("width") + F.col("height") <= max_dimension_sum)

def deletion_plan(report: DataFrame, status: str = "status") -> DataFrame:
    """What an operator may delete by hand: a table, never an action."""
    return report.where(F.col(status) != "ok").select("path", F.col(status).alias("reason"), "size_bytes")


def index_embeddings(found: DataFrame, models: list[str] | None = None) -> DataFrame:
    """key -> sorted array of struct(model, resolution); no models means all."""
    rows = found.where(F.col("model").isin(models)) if models else found
    return rows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("model", "resolution"))).alias("embeddings"))


def by_model_name(rows: DataFrame, path: str, names: list[str]) -> DataFrame:
    """Rows whose path holds any of the names; no names means all."""
    return rows.where(F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.col(path), n))) if names else rows


def parse_requirement(spec: str) -> list[tuple[str, str]]:
    """'model:r1,r2' -> pairs; an error without a model or a resolution."""
    model, colon, rest = spec.partition(":")
    wanted = [r.strip() for r in rest.split(",") if r.strip()]
    if not (colon and model.strip() and wanted):
        raise ValueError(f"not a requirement: {spec!r}")
    return [(model.strip(), r) for r in wanted]


def meets(embeddings: Column, required: list[tuple[str, str]]) -> Column:
    """Relational division: every required (model, resolution) is there; nothing required is always met."""
    if not required:
        return F.lit(True)
    wanted = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("resolution")) for m, r in required])
    return F.size(F.array_except(wanted, embeddings)) == 0


def match_manifest(manifest: DataFrame, index: DataFrame, required: list[tuple[str, str]]) -> DataFrame:
    """Manifest rows with their embeddings and a status: matched, missing (no embeddings) or filtered (requirement not met)."""
    joined = manifest.join(index, "key", "left")
    status = F.when(F.col("embeddings").isNull(), "missing").when(meets(F.col("embeddings"), required), "matched").otherwise("filtered")
    return joined.withColumn("status", status)


def divide(rows: DataFrame, key: str, value: str, required: list) -> DataFrame:
    """Keys that have all required values. The counting form: it aggregates partially and never gathers a key's rows."""
    hits = rows.where(F.col(value).isin(required)).groupBy(key, value).agg(F.lit(1).alias("one"))
    return hits.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(set(required))).select(key)


def pair_by_name(low: DataFrame, high: DataFrame, name: str, on: list[str] | None = None) -> DataFrame:
    """Inner equi-join of two file sets on their names (and further columns)."""
    keys = [*(on or []), name]
    other = [c for c in high.columns if c not in keys]
    return low.join(high.select(*keys, *[F.col(c).alias(f"high_{c}") for c in other]), keys)


def pairing_faults(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side; two sets pair in full if this is empty."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def positional_pairs(left: DataFrame, right: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """k-th row of a key with the k-th of the other side; unequal counts show as nulls on one side."""
    from quarrystone.operators.ordering import ranked

    a = ranked(left, keys, *order).drop("size")
    b = ranked(right, keys, *order).drop("size")
    b = b.select(*keys, "pos", *[F.col(c).alias(f"other_{c}") for c in right.columns if c not in keys])
    return a.join(b, [*keys, "pos"], "full_outer")


def missing_outputs(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def prefix_counts(rows: DataFrame, status: str, prefixes: list[str]) -> DataFrame:
    """One row: how many statuses begin with each prefix."""
    return rows.agg(*[F.count_if(F.col(status).startswith(p)).alias(p) for p in prefixes])


def top_k(rows: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """k largest by a column, ties to the smaller key; nulls last."""
    return rows.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc()).limit(k)


def top_k_union(rows: DataFrame, columns: list[str], k: int, tie: str) -> DataFrame:
    """Distinct rows among the k largest of each column."""
    picked = [top_k(rows, c, k, tie) for c in columns]
    return union_report(*picked).dropDuplicates()


def common_prefix(rows: DataFrame, path: str) -> DataFrame:
    """One row: the longest common directory of all paths, from their least and greatest."""
    ends = rows.agg(F.min(path).alias("a"), F.max(path).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    n = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)).cast("int") - 1, F.size(a))
    return ends.select(F.array_join(F.slice(a, 1, F.greatest(n, F.lit(0))), "/").alias("common"))


STARTS = "pos long, size long, bucket long, next long, exit long"


def greedy_shards(files: DataFrame, order: list[str], size: str, max_files: int, max_bytes: int, width: int = 65_536) -> DataFrame:
    """Shards of files in order, as many as fit: a shard ends before the file that would make it too many or too large; an
    oversize file is alone. Adds `pos` and `shard` (0-based).

    Where a shard that begins at a file would end needs at most max_files rows ahead, so buckets of `width` positions,
    with that overlap, find it for all files in parallel, and with it where a run of shards leaves the bucket. Which files do
    begin shards follows by doubling these jumps over buckets: a number of joins that is logarithmic in the buckets."""
    width = max(width, max_files)
    at = stored(numbered(files, *order), "numbered")
    rows = at.select("pos", F.col(size).cast("long").alias("size"), F.floor(F.col("pos") / width).alias("bucket"))
    ahead = rows.where((F.col("bucket") > 0) & (F.col("pos") % width < max_files)).withColumn("bucket", F.col("bucket") - 1)

    def jumps(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", ignore_index=True)
        pos, sizes = part["pos"].to_numpy(), part["size"].fillna(0).to_numpy()
        total = sizes.cumsum()
        own = int((pos // width == part["bucket"]).sum())
        nxt = [0] * own
        for i in range(own):
            end = int(total.searchsorted(total[i] - sizes[i] + max_bytes, side="right"))
            nxt[i] = max(i + 1, min(end, i + max_files, len(pos)))
        leave = [0] * own
        for i in range(own - 1, -1, -1):
            leave[i] = nxt[i] if nxt[i] >= own else leave[nxt[i]]
        part = part.iloc[:own].copy()
        part["next"], part["exit"] = pos[0] + pd.Series(nxt, dtype="int64"), pos[0] + pd.Series(leave, dtype="int64")
        return part[["pos", "size", "bucket", "next", "exit"]]

    known = stored(rows.unionByName(ahead).groupBy("bucket").applyInPandas(jumps, STARTS), "jumps")
    hops = known.select(F.col("pos").alias("at"), F.col("exit").alias("to"))
    reached = known.where("pos = 0").select(F.col("pos").alias("at"))
    while True:  # entries of buckets that the chain from 0 passes
        more = stored(reached.join(hops, "at").select(F.col("to").alias("at")).unionByName(reached).distinct(), "reached")
        if more.count() == reached.count():
            break
        reached = more
        hops = stored(hops.join(hops.select(F.col("at").alias("to"), F.col("to").alias("then")), "to", "left").select("at", F.coalesce("then", "to").alias("to")), "hops")
    entry = reached.select(F.col("at").alias("entry"), F.floor(F.col("at") / width).alias("bucket")).groupBy("bucket").agg(F.min("entry").alias("entry"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", ignore_index=True)
        low, nxt, shard, k = int(part["pos"][0]), part["next"].to_numpy(), [-1] * len(part), -1
        i = int(part["entry"][0]) - low
        while i < len(part):
            end = min(int(nxt[i]) - low, len(part))
            k += 1
            shard[i:end] = [k] * (end - i)
            i = int(nxt[i]) - low
        part["local"] = shard
        return part[["pos", "bucket", "local"]]

    local = stored(known.join(entry, "bucket").groupBy("bucket").applyInPandas(walk, "pos long, bucket long, local long"), "local")
    counts = local.groupBy("bucket").agg((F.max("local") + 1).alias("n"))
    from pyspark.sql import Window

    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # files before a bucket's entry end the last shard of the bucket before
    placed = local.join(offsets, "bucket").select("pos", (F.col("local") + F.col("offset")).alias("shard"))
    return at.join(placed, "pos")


def required_rows(rows: DataFrame, message: str) -> DataFrame:
    """rows, or an error if there are none: for the edges of a program, as it runs a job."""
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def flat_paths(rows: DataFrame, column: str, name: str = "path") -> DataFrame:
    """A row for each text in arrays of arrays; nulls, and texts of blanks only, are no paths."""
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.explode(F.flatten(F.filter(column, lambda x: x.isNotNull()))).alias(name)).where(F.col(name).isNotNull() & (F.trim(name) != ""))


def lineage(resolution: int | Column, model_resolution: int | Column, long_side: int | Column) -> Column:
    """What a record says of the data it was made from."""
    parts = {"high_resolution": resolution, "model_resolution": model_resolution, "resize_long_side": long_side}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(k) for k, v in parts.items()])


def latent_records(rows: DataFrame, values: str, shape: str, dataset: Column, variant: int = 0, dtype: str = "float32", params: Column | None = None) -> DataFrame:
    """rows with `record`: version, latents, variant, dataset and storage type, and further parameters if there are some."""
    fields = [F.lit(1).alias("version"), F.struct(F.col(shape).cast("array<int>").alias("shape"), F.col(values).cast("array<float>").alias("data")).alias("latents"), F.lit(variant).alias("variant"), dataset.alias("dataset"), F.lit(dtype).alias("storage_dtype")]
    return rows.withColumn("record", F.struct(*fields, *([params.alias("params")] if params is not None else [])))


def key_shape_faults(left: DataFrame, right: DataFrame, key: str, shape: str) -> DataFrame:
    """(key, fault, left, right): keys on one side only, and common keys of different shapes, in one join."""
    a, b = left.select(key, F.col(shape).alias("left")), right.select(key, F.col(shape).alias("right"))
    both = a.withColumn("__l", F.lit(True)).join(b.withColumn("__r", F.lit(True)), key, "full_outer")
    fault = F.when(F.col("__r").isNull(), "left").when(F.col("__l").isNull(), "right").when(~F.col("left").eqNullSafe(F.col("right")), "shape")
    return both.select(key, fault.alias("fault"), "left", "right").where("fault is not null")
