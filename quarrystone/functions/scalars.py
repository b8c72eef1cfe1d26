"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def prompt_slug(text: Column, unicode: bool = True) -> Column:
    """Runs of non-word characters become one '_', lower case, 50 characters."""
    return F.substring(F.lower(F.regexp_replace(text, r"(?U)\W+" if unicode else r"\W+", "_")), 1, 50)


def run_slug(name: Column, unicode: bool = True) -> Column:
    """Letters, digits, '_', '-' and '.' stay; nothing left gives 'run'."""
    kept = F.regexp_replace(F.trim(name), r"(?U)[^\w.-]" if unicode else r"[^\w.-]", "_")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("run"))


def group_slug(name: Column) -> Column:
    return F.translate(name, "\\/ ", "___")


def or_default(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def download_name(url: Column, index: Column) -> Column:
    return F.format_string("image_%08d_%s.jpg", index, F.substring(F.md5(url.cast("binary")), 1, 16))


def url_basename(url: Column) -> Column:
    return F.element_at(F.split(F.parse_url(url, F.lit("PATH")), "/"), -1)


def literal_kind(text: Column) -> Column:
    """bool, int, float or str: the first that the text parses as."""
    return F.when(F.lower(text).isin("true", "false"), "bool").when(text.rlike(r"^[+-]?\d+$"), "int").when(text.try_cast("double").isNotNull(), "float").otherwise("str")


def human_size(size: Column) -> Column:
    """One decimal (halves to even) with a unit, base 1024."""
    value, out = size.cast("double"), None
    for k, unit in enumerate(["", "K", "M", "G", "T", "P", "E", "Z"]):
        said = F.format_string(f"%.1f {unit}B", F.bround(value / 1024.0**k, 1))
        small = F.abs(value) < 1024.0 ** (k + 1)
        out = F.when(small, said) if out is None else out.when(small, said)
    return out.otherwise(F.format_string("%.1f YB", value / 1024.0**8))


def fit_size(width: Column, height: Column, long_side: int) -> Column:
    """struct(width, height) scaled down so that the longer side fits; never up, at least 1, halves to even."""
    scale = F.least(F.lit(1.0), F.lit(float(long_side)) / F.greatest(width, height, F.lit(1)))
    side = lambda s: F.greatest(F.bround(s * scale), F.lit(1.0)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def quantize(x: Column, low: float, high: float, levels: int) -> Column:
    clipped = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.least(F.floor(F.lit(float(levels)) * (clipped - low) / (high - low)), F.lit(levels - 1)).cast("int")


def dequantize(q: Column, low: float, high: float, levels: int) -> Column:
    return (q + 0.5) * (high - low) / levels + low


def quality_to_factor(quality: Column) -> Column:
    return F.when(quality < 50, F.lit(5000.0) / quality).otherwise(F.lit(200.0) - quality * 2) / 100.0


def soft_round(x: Column) -> Column:
    return F.rint(x) + F.pow(x - F.rint(x), F.lit(3.0))


def to_uint8(x: Column, truncate: bool = False) -> Column:
    """[-1, 1] to 0..255, clamped; rounded half to even, or truncated."""
    scaled = (F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) + 1.0) / 2.0 * 255.0
    return (F.floor(scaled) if truncate else F.bround(scaled)).cast("int")


def from_uint8(q: Column) -> Column:
    return q / 255.0 * 2.0 - 1.0


def multistep_lr(step: Column, base: float, milestones: list[int], gamma: float = 0.1, restarts: tuple = (0,), weights: tuple = (1.0,)) -> Column:
    """The latest restart at or before the step gives the base; milestones after it, up to the step, multiply by gamma (repeated
    ones repeatedly); a milestone on the restart itself doesn't count."""
    out = None
    for start, weight in sorted(zip(restarts, weights, strict=True), reverse=True):
        passed = sum((F.when((F.lit(m) <= step) & (F.lit(m) > start), 1).otherwise(0) for m in milestones), F.lit(0))
        value = F.lit(base * weight) * F.pow(F.lit(gamma), passed.cast("double"))
        out = F.when(step >= start, value) if out is None else out.when(step >= start, value)
    return out.otherwise(F.lit(base))


def period_index(step: Column, cumulative: list[int]) -> Column:
    out = None
    for k, p in enumerate(cumulative):
        out = F.when(step <= p, k) if out is None else out.when(step <= p, k)
    return out


def cosine_lr(step: Column, base: float, periods: list[int], weights: list[float], eta_min: float = 0.0) -> Column:
    ends = [sum(periods[: k + 1]) for k in range(len(periods))]
    out = None
    for k, (end, period, weight) in enumerate(zip(ends, periods, weights, strict=True)):
        value = F.lit(eta_min) + F.lit(weight * 0.5 * (base - eta_min)) * (1 + F.cos(F.lit(math.pi) * ((step - (end - period)) / period)))
        out = F.when(step <= end, value) if out is None else out.when(step <= end, value)
    return out


def warmup(step: Column, lr: Column, warm: int) -> Column:
    return F.when(step < warm, lr * step / warm).otherwise(lr)


def worker_seed(workers: Column, rank: Column, worker: Column, seed: Column) -> Column:
    return workers * rank + worker + seed


def steps_per_epoch(rows: Column, ratio: float, batch: int, ranks: int) -> Column:
    return F.ceil(rows * F.lit(float(ratio)) / (batch * ranks))


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left at the mean pace so far; null before the first step."""
    return F.try_divide(elapsed, done) * (total - done)


def output_path(path: Column, root: str, out: str, suffix: str) -> Column:
    """Where the result for an input goes: its place below root with another suffix; the bare name if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    below = F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))
    return F.concat(F.lit(out.rstrip("/") + "/"), F.regexp_replace(below, r"\.[^./]+$", ""), F.lit(suffix))


def literal_value(text: Column) -> Column:
    """struct(kind, as_bool, as_int, as_float, as_string): the text's value in the field of its kind, null in the others."""
    kind = literal_kind(text)
    pick = lambda k, v: F.when(kind == k, v)
    return F.struct(kind.alias("kind"), pick("bool", F.lower(text) == "true").alias("as_bool"), pick("int", text.try_cast("long")).alias("as_int"), pick("float", text.try_cast("double")).alias("as_float"), pick("str", text).alias("as_string"))


def dtype_name(text: Column, known: list[str], default: str | None = None) -> Column:
    """The number type that a text names, with or without 'torch.'; null is the default, an unknown name an error."""
    name = F.element_at(F.split(F.lower(F.replace(text, F.lit(" "), F.lit(""))), r"\."), -1)
    return F.when(text.isNull(), F.lit(default)).when(name.isin(known), name).otherwise(F.raise_error(F.concat(F.lit("unsupported type: "), text)))


def time_stamp(at: Column) -> Column:
    """'20240131_235959'."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def in_megabytes(size: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f MB", size / 1048576.0)


def device_index(spec: Column) -> Column:
    """struct(index, status) of a device's name: 'cuda:3', 'gpu1' and '3' name one; blanks, 'auto', 'all' and 'cpu' none; the status says what is wrong with others."""
    text = F.trim(spec)
    number = F.trim(F.regexp_replace(text, r"^(?i:cuda|gpu):?", ""))
    none = text.isNull() | (text == "") | F.lower(text).isin("auto", "all", "cpu")
    status = F.when(none, "none").when(text.contains(","), "several").when(number == "", "empty").when(~number.rlike(r"^\d+$"), "unsupported").otherwise("ok")
    return F.struct(F.when(status == "ok", number).alias("index"), status.alias("status"))


def device_list(specs: Column) -> Column:
    """The different indexes of comma-separated names in order of their first mention; null if there are none. Names that are wrong are an error."""
    parts = F.filter(F.transform(F.split(specs, ","), lambda p: F.trim(p)), lambda p: p != "")
    found = F.transform(parts, device_index)
    wrong = F.filter(found, lambda x: ~x["status"].isin("ok", "none"))
    indexes = F.array_distinct(F.transform(F.filter(found, lambda x: x["status"] == "ok"), lambda x: x["index"]))
    checked = F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("no device: "), specs)).cast("array<string>")).otherwise(indexes)
    return F.when(F.size(checked) > 0, checked)


def duration(seconds: Column) -> Column:
    """'1:02:03', with days in front where there are some: '1 day, 0:00:07', '2 days, 0:00:00'. Fractions are cut off."""
    whole = F.floor(seconds).cast("long")
    days, rest = F.floor(whole / 86400).cast("long"), F.pmod(whole, F.lit(86400))
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600).cast("long"), F.floor(rest % 3600 / 60).cast("long"), (rest % 60).cast("long"))
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, "), clock))


def printed(values: Column, form: str | None = None, each: str = "") -> Column:
    """An array of doubles by one format, or each by its own, as C and Python print them: from the exact value, where format_string would
    round the shortest decimal that stands for it."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else form % tuple(r) if form else "".join(each % x for x in r) for r in rows], dtype=object)

    return text(values)


def step_message(name: Column, epoch: Column, step: Column, rates: Column, values: dict[str, Column], eta: Column | None = None, times: tuple[Column, Column] | None = None, fixed: bool = False) -> Column:
    """A line of a training log: experiment, epoch, step, learning rates, time left and taken if known, and values. Epoch and step fill 3 and 8
    characters; longer ones are written whole, or, if the columns are `fixed`, lose what exceeds them, as with lpad in SQL."""
    numbers = F.format_string("%3d", epoch), F.format_string("%,8d", step)
    if fixed:
        numbers = tuple(F.substring(x, 1, n) for x, n in zip(numbers, (3, 8), strict=True))
    parts = [F.format_string("[%s..][epoch:%s, step:%s, lr:(%s)] ", F.substring(name, 1, 5), *numbers, printed(rates, each="%.3e,"))]
    form, shown = "".join(k.replace("%", "%%") + ": %.4e " for k in values), list(values.values())
    if eta is not None and times is not None:
        parts.append(F.concat(F.lit("[eta: "), duration(eta)))
        form, shown = ", time (data): %.3f (%.3f)] " + form, [*times, *shown]
    if shown:
        parts.append(printed(F.array(*[x.cast("double") for x in shown]), form))
    return F.concat(*parts)
