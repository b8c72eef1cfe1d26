"""Language ID: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

Training counts hashed byte trigrams of every language over all labelled rows given (a table of 2^16 buckets a
language, whatever the corpus), and the scripts its letters come from. A text is split into words; the script of a
word's first letter leaves the languages that use it; a word's score in a language is the sum of its trigrams' log
probabilities. Viterbi with a switching penalty then labels spans, so that mixed texts get several; a text's language
is the one with most letters.

Cases: a null text, or one without a letter, is `und` with score 0; rows whose lang is null teach nothing; with nothing
to learn from every text is `und`; ties go to the first language in order; repeated rows get equal results;
an empty table gives an empty result; extra columns are ignored. Very long texts are decoded whole.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import binary_buffers, read_table, slices, small_batches, text_of

BITS, PENALTY, SCRIPT_SHARE = 16, 12.0, 0.002
#: First code points of script ranges; a letter's script is the range that holds it.
RANGES = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x1100, 0x1E00, 0x1F00, 0x2C00, 0x3040, 0x3400, 0xA000, 0xAC00, 0xD7B0]


@dataclass
class Model:
    names: list[str]
    scores: np.ndarray  # (2^BITS, languages) log probabilities
    scripts: np.ndarray  # (ranges, languages) whether a language uses a script


@functools.lru_cache(maxsize=1)
def _categories() -> np.ndarray:
    """By code point: 1 a letter, 2 a mark, which belongs to the letter before it, else 0."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _letters(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters, by Unicode category; marks do if they follow a letter of their row."""
    lower = raw | 0x20
    mask = (lower >= 97) & (lower <= 122)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        b = [raw[np.minimum(lead + k, len(raw) - 1)].astype(np.int64) for k in range(4)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        two, three, four = (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
        kind = _categories()[np.minimum(np.where(size == 2, two, np.where(size == 3, three, four)), 0x10FFFF)]

        def put(some: np.ndarray) -> None:
            for k in range(4):
                at = lead[some] + k
                mask[at[(k < size[some]) & (at < len(raw))]] = True

        put(np.flatnonzero(kind == 1))
        marks = np.flatnonzero(kind == 2)
        if len(marks):
            # what stands before a run of marks: the last code point that is no mark, in the same row
            other = (raw & 0xC0) != 0x80
            other[lead[marks]] = False
            before = np.maximum.accumulate(np.where(other, np.arange(len(raw)), -1))[lead[marks]]
            row = offsets[np.searchsorted(offsets, lead[marks], side="right") - 1]
            put(marks[(before >= row) & mask[before]])
    return mask


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of runs of letters; runs don't cross rows."""
    mask = _letters(raw, offsets)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    step = np.diff(mask.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = inner[mask[inner] & mask[inner - 1]] if len(inner) else inner
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, np.unique(cut)])), np.sort(np.concatenate([ends, np.unique(cut)]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _trigrams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams that centre on each byte of each word (with a blank at both ends), and where words begin among them."""
    n = ends - starts
    first = np.cumsum(n) - n
    at = np.repeat(starts - first, n) + np.arange(int(n.sum()))
    low = raw.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    # the second bytes of U+00C0..U+00DE, in lower case
    pair = np.flatnonzero(raw == 0xC3) + 1
    pair = pair[pair < len(raw)]
    pair = pair[(low[pair] >= 0x80) & (low[pair] <= 0x9E)]
    low[pair] += 32
    padded = np.concatenate([[np.uint8(32)], low, [np.uint8(32)]]).astype(np.uint32)
    before, after = padded[at].copy(), padded[at + 2].copy()
    before[first[n > 0]] = 32
    after[(first + n - 1)[n > 0]] = 32
    hashed = (before << 16 | padded[at + 1] << 8 | after) * np.uint32(2654435761)
    return hashed >> np.uint32(32 - BITS), first


def _script(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    b = [raw[np.minimum(starts + k, len(raw) - 1)].astype(np.int64) for k in range(3)]
    code = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 31) << 6 | (b[1] & 63), np.where(b[0] < 0xF0, (b[0] & 15) << 12 | (b[1] & 63) << 6 | (b[2] & 63), 0xD7B0)))
    return np.searchsorted(RANGES, code, side="right") - 1


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows with a text and a language; what reaches the driver is bounded by buckets times languages."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).cast("binary").alias("raw"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            raw, offsets = binary_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                part, local = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, row = _words(part, local)
                buckets, _ = _trigrams(part, starts, ends)
                owner = np.repeat(row, ends - starts)
                scripts = _script(part, starts) if len(starts) else np.zeros(0, np.int64)
                for lang in set(langs[lo:hi]):
                    mine = langs[lo:hi] == lang
                    table = grams.setdefault(lang, np.zeros((1 << BITS) + len(RANGES), np.int64))
                    table[: 1 << BITS] += np.bincount(buckets[mine[owner]], minlength=1 << BITS)
                    table[1 << BITS :] += np.bincount(scripts[mine[row]], minlength=len(RANGES))
        for lang, table in grams.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(table[at])], ["lang", "bucket", "n"])

    rows = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = rows.toPandas()
    names = sorted(table["lang"].unique())
    grams = np.zeros(((1 << BITS) + len(RANGES), len(names)))
    for k, name in enumerate(names):
        mine = table[table["lang"] == name]
        grams[mine["bucket"], k] = mine["n"]
    counts, scripts = grams[: 1 << BITS], grams[1 << BITS :]
    total = counts.sum(0)
    scores = np.log((counts + 0.5) / (total + 0.5 * (1 << BITS))).astype(np.float32)
    return Model(names, scores, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1))


def decode(scores: np.ndarray, first: np.ndarray, last: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of every word; texts are the word ranges [first, last). Texts of like length step together."""
    out = np.zeros(len(scores), np.int32)
    n, k = last - first, scores.shape[1]
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    lo = 0
    while lo < len(order):
        width = max(1, min(len(order) - lo, 1_600_000 // (int(n[order[lo]]) * max(k, 4)) + 1, 512))
        docs = order[lo : lo + width]
        lo += width
        steps = int(n[docs[0]])
        kind = np.int8 if k <= 127 else np.int32
        back = np.zeros((steps, len(docs), k), kind)
        own = np.arange(k, dtype=kind)
        live = np.searchsorted(-n[docs], -np.arange(steps), side="left")  # texts with more words than the step
        value = scores[first[docs]].astype(np.float64)
        for t in range(1, steps):
            m = live[t]
            v = value[:m]
            best = v.argmax(1)
            jump = v[np.arange(m), best] - penalty
            stay = v >= jump[:, None]
            back[t, :m] = np.where(stay, own, best[:, None])
            value[:m] = np.where(stay, v, jump[:, None]) + scores[first[docs[:m]] + t]
        state = value.argmax(1)
        for t in range(steps - 1, -1, -1):
            m = live[t] if t else len(docs)
            out[first[docs[:m]] + t] = state[:m]
            if t:
                state[:m] = back[t, np.arange(m), state[:m]]
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (share of letters in that language), spans (array of start byte, end byte, lang)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets times languages, 256 KB a language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.names, "und"], dtype=object)
        for batch in batches:
            raw, offsets = binary_buffers(batch.column(1))
            rows = len(offsets) - 1
            pred, share, spans = np.full(rows, len(names) - 1), np.zeros(rows), [[] for _ in range(rows)]
            for lo, hi in slices(offsets, 4 << 20) if model.names else ():
                part, local = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, row = _words(part, local)
                if not len(starts):
                    continue
                buckets, first = _trigrams(part, starts, ends)
                scores = np.stack([np.add.reduceat(model.scores[:, k][buckets], first) for k in range(len(model.names))], 1)
                allowed = model.scripts[_script(part, starts)]
                allowed |= ~allowed.any(1, keepdims=True)
                scores[~allowed] -= 1e4
                words = np.searchsorted(row, np.arange(hi - lo + 1))
                best = decode(scores, words[:-1], words[1:], penalty)
                letters = np.zeros((hi - lo, len(model.names)))
                np.add.at(letters, (row, best), ends - starts)
                top, total = letters.argmax(1), letters.sum(1)
                some = total > 0
                pred[lo:hi][some], share[lo:hi][some] = top[some], letters.max(1)[some] / total[some]
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(best) != 0), [True]]))
                for a, b in zip(edge, edge[1:], strict=False):
                    spans[lo + row[a]].append({"start": int(starts[a] - local[row[a]]), "end": int(ends[b - 1] - local[row[a]]), "lang": names[best[a]]})
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[pred], pa.string()), pa.array(share), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("raw"))
    return given.mapInArrow(label, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(fold() != 0))
    return predict(docs, model).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
