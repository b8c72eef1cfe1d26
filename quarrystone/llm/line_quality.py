"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line that isn't blank is a state, good or bad. Its features are shares of kinds of characters, repeated words, pairs of
words and lines, and length; those of the neighbouring lines count as well. Only documents are labelled: a good document is one whose
lines are all good, a bad one has a bad line at least, so the likelihood of a label is that of the path without a bad line, or of its
opposite, and its gradient is the difference of two forward-backward passes. Forward and backward messages are prefix
products of 2 x 2 matrices, taken for all lines of a batch at once by doubling. A document's quality is the mean of its lines' marginals for
good, weighted by length, brought to the scale of the labels by a logistic curve fitted on the same rows.

The field is fitted on at most `fit_docs` labelled documents (those whose hashes come first, each with at most `fit_lines` lines; longer ones
are scored but don't teach), so what reaches the driver is bounded: 4,000 x 256 lines of 19 numbers. Scoring reads every text whole.

Cases: null and blank texts have no lines and get the share of good ones among labels; without both labels every text gets
that share (0.5 without labels); null labels teach nothing, a document with both labels teaches both; repeated rows get equal
scores; a null id is no learning row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import binary_buffers, mix64, read_table, slices, small_batches, text_of

FIT_DOCS, FIT_LINES, THRESHOLD = 4000, 256, 0.3
NAMES = ["letters", "capitals", "digits", "symbols", "bars", "calls", "stops", "blanks", "length", "ends", "begins", "word_length", "same_word", "known_word", "known_pair", "one_word", "known_line"]
#: Marks that prose hardly uses.
SYMBOLS = b"#$%&*@^~+=<>\\_/{}[]"


def _classes() -> np.ndarray:
    """A bit for each kind of byte."""
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = 1
    kinds[65:91] |= 2
    kinds[48:58] = 4
    kinds[list(SYMBOLS)] = 8
    kinds[ord("|")] = 16
    kinds[list(b"!?")] = 32
    kinds[list(b".,;:")] = 64
    kinds[[32, *range(9, 14)]] = 128
    return kinds


CLASSES = _classes()


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the lines that aren't blank."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    solid = np.concatenate([[0], np.cumsum(CLASSES[raw] != 128)])
    some = solid[ends] > solid[starts]
    starts, ends = starts[some], ends[some]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _first_seen(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which values were there before with the same owner; owners are ordered."""
    order = np.lexsort((value, owner))
    seen = np.zeros(len(value), bool)
    seen[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    return seen


def line_features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines x NAMES, lengths in code points)."""
    kinds = CLASSES[raw]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[ends] - total[starts]).astype(np.float64)

    length = count((raw & 0xC0) != 0x80)
    by = {name: count(kinds & bit != 0) for name, bit in (("letters", 1), ("capitals", 2), ("digits", 4), ("symbols", 8), ("bars", 16), ("calls", 32), ("stops", 64), ("blanks", 128))}
    solid = kinds != 128
    step = np.diff(solid.astype(np.int8), prepend=0, append=0)
    w_start, w_end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = starts[(starts > 0) & solid[np.minimum(starts, len(raw) - 1)]]
    inner = inner[solid[inner - 1]]  # texts that touch without white space
    w_start, w_end = np.union1d(w_start, inner), np.union1d(w_end, inner)
    line = np.searchsorted(starts, w_start, side="right") - 1
    size = w_end - w_start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    letters = mix64((raw[np.repeat(w_start, size) + at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))
    word = np.add.reduceat(letters, first) if len(first) else np.zeros(0, np.uint64)
    words = np.bincount(line, minlength=len(starts)).astype(np.float64)
    share = lambda mask: np.bincount(line, mask, minlength=len(starts)) / np.maximum(words, 1)
    after = np.zeros(len(word), bool)
    after[1:] = line[1:] == line[:-1]
    before = np.concatenate([word[:1], word[:-1]])
    same = after & (word == before)
    pair = _first_seen(line, mix64(word + np.uint64(3) * before)) & after
    begin = np.searchsorted(line, np.arange(len(starts)))
    nth = np.arange(len(word)) - begin[line] + 1
    total = np.add.reduceat(mix64(word * np.uint64(2) + np.uint64(1)) * nth.astype(np.uint64), begin) if len(starts) else np.zeros(0, np.uint64)
    lasts = w_end[np.searchsorted(line, np.arange(len(starts)), side="right") - 1] - 1
    firsts = w_start[begin]
    columns = {name: by[name] / np.maximum(length, 1) for name in ("letters", "digits", "symbols", "bars", "calls", "stops", "blanks")}
    columns |= {
        "capitals": by["capitals"] / np.maximum(by["letters"], 1),
        "length": np.log1p(length) / 5,
        "ends": np.isin(raw[lasts], list(b".!?:\"')")),
        "begins": (kinds[firsts] & 2 > 0) | (raw[firsts] >= 0xC3),
        "word_length": np.log1p((length - by["blanks"]) / np.maximum(words, 1)),
        "same_word": share(same),
        "known_word": share(_first_seen(line, word)),
        "known_pair": share(pair),
        "one_word": words == 1,
        "known_line": _first_seen(row, total),
    }
    return np.stack([np.asarray(columns[n], np.float64) for n in NAMES], 1), length


def with_neighbours(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (nothing at a document's ends), first, last, and 1."""
    first = np.append(True, row[1:] != row[:-1])[: len(row)]
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))])


def prefix_products(m: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the product of its document's matrices up to it, scaled to 1, and the logarithm of the scale, by doubling."""
    m, scale, d = m.copy(), np.zeros(len(m)), 1
    longest = int(place.max()) + 1 if len(place) else 0
    while d < longest:
        at = np.flatnonzero(place >= d)
        m[at], scale[at] = m[at - d] @ m[at], scale[at - d] + scale[at]
        top = m[at].max((1, 2))
        m[at] /= top[:, None, None]
        scale[at] += np.log(top)
        d *= 2
    return m, scale


def forward_backward(unary: np.ndarray, moves: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of both states per line, pair marginals of each line with the one before, log Z at a document's last line).

    unary: the score of good over bad per line; moves[a, b]: the score of b after a. Pair marginals are 0 at first lines.
    """
    n = len(unary)
    first = np.append(True, row[1:] != row[:-1])[:n]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    place = np.arange(n) - begin
    last = np.append(row[1:] != row[:-1], True)[:n]
    end = np.minimum.accumulate(np.where(last, np.arange(n), n)[::-1])[::-1]
    emit = np.exp(np.stack([np.zeros(n), np.clip(unary, -30, 30)], 1))
    m = np.exp(moves)[None] * emit[:, None, :]
    head = m.copy()
    head[first] = 0
    head[first, 0] = emit[first]
    ahead, scale = prefix_products(head, place)
    alpha = ahead[:, 0]
    log_z = np.log(alpha.sum(1)) + scale
    # what follows a line: the products of the matrices behind it, from the end
    tail = np.empty_like(m)
    tail[:-1], tail[last] = m[1:], 0
    tail[last, :, 0] = 1
    behind, _ = prefix_products(tail[::-1].transpose(0, 2, 1), (end - np.arange(n))[::-1])
    beta = behind[::-1].transpose(0, 2, 1).sum(2)
    both = alpha * beta
    both /= both.sum(1, keepdims=True)
    pairs = np.zeros((n, 2, 2))
    at = np.flatnonzero(~first)
    pairs[at] = alpha[at - 1][:, :, None] * m[at] * beta[at][:, None, :]
    pairs[at] /= pairs[at].sum((1, 2), keepdims=True)
    return both, pairs, log_z


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 80, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps."""
    value, grad = f(x)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, used = grad.copy(), []
        for s, y in reversed(kept):
            used.append(s @ way / (s @ y))
            way -= used[-1] * y
        if kept:
            s, y = kept[-1]
            way *= s @ y / (y @ y)
        for (s, y), a in zip(kept, reversed(used), strict=True):
            way += (a - y @ way / (s @ y)) * s
        size = 1.0 if kept else 1.0 / max(1.0, float(np.linalg.norm(grad)))
        for _ in range(20):
            new = x - size * way
            new_value, new_grad = f(new)
            if new_value <= value - 1e-4 * size * (way @ grad):
                break
            size /= 2
        else:
            break
        if (new - x) @ (new_grad - grad) > 1e-10:
            kept = [*kept[1 - memory :], (new - x, new_grad - grad)]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x


@dataclass
class Model:
    weights: np.ndarray | None  # of features, on their own scale
    moves: np.ndarray
    slope: float
    shift: float
    share: float  # of good documents


def likelihood(x: np.ndarray, row: np.ndarray, good: np.ndarray, theta: np.ndarray, weight: float = 1.0) -> tuple[float, np.ndarray]:
    """Minus log likelihood of the documents' labels, and its gradient. theta: weights of features, then the four moves."""
    k = x.shape[1]
    moves = theta[k:].reshape(2, 2)
    unary = x @ theta[:k]
    inside = np.abs(unary) < 30
    both, pairs, log_z = forward_backward(unary, moves, row)
    unary = np.clip(unary, -30, 30)
    last = np.append(row[1:] != row[:-1], True)
    first = np.append(True, row[1:] != row[:-1])
    docs = np.cumsum(first) - 1
    path = np.bincount(docs, unary + np.where(first, 0, moves[1, 1]))
    p = np.clip(np.exp(path - log_z[last]), 1e-12, 1 - 1e-12)  # of no bad line
    value = -np.where(good, np.log(p), np.log1p(-p)).sum()
    # d log p = one path - expected; d log (1 - p) = -p / (1 - p) times that
    factor = np.where(good, 1.0, -p / (1 - p))[docs]
    by_line = factor * (1 - both[:, 1]) * inside
    one = np.zeros((2, 2))
    one[1, 1] = 1
    by_move = (factor[:, None, None] * (one - pairs))[~first].sum(0)
    return value + 0.5 * weight * theta @ theta, -np.concatenate([x.T @ by_line, by_move.ravel()]) + weight * theta


def _means(good: np.ndarray, length: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    total = np.bincount(row, length, minlength=rows)
    return np.bincount(row, good * length, minlength=rows) / np.maximum(total, 1)


def fit(own: np.ndarray, length: np.ndarray, row: np.ndarray, good: np.ndarray) -> Model:
    """own: features of lines; row: the document of each line, in order, all documents with a line; good: by document."""
    share = (float(good.sum()) + 1) / (len(good) + 2)
    if not good.any() or good.all():
        return Model(None, np.zeros((2, 2)), 1.0, 0.0, share)
    x = with_neighbours(own, row)
    middle, wide = x.mean(0), x.std(0) + 1e-3
    middle[-1], wide[-1] = 0, 1
    z = (x - middle) / wide
    theta = minimise(lambda t: likelihood(z, row, good, t), np.zeros(z.shape[1] + 4))
    k = z.shape[1]
    weights, moves = theta[:k] / wide, theta[k:].reshape(2, 2)
    weights[-1] -= (theta[:k] * middle / wide).sum()
    both, _, _ = forward_backward(x @ weights, moves, row)
    mean = _logit(_means(both[:, 1], length, row, len(good)))
    # a logistic curve through (mean, label), with labels drawn in a little so that it stays finite
    aim = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))

    def curve(t: np.ndarray) -> tuple[float, np.ndarray]:
        v = t[0] * mean + t[1]
        d = 1 / (1 + np.exp(-v)) - aim
        return float((np.logaddexp(0, v) - aim * v).sum()) + 0.01 * t @ t, np.array([d @ mean, d.sum()]) + 0.02 * t

    slope, shift = minimise(curve, np.array([1.0, 0.0]))
    return Model(weights, moves, max(float(slope), 0.0), float(shift), share)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> Model:
    """Fits on the labelled documents whose hashes come first. docs and labels: learning rows only."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("good")).where("id is not null and good in (0, 1)").distinct()
    known = known.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id", "good").limit(fit_docs)  # at most fit_docs rows, so they may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("raw"))
    rows = texts.join(F.broadcast(chosen), "id")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = binary_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                part, local = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, row = line_spans(part, local)
                if not len(starts):
                    continue
                own, length = line_features(part, starts, ends, row)
                few = np.bincount(row, minlength=hi - lo)[row] <= fit_lines
                own, length, row = own[few], length[few], row[few]
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                kind = pa.list_(pa.float32())
                flat = [pa.ListArray.from_arrays(pa.array(at * own.shape[1]), pa.array(own.astype(np.float32).ravel())).cast(kind), pa.ListArray.from_arrays(pa.array(at), pa.array(length.astype(np.float32))).cast(kind)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *flat], ["id", "good", "own", "length"])

    table = rows.mapInArrow(lines, "id long, good int, own array<float>, length array<float>").where("size(length) > 0").toPandas()
    table = table.sort_values(["id", "good"], kind="stable").reset_index(drop=True)
    if not len(table):
        return Model(None, np.zeros((2, 2)), 1.0, 0.0, 0.5)
    sizes = table["length"].map(len).to_numpy()
    own = np.concatenate(table["own"].to_list()).reshape(-1, len(NAMES)).astype(np.float64)
    return fit(own, np.concatenate(table["length"].to_list()).astype(np.float64), np.repeat(np.arange(len(table)), sizes), table["good"].to_numpy() == 1)


def score_lines(raw: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, chance to be good, length) of every line."""
    starts, ends, row = line_spans(raw, offsets)
    if not len(starts) or model.weights is None:
        return starts, ends, row, np.full(len(starts), model.share), np.ones(len(starts))
    own, length = line_features(raw, starts, ends, row)
    both, _, _ = forward_backward(with_neighbours(own.astype(np.float32).astype(np.float64), row) @ model.weights, model.moves, row)
    return starts, ends, row, both[:, 1], length


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, lines (array of start, end in bytes, and the chance that the line is good)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # some fifty weights
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("good", pa.float64())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = binary_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                part, local = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, row, good, length = score_lines(part, local, model)
                score = np.full(hi - lo, model.share)
                if model.weights is not None:
                    some = np.bincount(row, minlength=hi - lo) > 0
                    v = model.slope * _logit(_means(good, length, row, hi - lo)) + model.shift
                    score[some] = (1 / (1 + np.exp(-v)))[some]
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(starts - local[row]), pa.array(ends - local[row]), pa.array(good)], ["start", "end", "good"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.ListArray.from_arrays(pa.array(at), items).cast(kind)], ["doc_id", "score", "lines"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("raw"))
    return given.mapInArrow(label, "doc_id long, score double, lines array<struct<start:long,end:long,good:double>>")


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(fold() != 0), read_table(spark, sf_dir, "labels").where(fold() != 0))
    scored = predict(docs, model).withColumn("n_bad_lines", F.size(F.filter("lines", lambda x: x["good"] < 0.5)))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_bad_lines")
