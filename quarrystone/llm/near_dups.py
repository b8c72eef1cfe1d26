"""N-gram Jaccard join by parity sketches.

A document is the set of its 5-word shingles, as 64-bit hashes. Documents with equal sets form a class; classes link
when 100 * intersection >= 75 * union.

Sketch. Shingles are dealt by hash into m blocks, and a block is a bit vector in which each shingle flips one bit (XOR).
A shingle that only one of two sets holds changes one block, so two sets differ in at most |A xor B| blocks: the
Hamming distance of the sketches bounds the symmetric difference from below. For J >= 3/4 and sets of a and b elements,
|A xor B| <= (a + b) / 7, which is D = a / 3 at most for the smaller one.
Size bands. A band is an octave of sizes and has its own m. The sketch of a band serves pairs whose smaller set lies in it; the
larger one has at most 4/3 of its size, so a set is sketched for its own band, and for the one below if it is that close.
Pigeonhole join. All sets order their blocks alike, by a function of the block's content (rarest first: by the
corpus-wide count of its rarest shingle, from a table of 2^20 counters that covers all documents; then those of more bits),
and keep the first D + 1: at least m - D blocks agree, so one at least is kept by both. A key stands for (band, block,
content); its content is the XOR of its shingles' hashes, a linear code of the bit vector.
Candidates. Classes that share a key of at most `few` classes are compared. A parity sketch of at least two bits a shingle,
whose Hamming distance exceeds the bound, drops a pair; what remains is verified on the sets.
Crowds. What is left are pairs all of whose shared keys have more classes: both are members of the crowd, and its shingles are
counted exactly. Rarest first, similar sets share one of their first n - ceil(3 n / 4) + 1 shingles.
If that is in at most `few` sets, the pair is compared. If not, all that the two share is common: |A and B| is at most the number of
common shingles of either from the first shared one on, so 7 times that is 3 * (a + b) at least for both. Common shingles from which on
a set can't reach that with the smallest set that shares one are no keys, however many sets share a passage. Of the sets with equal common shingles the smallest
stands for those that must link with it (7 * common >= 3 * (a + b) suffices there). The rest, some sets a common part, meet
hubs, the sets that consist most of common shingles, key by key; in the end those outside a key's main component meet its other members.

Cases: null, empty and word-less texts have no shingles and link with nothing; fewer than five words give one shingle, the
whole sequence; a null id is no component's name (its own row then has a null one, unless linked); repeated rows are in
one class; an empty table gives an empty result; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import binary_buffers, drop_stored, mix64, read_table, slices, small_batches, small_side, stored, text_of

SHINGLE, FEW, HUB_ROUNDS = 5, 16, 2
#: Counters of shingles: 2^COUNTER_BITS, which travel in pieces of 2^PIECE_BITS.
COUNTER_BITS, PIECE_BITS = 20, 12
#: Least number of blocks of a sketch; keys of blocks whose rarest shingle is common are spread over SALTS tasks.
LEAST_BLOCKS, SALTS = 64, 64
U = np.uint64
#: A key: commonness, then the number of bits (more come first), then the hashed content.
COMMON_SHIFT, BITS_SHIFT, MOST_COMMON, MOST_BITS = 56, 52, 127, 15

_bytes = np.arange(256, dtype=np.uint8)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes)
WHITE = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
#: The first k bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
ODD = mix64(np.arange(1, SHINGLE + 2, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)


def _word_hashes(low: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of byte strings, eight bytes at a step; what lies beyond 128 bytes is digested at once."""
    at_byte = np.lib.stride_tricks.sliding_window_view(np.concatenate([low, np.zeros(8, np.uint8)]), 8)
    h, live = n.astype(U) * U(0x9E3779B97F4A7C15), np.arange(len(n))
    for done in range(0, 128, 8):
        if not len(live):
            break
        chunk = np.ascontiguousarray(at_byte[starts[live] + done]).view("<u8").ravel()
        h[live] = mix64((h[live] ^ (chunk & FIRST_BYTES[np.minimum(n[live] - done, 8)])) * ODD[0])
        live = live[n[live] > done + 8]
    for w in live:
        rest = low[starts[w] + 128 : starts[w] + n[w]].tobytes()
        h[w] ^= U(int.from_bytes(hashlib.blake2b(rest, digest_size=8).digest(), "little"))
    return h


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingle hashes of each row, one row after another."""
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    word, edge = ~WHITE[raw], np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | edge[1:])) + 1
    where = np.searchsorted(starts, offsets)  # the number of each row's first word
    count = np.diff(where)
    words = _word_hashes(LOWER[raw], starts, ends - starts)
    grams = np.zeros(len(words), U)
    for k in range(SHINGLE):
        grams[: len(words) - k] += words[k:] * ODD[k + 1]
    use = np.repeat(where[1:], count) - np.arange(len(words)) >= SHINGLE
    for r in np.flatnonzero((count > 0) & (count < SHINGLE)):
        a, b = where[r], where[r + 1]
        grams[a : a + 1], use[a] = np.add.reduceat(words[a:b] * ODD[1 : b - a + 1], [0]) + ODD[:1] * U(b - a), True
    grams = mix64(grams[use])
    bounds = np.concatenate([[0], np.cumsum(np.where(count >= SHINGLE, count - SHINGLE + 1, count > 0))])
    for a, b in zip(bounds, bounds[1:], strict=False):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[bounds[:-1][count > 0]] = True
    return grams[fresh], np.concatenate([[0], np.cumsum(fresh)])[bounds]


def class_ids(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit names of the sets; those of empty sets mean nothing."""
    n, out = np.diff(bounds), np.zeros(len(bounds) - 1, U)
    begins = bounds[:-1][n > 0]
    if len(begins):
        mixed = mix64(grams ^ U(0xA5A5A5A5A5A5A5A5))
        out[n > 0] = mix64(np.add.reduceat(mixed, begins) + U(31) * np.bitwise_xor.reduceat(mixed, begins) + n[n > 0].astype(U))
    return out.view(np.int64)


def sketches(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of 64 parity bits, bounds): each shingle flips one of w bits, the power of two from 2n up (256 at least). Half as
    wide, a sketch is its halves' XOR."""
    n = np.diff(bounds)
    width = np.where(n > 0, np.maximum(256, 1 << np.frexp(np.maximum(2 * n - 1, 1))[1].astype(np.int64)), 0)
    first = np.concatenate([[0], np.cumsum(width)])
    bit = (mix64(grams ^ U(0x1234567)) & np.repeat(width - 1, n).astype(U)).astype(np.int64) + np.repeat(first[:-1], n)
    bits = (np.bincount(bit, minlength=first[-1]) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64), first // 64


def counter(grams: np.ndarray) -> np.ndarray:
    """The number of each shingle's counter."""
    return (mix64(grams ^ U(0x5851F42D4C957F2D)) >> U(64 - COUNTER_BITS)).astype(np.int64)


def commonness(counts: np.ndarray) -> np.ndarray:
    """Steps of a factor of 1.4 above the mean count; whatever is near the mean is 0, as most of such a count is chance."""
    return np.clip(2 * np.log2(np.maximum(counts, 1) / max(1.0, counts.mean())), 0, MOST_COMMON - 1).astype(np.uint8)


def block_keys(grams: np.ndarray, bounds: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): for each set and band the first bound + 1 blocks in the common order. `common` goes with `grams`."""
    n = np.diff(bounds)
    rows = np.flatnonzero(n)
    low = np.int64(1) << (np.frexp(n[rows])[1].astype(np.int64) - 1)
    below = (low > 1) & (3 * n[rows] <= 4 * (low - 1))  # close enough to a set of the band below
    bound = np.concatenate([n[rows] // 3, (n[rows] + low - 1)[below] // 7])
    rows, low = np.concatenate([rows, rows[below]]), np.concatenate([low, low[below] >> 1])
    blocks, size = np.maximum(LEAST_BLOCKS, low + low // 4), n[rows]
    begin, salt = np.concatenate([[0], np.cumsum(size)]), mix64(low.astype(U) * U(0x9E3779B97F4A7C15))
    at = np.repeat(bounds[rows] - begin[:-1], size) + np.arange(begin[-1])
    # sorted by hash, shingles are sorted by block; their commonness travels in the low bits
    hashed = mix64(grams[at] ^ np.repeat(salt, size)) & ~U(MOST_COMMON) | common[at].astype(U)
    for a, b in zip(begin, begin[1:], strict=False):
        hashed[a:b].sort()
    block = (hashed >> U(32)) * np.repeat(blocks, size).astype(U) >> U(32)
    change = np.ones(len(block), bool)
    change[1:] = block[1:] != block[:-1]
    change[begin[:-1]] = True
    starts = np.flatnonzero(change)
    if not len(starts):
        return np.zeros(0, np.int64), rows
    content = np.bitwise_xor.reduceat(hashed & ~U(MOST_COMMON), starts)
    rare = np.minimum.reduceat(hashed & U(MOST_COMMON), starts)
    bits = np.minimum(np.diff(np.append(starts, len(block))), MOST_BITS).astype(U)
    used = np.searchsorted(starts, begin)  # the number of each entry's first block in use
    place = block[starts] * ODD[0] + np.repeat(salt, np.diff(used))
    keys = rare << U(COMMON_SHIFT) | (U(MOST_BITS) - bits) << U(BITS_SHIFT) | mix64(place ^ content) >> U(64 - BITS_SHIFT)
    out = []
    for e, (a, b) in enumerate(zip(used, used[1:], strict=False)):
        own = keys[a:b]
        own.sort()
        if len(own) <= bound[e]:  # empty blocks are keys too, the last in order
            empty = np.setdiff1d(np.arange(blocks[e], dtype=U), block[starts[a:b]])
            empty = U(MOST_COMMON) << U(COMMON_SHIFT) | mix64(empty * ODD[0] + salt[e]) >> U(64 - BITS_SHIFT)
            own = np.concatenate([own, np.sort(empty)])
        out.append(own[: bound[e] + 1])
    return np.concatenate(out).view(np.int64), np.repeat(rows, bound + 1)


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("raw"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, sorted shingle hashes, bounds) of some rows at a time."""
    for batch in batches:
        raw, offsets = binary_buffers(batch.column(1))
        for lo, hi in slices(offsets):
            grams, bounds = shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield batch.column(0).slice(lo, hi - lo), grams, bounds


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def classes_of_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds from one pass: doc_id, n, cls (null without shingles), sketch of each document, with a null piece; and
    piece, task, counts (packed), a task's counters, with nulls before."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary())
    names = ["doc_id", "n", "cls", "sketch", "piece", "task", "counts"]

    def rows_of(columns: list) -> pa.RecordBatch:
        most = max(len(c) for c in columns)
        return pa.RecordBatch.from_arrays([c if len(c) else pa.nulls(most, t) for c, t in zip(columns, types, strict=True)], names)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, task = np.zeros(1 << COUNTER_BITS, "<u4"), TaskContext.get().partitionId()
        for ids, grams, bounds in _each(batches):
            n = np.diff(bounds)
            yield rows_of([ids, pa.array(n), pa.array(class_ids(grams, bounds), mask=n == 0), _lists(*sketches(grams, bounds)), [], [], []])
            np.add.at(counts, counter(grams), 1)
        pieces = [(k, part) for k, part in enumerate(counts.reshape(-1, 1 << PIECE_BITS)) if part.any()]
        if pieces:
            yield rows_of([[], [], [], [], pa.array([k for k, _ in pieces], pa.int32()), pa.array([task] * len(pieces), pa.int32()), pa.array([zlib.compress(part.tobytes(), 1) for _, part in pieces])])

    return _sets(docs, id_col, text_col).mapInArrow(name, "doc_id long, n long, cls long, sketch array<long>, piece int, task int, counts binary")


def counted(rows: DataFrame) -> np.ndarray:
    """All counters, summed over tasks: some hundreds of tasks first, then those sums. The table has one size for any corpus."""

    def summed(keys: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), "<u8" if len(keys) == 1 else "<u4").astype("<u8") for x in table.column("counts").to_pylist())
        return pa.table({"piece": pa.array([keys[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = rows.where("piece is not null").select("piece", F.floor(F.col("task") / 256).alias("part"), "counts")
    parts = parts.groupBy("piece", "part").applyInArrow(summed, "piece int, counts binary")
    parts = parts.groupBy("piece").applyInArrow(summed, "piece int, counts binary")
    out = np.zeros((1 << COUNTER_BITS - PIECE_BITS, 1 << PIECE_BITS), np.int64)
    for row in parts.collect():
        out[row.piece] = np.frombuffer(zlib.decompress(row.counts), "<u8")
    return out.ravel()


def keyed(docs: DataFrame, id_col: str, text_col: str, common: np.ndarray) -> DataFrame:
    """(key, cls). Within a task a class gives its keys once, which combines copies before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # 1 MB

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, grams, bounds in _each(batches):
            names, n = class_ids(grams, bounds), np.diff(bounds)
            if len(seen) > 500_000:
                seen.clear()
            fresh = np.array([bool(k) and c not in seen and not seen.add(c) for c, k in zip(names.tolist(), n.tolist(), strict=True)], bool)
            grams, bounds = grams[np.repeat(fresh, n)], np.concatenate([[0], np.cumsum(n[fresh])])
            keys, rows = block_keys(grams, bounds, shared.value[counter(grams)])
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names[fresh][rows])], ["key", "cls"])

    return _sets(docs, id_col, text_col).mapInArrow(emit, "key long, cls long")


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, grams) of every row with shingles."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams, bounds in _each(batches):
            some = np.diff(bounds) > 0
            kept = np.append(bounds[:-1][some], bounds[-1])
            yield pa.RecordBatch.from_arrays([pa.array(class_ids(grams, bounds)[some]), _lists(grams, kept)], ["cls", "grams"])

    return _sets(docs, id_col, text_col).mapInArrow(emit, "cls long, grams array<long>")


def _read_sets(named: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, grams) of the named classes, from one document each."""
    named = stored(classes.join(named, "cls", "left_semi").select("cls", "rep"), "named")
    texts = docs.join(small_side(named.select("rep").distinct()), F.col(id_col).cast("long").eqNullSafe(F.col("rep")), "left_semi")
    sets = stored(sets_of(texts, id_col, text_col).join(small_side(named.select("cls")), "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    drop_stored(named)
    return sets


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, na, nb) of the pairs that may link by their sizes and sketches."""
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * 75)
    # sizes within 3 : 4 have sketches of one width or of two that differ by a factor of 2: the wider one is folded
    half = lambda c, other: F.when(F.size(c) > F.size(other), F.zip_with(F.slice(c, 1, F.size(other)), F.slice(c, F.size(other) + 1, F.size(other)), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    pairs_of_words = F.zip_with(half("sketcha", "sketchb"), half("sketchb", "sketcha"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(pairs_of_words, F.lit(0), lambda s, x: s + x)
    return stored(joined.where(differ * 7 <= F.col("na") + F.col("nb")).select("a", "b", "na", "nb"), "bounded")


def _verified(bounded: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by their sets."""
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("grams").alias(f"g{x}"))
    both = bounded.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("ga", "gb")))
    return stored(both.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * 75).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(cls, label) of all linked classes: the smallest class of the component, by least neighbours and pointer jumps."""
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("label")).select("cls", F.least("cls", "label").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.where("moved").isEmpty():
        near = edges.join(labels.select(F.col("cls").alias("b"), "label"), "b").select(F.col("a").alias("cls"), "label")
        least = labels.select("cls", "label").unionByName(near).groupBy("cls").agg(F.min("label").alias("least"))
        jump = labels.select(F.col("cls").alias("least"), F.col("label").alias("next"))
        after = least.join(jump, "least").select("cls", F.least("least", "next").alias("new"))
        before, labels = labels, stored(after.join(labels, "cls").select("cls", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "labels")
        drop_stored(before)
    drop_stored(edges)
    return labels.select("cls", "label")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: the components of the graph of old labels, which is as small as the new links."""
    of = lambda x: labels.select(F.col("cls").alias(x), F.col("label").alias(f"l{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    between = stored(between.distinct(), "between")
    if between.isEmpty():
        return labels
    more = components(between)
    old = labels.join(more.select(F.col("cls").alias("label"), F.col("label").alias("new")), "label", "left").select("cls", F.coalesce("new", "label").alias("label"))
    fresh = more.join(labels, "cls", "left_anti").select("cls", "label")
    out = stored(old.unionByName(fresh), "labels")
    drop_stored(between, more)
    return out


def _pairs_of_lists(rows: DataFrame, key: str) -> DataFrame:
    """Distinct pairs (a, b) of the classes that share a key. A key has few classes, and equal lists of classes give their pairs once."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_set("cls")).alias("cls")).where(F.size("cls") > 1).select("cls").distinct()
    each = F.transform("cls", lambda a, i: F.transform(F.slice("cls", i + 2, F.size("cls")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return lists.select(F.inline(F.flatten(each))).distinct()


def _can_link(common: Column, sizes: Column) -> Column:
    """Whether two sets that share so many common shingles at most, and no others, may link, by the sum of their sizes."""
    return common * 7 >= sizes * 3


def _crowd(sets: DataFrame, few: int) -> DataFrame:
    """For every set of the crowd: cls, n, common (how many of its shingles are in more than `few` sets), part (a name of these); and, of
    its first n - ceil(3 n / 4) + 1 shingles in order of their counts, those in at most `few` sets (rare) and in more (keys)."""
    rows = sets.select("cls", F.size("grams").alias("n"), F.explode("grams").alias("x"))
    counts = stored(rows.groupBy("x").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    found = rows.join(counts, "x").groupBy("cls").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "x"))).alias("found"))
    common = F.filter("found", lambda f: f["df"] > few)
    found = found.select("cls", "n", "found", common.alias("shared"), F.xxhash64(F.transform(common, lambda f: f["x"])).alias("part"))
    first = F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - (F.col("n") - F.size("found"))
    keys = F.slice("found", 1, F.greatest(first, F.lit(0)).cast("int"))
    of = lambda where: F.transform(F.filter(keys, where), lambda f: f["x"])
    out = stored(found.select("cls", "n", F.size("shared").alias("common"), "part", of(lambda f: f["df"] <= few).alias("rare"), of(lambda f: f["df"] > few).alias("keys")), "crowd")
    drop_stored(counts)
    return out


ROW = ("x", "cls", "n", "common")


def _trimmed(rows: DataFrame) -> DataFrame:
    """rows without keys of one set, and without those from which on a set has too few common shingles for the key's smallest set."""
    smallest = rows.groupBy("x").agg(F.min("n").alias("n0"), F.count("*").alias("size")).where("size > 1")
    return stored(rows.join(smallest, "x").where(_can_link(F.col("common"), F.col("n") + F.col("n0"))).select(*ROW), "common")


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows of keys that hold several components, with label and main, the key's largest component."""
    marked = rows.select(*ROW).join(labels, "cls", "left").select(*ROW, F.coalesce("label", "cls").alias("label"))
    sizes = marked.groupBy("x", "label").agg(F.count("*").alias("size"))
    keys = sizes.groupBy("x").agg(F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    return stored(marked.join(keys.select("x", F.col("top.label").alias("main")), "x"), "mixed")


def _meet(some: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of `some` rows with those of the same key that are in other components and may link."""
    one = some.select("x", F.col("cls").alias("c1"), F.col("n").alias("n1"), F.col("common").alias("k1"), F.col("label").alias("l1"))
    met = one.join(rows, "x").where((F.col("l1") != F.col("label")) & (F.least("n1", "n") * 4 >= F.greatest("n1", "n") * 3) & _can_link(F.least("k1", "common"), F.col("n1") + F.col("n")))
    return met.select(F.least("c1", "cls").alias("a"), F.greatest("c1", "cls").alias("b")).distinct()


def _link_crowd(sets: DataFrame, classes: DataFrame, labels: DataFrame, few: int) -> DataFrame:
    """labels after the links of the crowd."""
    crowd = _crowd(sets, few)

    def link(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        bounded = _bounded(pairs, classes)
        links = _verified(bounded, sets)
        after = relabelled(labels, links)
        drop_stored(bounded, links)
        return after

    labels = link(labels, _pairs_of_lists(crowd.select("cls", F.explode("rare").alias("x")), "x"))
    # from here on: links by common shingles alone
    able = crowd.where(_can_link(F.col("common"), F.col("n") * 7 / 4))
    least = able.groupBy("part").agg(F.min(F.struct("n", "cls")).alias("least")).select("part", F.col("least.n").alias("n0"), F.col("least.cls").alias("c0"))
    able = able.join(least, "part").withColumn("stands", F.col("cls") != F.col("c0")).withColumn("stands", F.col("stands") & _can_link(F.col("common"), F.col("n") + F.col("n0")))
    able = stored(able.select("cls", "n", "common", "keys", "c0", "stands"), "able")
    stars = stored(able.where("stands").select(F.col("cls").alias("a"), F.col("c0").alias("b")), "stars")
    labels = relabelled(labels, stars)
    # a row's `common` counts the set's common shingles from this one on: more can't be shared if this is the first that is
    rows = able.where("not stands").select("cls", "n", "common", F.posexplode("keys").alias("at", "x"))
    rows = _trimmed(_trimmed(rows.select("x", "cls", "n", (F.col("common") - F.col("at")).alias("common"))))
    for _ in range(HUB_ROUNDS):
        rows, before = _mixed(rows, labels), rows
        drop_stored(before)
        if rows.isEmpty():
            return labels
        best = lambda where: F.max(F.when(where, F.struct((F.col("common") / F.col("n")).alias("share"), "n", "cls")))["cls"]
        hubs = rows.groupBy("x").agg(best(F.col("label") == F.col("main")).alias("h1"), best(F.col("label") != F.col("main")).alias("h2"))
        marked = rows.join(hubs, "x").withColumn("is_hub", (F.col("cls") == F.col("h1")) | (F.col("cls") == F.col("h2")))
        before, marked = rows, stored(marked.select(*ROW, "label", "is_hub"), "hubs")
        drop_stored(before)
        labels = link(labels, _meet(marked.where("is_hub").drop("is_hub"), marked.drop("is_hub")))
        rows = marked.where("not is_hub")  # a hub has met all members of its key
    rows = _mixed(rows, labels)
    if rows.isEmpty():
        return labels
    return link(labels, _meet(rows.where("label <> main"), rows))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    both = stored(classes_of_rows(docs, id_col, text_col), "rows")
    rows = both.where("piece is null").select("doc_id", "n", "cls", "sketch")
    common = commonness(counted(both))
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "classes")
    # a common key is dealt over many tasks, and all its rows go on; of the others only those that several classes share
    is_common = F.shiftright("key", COMMON_SHIFT) > 0
    salted = keyed(docs, id_col, text_col, common).withColumn("salt", F.when(is_common, F.pmod("cls", F.lit(SALTS))).otherwise(0).cast("int"))
    of_key = Window.partitionBy("key", "salt")
    shared = salted.select("key", "cls", (is_common | (F.min("cls").over(of_key) < F.max("cls").over(of_key))).alias("use"))
    shared = stored(shared.where("use").select("key", "cls").distinct(), "shared")
    sizes = stored(shared.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    crowded = stored(shared.join(small_side(sizes.where(F.col("size") > few).select("key")), "key", "left_semi"), "crowded")
    single = shared.join(small_side(sizes.where(F.col("size") > few).select("key")), "key", "left_anti")
    bounded = _bounded(_pairs_of_lists(single, "key"), classes)
    members = stored(crowded.select("cls").distinct(), "members")
    drop_stored(shared, sizes, crowded)
    sets = _read_sets(bounded.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(members).distinct(), classes, docs, id_col, text_col)
    links = _verified(bounded, sets)
    labels = components(links)
    drop_stored(bounded, links)
    if not members.isEmpty():
        crowd = stored(sets.join(members, "cls", "left_semi"), "crowd_sets")
        drop_stored(sets)
        labels = _link_crowd(crowd, classes, labels, few)
        drop_stored(crowd, members)
    named = classes.join(labels, "cls", "left").select("cls", "rep", "copies", F.coalesce("label", "cls").alias("label"))
    tops = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    names = named.join(tops, "label").select("cls", "component_id")
    # rows alone in their component keep their own id, so that only others are joined
    joined = rows.select("doc_id", "n", "cls").join(names, "cls", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g),
s AS MATERIALIZED (SELECT doc_id, unnest(g) AS s FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.r = e.x)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(r.r) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
