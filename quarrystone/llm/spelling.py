"""Spelling variants: near words by search schemes over bidirectional FM-indexes of the vocabulary, and the forms they lead to.

Words are counted in each task before they move. Two words within one edit agree in the first or in the second half of either, so each word is
entered under its possible first halves and second halves and looked up under its own two: near words meet wherever those
keys are dealt, and no task sees the whole vocabulary. A task takes its keys in order and builds an index of each block of
them: the delimited words, their suffix ranks by doubling, and the symbols before the suffixes with counts at every 64th row, for the
words forwards and backwards. A pattern is an interval of ranks in both at once and grows to either side: one half with its
delimiter is matched exactly, then the other is matched outwards with one replaced, inserted or deleted code point, all
patterns of a block together. A key under which more than `most` words stand is dealt into several blocks, each asked
by all of that key's words. Forms rise in counts by a factor of two at least, so roots need few rounds of pointer doubling.

Cases: null texts have no words; a null id stands for the empty string in the hash; repeated rows count again; ties of counts go to the
word that is smallest in code-point order; an empty table gives an empty result; extra columns are ignored; very long texts are
counted in bounded memory but for their distinct words; a very long word takes a step of its block for each code point.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import binary_buffers, drop_stored, read_table, slices, small_batches, small_side, stored, text_of

LEAST_CHARS, LEAST_COUNT, MODULUS = 5, 3, 97
#: Code points of words in a block's index, words under a key beyond which it is dealt out, patterns that are matched together.
BLOCK_CHARS, MOST_WORDS, TOGETHER = 1_000_000, 50_000, 8192
STEP, SIGMA = 64, 91


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, code points) of runs of A-Z, a-z and U+00C0 to U+00FF, which are those of a byte C3 and one more."""
    lower = raw | 0x20
    two = raw == 0xC3
    mask = (lower >= 97) & (lower <= 122) | two
    mask[1:] |= two[:-1]
    step = np.diff(mask.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(raw))]
    inner = inner[mask[inner] & mask[inner - 1]]  # texts that touch
    starts, ends = np.union1d(starts, inner), np.union1d(ends, inner)
    pairs = np.concatenate([[0], np.cumsum(two)])
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, ends - starts - (pairs[ends] - pairs[starts])


def crcs(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of bytes, going on from the values of `begin`; all stretches step together."""
    order = np.argsort(-sizes, kind="stable")
    live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    value, at = begin[order] ^ np.uint32(0xFFFFFFFF), starts[order]
    for k, m in enumerate(live):
        value[:m] = CRC[(value[:m] ^ raw[at[:m] + k]) & 0xFF] ^ value[:m] >> 8
    out = np.empty_like(value)
    out[order] = value ^ np.uint32(0xFFFFFFFF)
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """word, n: words of at least `least_chars` code points with at least `least_count` occurrences."""
    small_batches(docs.sparkSession)
    given = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).cast("binary").alias("raw"))

    def words(raw: np.ndarray, offsets: np.ndarray, heads: np.ndarray) -> pa.Table:
        starts, ends, row, chars = runs(raw, offsets)
        some = chars >= least_chars
        starts, sizes, row, chars = starts[some], (ends - starts)[some], row[some], chars[some]
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        hashes = crcs(low, starts, sizes, heads[row])
        hit = hashes % modulus == 0
        changed = []
        for s, n, c, h in zip(starts[hit], sizes[hit], chars[hit], hashes[hit], strict=True):
            word, k = low[s : s + n].tobytes().decode(), int(h) % int(c)
            if c > least_chars:
                changed.append(word[:k] + word[k + 1 :])
        starts, sizes = starts[~hit], sizes[~hit]
        first = np.cumsum(sizes) - sizes
        data = low[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))]
        plain = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(first, sizes.sum()).astype(np.int32)), pa.py_buffer(data))
        return pa.table({"word": pa.chunked_array([plain, pa.array(changed, pa.string())]), "n": pa.array(np.ones(len(sizes) + len(changed), np.int64))})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            out = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return out.rename_columns(["word", "n"] if out.column_names[0] == "word" else ["n", "word"]).select(["word", "n"])

        for batch in batches:
            heads = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
            raw, offsets = binary_buffers(batch.column(1))
            for lo, hi in slices(offsets, 2 << 20):
                held.append(words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], heads[lo:hi]))
                if sum(map(len, held)) > 600_000:
                    held = [merged()]
                    if len(held[0]) > 300_000:  # too many distinct ones to hold: they meet in the aggregation that follows
                        yield from held[0].combine_chunks().to_batches(50_000)
                        held = []
        if held:
            yield from merged().combine_chunks().to_batches(50_000)

    found = given.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words on end, where each begins): a to z are 1 to 26, U+00C0 to U+00FF 27 to 90; 0 delimits. Code-point order."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    flat = np.where(flat < 128, flat - 96, flat - 165).astype(np.uint8)
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


class Ranks:
    """Suffix ranks of delimited words in ascending order, as the symbols before the suffixes, with counts."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        k, sizes = len(offsets) - 1, np.diff(offsets)
        n = len(flat) + k + 1
        text = np.zeros(n, np.uint8)
        letters = np.arange(len(flat)) + np.repeat(np.arange(k), sizes) + 1
        text[letters] = flat
        delims = np.concatenate([offsets[:-1] + np.arange(k), [n - 1]])
        rest = np.repeat(delims[1:], sizes) - letters  # letters up to the delimiter
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        key = np.zeros(len(letters), np.uint64)
        for j in range(8):
            key = key << np.uint64(8) | np.where(j < rest, padded[letters + j], 0).astype(np.uint64)
        # a suffix that ends within eight letters is followed by its delimiter, which ranks by the word behind it: text order
        order = np.argsort(key, kind="stable")
        rank = np.zeros(n, np.int64)
        rank[delims] = np.arange(k + 1)
        sorted_key, ended = key[order], rest[order] < 8
        new = np.append(True, (sorted_key[1:] != sorted_key[:-1]) | ended[1:])[: len(order)]
        at = np.flatnonzero(new)
        rank[letters[order]] = k + 1 + np.repeat(at, np.diff(np.append(at, len(order))))
        h = 8
        while True:
            size = np.bincount(rank, minlength=n)
            tied = letters[size[rank[letters]] > 1]
            if not len(tied):
                break
            a, b = rank[tied], rank[tied + h]
            turn = np.lexsort((b, a))
            tied, a, b = tied[turn], a[turn], b[turn]
            group = np.append(True, a[1:] != a[:-1])
            inside = np.arange(len(a)) - np.maximum.accumulate(np.where(group, np.arange(len(a)), 0))
            change = group | np.append(True, b[1:] != b[:-1])
            rank[tied] = a + np.maximum.accumulate(np.where(change, np.arange(len(a)), 0)) - (np.arange(len(a)) - inside)
            h *= 2
        before = np.empty(n, np.uint8)
        before[rank] = text[np.arange(n) - 1]
        before[0] = SIGMA  # nothing stands before the text, and no pattern needs its last delimiter, which ranks behind the others
        blocks = n // STEP + 1
        self.n = n
        self.rows = np.concatenate([before, np.full(blocks * STEP - n, SIGMA, np.uint8)]).reshape(blocks, STEP)
        cells = (np.arange(1, n) // STEP + 1) * SIGMA + before[1:]
        counts = np.cumsum(np.bincount(cells, minlength=(blocks + 1) * SIGMA).reshape(blocks + 1, SIGMA), 0)[:blocks]
        #: Symbols below c among the rows before a block.
        self.below = np.concatenate([np.zeros((blocks, 1), np.int32), np.cumsum(counts, 1, dtype=np.int32)], 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=SIGMA))])

    def upto(self, c: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the first i rows have a symbol below c, and c."""
        b, r = i // STEP, i % STEP
        rows = self.rows[b]
        inside = np.arange(STEP) < r[:, None]
        less = self.below[b, c]
        return less + ((rows < c[:, None]) & inside).sum(1), self.below[b, c + 1] - less + ((rows == c[:, None]) & inside).sum(1)

    def all_upto(self, i: np.ndarray) -> np.ndarray:
        """For each symbol, how many of the first i rows have it."""
        b, r = i // STEP, i % STEP
        at = np.where(np.arange(STEP) < r[:, None], self.rows[b], SIGMA).astype(np.int64) + (np.arange(len(i)) * (SIGMA + 1))[:, None]
        return np.diff(self.below[b], axis=1) + np.bincount(at.ravel(), minlength=len(i) * (SIGMA + 1)).reshape(len(i), SIGMA + 1)[:, :SIGMA]


def grow(ranks: Ranks, own: np.ndarray, other: np.ndarray, size: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals with c put before each pattern in `ranks` (behind it in the other index): own start, other start, size."""
    less, same = ranks.upto(c, own)
    less2, same2 = ranks.upto(c, own + size)
    return ranks.first[c] + same, other + (less2 - less), same2 - same


class Index:
    """Distinct words in ascending order, forwards and backwards."""

    def __init__(self, words: list[str]):
        flat, offsets = codes_of(words)
        self.forward = Ranks(flat, offsets)
        self.backward = Ranks(*codes_of(sorted(w[::-1] for w in words)))

    def near(self, words: list[str], left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of a pattern, number of an indexed word one edit away): the first half stands if left, else the second.

        What can be seen as an edit of either half counts as one of the second half, so each pair is found from one side only.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(words), TOGETHER):
            for side in (True, False):
                mine = np.flatnonzero(left[lo : lo + TOGETHER] == side) + lo
                if len(mine):
                    q, w = self._matched([words[k] for k in mine], side)
                    found.append((mine[q], w))
        return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def _matched(self, words: list[str], side: bool) -> tuple[np.ndarray, np.ndarray]:
        flat, offsets = codes_of(words)
        size, half = np.diff(offsets), np.diff(offsets) // 2
        many = np.arange(len(words))
        # the half that stands is matched from the middle outwards, with the delimiter behind it; then the other half, the other way
        kept = half if side else size - half
        free = size - kept
        inward = offsets[:-1] + half
        stands = lambda q, j: flat[inward[q] - 1 - j] if side else flat[inward[q] + j]
        varies = lambda q, j: flat[inward[q] + j] if side else flat[inward[q] - 1 - j]
        first, second = (self.forward, self.backward) if side else (self.backward, self.forward)
        c = np.zeros(len(words), np.int64)
        c[kept > 0] = stands(many[kept > 0], 0)
        own, other, width = first.first[c], second.first[c], first.first[c + 1] - first.first[c]
        for j in range(1, int(kept.max()) + 1):
            q = many[(kept >= j) & (width > 0)]
            c = np.zeros(len(q), np.int64)
            c[kept[q] > j] = stands(q[kept[q] > j], j)
            own[q], other[q], width[q] = grow(first, own[q], other[q], width[q], c)
        q = many[width > 0]
        # states: pattern, start in the index that grows now, start in the other, size
        exact = (q, other[q], own[q], width[q])
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        edited, done = none, []
        for j in range(int(free.max()) + 1):
            q, a, b, n = exact
            inner = free[q] > j
            c = np.zeros(len(q), np.int64)
            c[inner] = varies(q[inner], j)
            # replaced or inserted: all symbols that stand next to the pattern anywhere
            before, after = second.all_upto(a), second.all_upto(a + n)
            counts = after - before
            below = np.cumsum(counts, 1) - counts
            counts[:, 0] = 0
            s, x = np.nonzero(counts)
            more = (q[s], second.first[x] + before[s, x], b[s] + below[s, x], counts[s, x])
            fresh = x != c[s]
            if side:
                insert = fresh
            elif j == 0:  # an insertion between the halves
                insert = np.zeros(len(x), bool)
            else:
                run = np.logical_and.reduce([varies(q, k) == varies(q, 0) for k in range(j)])  # free >= j here
                insert = fresh & ~(run[s] & (x == varies(q, 0)[s]))
            replace = fresh & inner[s]
            # deleted: of a run of equal symbols only the first
            last = varies(q, j - 1) if j else (np.zeros(len(q), np.int64) if side else flat[inward[q]])
            skip = inner & (c != last)
            at_j = [np.concatenate([e, m[insert]]) for e, m in zip(edited, more, strict=True)]
            eq = at_j[0]
            c1 = np.zeros(len(eq), np.int64)
            c1[free[eq] > j] = varies(eq[free[eq] > j], j)
            na, nb, nn = grow(second, at_j[1], at_j[2], at_j[3], c1)
            live = nn > 0
            end = live & (free[eq] == j)
            done.append((eq[end], (na if not side else nb)[end]))
            go = live & (free[eq] > j)
            edited = tuple(np.concatenate([u[go], m[replace], v[skip]]) for u, m, v in zip((eq, na, nb, nn), more, (q, a, b, n), strict=True))
            at = inner & (c > 0)
            a2, b2, n2 = grow(second, a[at], b[at], n[at], c[at])
            live = n2 > 0
            exact = (q[at][live], a2[live], b2[live], n2[live])
        # a finished pattern is the rank of one delimiter in the forward index, which is the number of the word behind it
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def keyed(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """key, salt, salts, asks, left, word, n: entries (asks false) and the word's own lookups (asks true)."""
    size = F.char_length("word")
    half = lambda m: F.floor(m / 2).cast("int")
    firsts = lambda m: F.struct(F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), half(m))).alias("key"), F.lit(True).alias("left"))
    # the second half of a word of m, for a word whose own second half is as long
    seconds = lambda m: F.struct(F.concat(F.lit(">"), F.substring(F.col("word"), size - (m - half(m)) + 1, m - half(m))).alias("key"), F.lit(False).alias("left"))
    entries = F.array_distinct(F.flatten(F.array(*[F.array(firsts(m), seconds(m)) for m in (size - 1, size, size + 1)])))
    entered = words.select("word", "n", F.explode(entries).alias("k"), F.lit(False).alias("asks"))
    asked = words.select("word", "n", F.explode(F.array(firsts(size), seconds(size))).alias("k"), F.lit(True).alias("asks"))
    entered, asked = (d.select(F.col("k.key").alias("key"), F.col("k.left").alias("left"), "asks", "word", "n") for d in (entered, asked))
    hot = entered.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("key", F.ceil(F.col("rows") / most).cast("int").alias("salts"))
    hot = stored(hot, "hot-halves")
    if hot.isEmpty():
        drop_stored(hot)
        return entered.unionByName(asked).withColumns({"salt": F.lit(0), "salts": F.lit(1)})
    hot = small_side(hot)
    entered, asked = (d.join(hot, "key", "left").withColumn("salts", F.coalesce("salts", F.lit(1))) for d in (entered, asked))
    entered = entered.withColumn("salt", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int"))
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return entered.unionByName(asked)


def _search(words: DataFrame, schema: str, answer, block_chars: int, most: int) -> DataFrame:
    """answer(words asked, their n, pattern numbers, indexed words, their n, indexed numbers) of each block, as batches of schema."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered: dict[str, int] = {}
        asked: list[tuple[str, int, bool]] = []
        chars, group, alone = 0, None, False

        def block() -> Iterator[pa.RecordBatch]:
            if not asked:
                return
            index = sorted(entered)
            counts = np.array([entered[w] for w in index], np.int64)
            found = Index(index) if index else None
            for lo in range(0, len(asked), 16 * TOGETHER):
                some = asked[lo : lo + 16 * TOGETHER]
                names = [a[0] for a in some]
                q, w = found.near(names, np.array([a[2] for a in some])) if found else (np.zeros(0, np.int64),) * 2
                yield from answer(names, np.array([a[1] for a in some], np.int64), q, index, counts, w)

        for batch in batches:
            for key, salt, salts, asks, left, word, n in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
                if (key, salt) != group:
                    # keys that are dealt out keep to themselves: a word may stand in several blocks under them
                    if chars >= block_chars or alone or salts > 1:
                        yield from block()
                        entered, asked, chars = {}, [], 0
                    group, alone = (key, salt), salts > 1
                if asks:
                    asked.append((word, n, left))
                elif word not in entered:
                    entered[word] = n
                    chars += len(word)
        yield from block()

    rows = keyed(words, most).select("key", "salt", "salts", "asks", "left", "word", "n")
    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "asks").mapInArrow(stream, schema)


def near_pairs(words: DataFrame, block_chars: int = BLOCK_CHARS, most: int = MOST_WORDS) -> DataFrame:
    """word, near: all pairs of distinct words (word, n) that differ by one code point, in both directions."""

    def answer(names, own, q, index, counts, w):
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in q], pa.string()), pa.array([index[k] for k in w], pa.string())], ["word", "near"])

    return _search(words, "word string, near string", answer, block_chars, most)


def variants(words: DataFrame, block_chars: int = BLOCK_CHARS, most: int = MOST_WORDS, factor: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n, if that is at least `factor` times the word's own. Two rows a word move."""

    def answer(names, own, q, index, counts, w):
        order = np.lexsort((w, -counts[w], q))
        q, w = q[order], w[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        best = np.full(len(names), -1)
        best[q[first]] = w[first]
        some = best >= 0
        top = pa.array(np.where(some, counts[best] if len(counts) else 0, 0), mask=~some)
        form = pa.array([index[k] if k >= 0 else None for k in best], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(own), pa.array(np.bincount(q, minlength=len(names))), form, top], ["word", "n", "n_near", "form", "form_n"])

    parts = _search(words, "word string, n long, n_near long, form string, form_n long", answer, block_chars, most)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form")))
    found = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    large = -F.col("best.m") >= factor * F.col("n")
    return found.select("word", "n", "n_near", F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word, root for every word that has a form: steps double until no root has a form itself."""
    step = stored(found.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if step.join(onward, "root", "left_semi").isEmpty():
            return step
        after = stored(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        drop_stored(step)
        step = after


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    words = stored(vocabulary(docs, id_col, text_col), "vocabulary")
    found = stored(variants(words, **options), "variants")
    drop_stored(words)
    out = found.join(roots(found), "word", "left").withColumn("root", F.coalesce("root", "word"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read_table(spark, sf_dir, "documents"))


#: CRC-32 by its table, made by the rule; near words by the three kinds of edit, each as an equality.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), lowered AS (
  SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL
), coded AS (
  SELECT run, n, hex(encode(d || ':' || run)) AS x FROM lowered WHERE length(run) >= 5
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM coded, crc
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1
), vocab AS (
  SELECT word, n FROM words WHERE length(word) >= 5 AND n >= 3
), cut AS (
  SELECT word, n, CAST(i AS BIGINT) AS i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM vocab, unnest(range(length(word))) u(i)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS m FROM cut a JOIN vocab b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
), best AS (
  SELECT word, near, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS k, count(*) OVER (PARTITION BY word) AS c FROM pairs
), forms AS (
  SELECT v.word, v.n, coalesce(b.c, 0) AS n_near, CASE WHEN b.m >= 2 * v.n THEN b.near END AS form, CASE WHEN b.m >= 2 * v.n THEN b.m END AS form_n
  FROM vocab v LEFT JOIN best b ON v.word = b.word AND b.k = 1
), climb AS (
  SELECT word, word AS top, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, depth + 1 FROM climb c JOIN forms f ON c.top = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(top, depth) AS root FROM climb GROUP BY word) r ON f.word = r.word
"""
