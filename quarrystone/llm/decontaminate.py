"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers, units after numbers and names (capitalised words inside a sentence) become typed placeholders, the rest lower case.
Windows of `window` words of the benchmark are hash-joined with those at every position of every document, as canonical words
and, where they hold placeholders, as plain lower-case words too, so that literal copies match whatever became a placeholder.
Matches of a document with an item are gathered over the item's positions; placeholders are
then compared: an item's slot value must stand for one and the same value all along the match (the values may differ
from the item's, which is a re-parameterised question); windows with a contradictory slot are no copy. A document is contaminated by
an item if at least `share` of the item's words lie in matched windows with consistent slots.

Cases: null or empty texts and items match nothing; an item shorter than a window is one window of its own
length (its length joins with documents' windows of that length); windows of mostly placeholders are used as plain words only,
unless the item's others cover less than `share` of it; runs of white space are one blank; items with equal canonical words whose slots repeat
alike are a class and give one row a document, under the smallest id and with their number, so that rows don't grow with documents times items of a
template; repeated rows count once; of items that share an id the one with the largest share counts; rows with a null
doc_id can't be reported; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read_table, small_side, stored, text_of, without

WINDOW, SHARE = 8, 0.5
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = "km|cm|mm|kg|mg|ml|mph|m|g|s|h|l|miles?|meters?|metres?|kilometers?|feet|foot|inch(?:es)?|pounds?|grams?|kilograms?|liters?|litres?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent"
#: Between a digit and a digit, a point or comma is part of the number; the middle dot keeps it one word.
INNER = "·"
#: White space that is no single blank.
SPACES = r"[\s\p{Z}&&[^ ]][\s\p{Z}]*| [\s\p{Z}]+"


def _words(text: Column) -> Column:
    """Words of letters, digits and placeholders; both the plain and the canonical text give as many."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}\x{E000}-\x{E002}\x{B7}]+"), "")


def plain(text: Column) -> Column:
    """The text with placeholders' characters gone, single blanks, numbers as one word each, and a blank between digits and letters."""
    clean = F.regexp_replace(F.translate(text, NAME + NUMBER + UNIT + INNER, "    "), SPACES, " ")
    numbered = F.regexp_replace(F.regexp_replace(clean, r"(?<=\p{N})[.,](?=\p{N})", INNER), r"(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{N})", " ")
    return F.when(clean.rlike(r"\p{N}"), numbered).otherwise(clean)


def canonical(body: Column) -> Column:
    """A plain text with typed placeholders: one word for one word."""
    names = F.regexp_replace(body, r"(?<=[\p{Ll}\p{N},;] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", NAME)
    numbers = F.regexp_replace(F.regexp_replace(names, r"\p{N}[\p{N}\x{B7}]*", NUMBER), rf"(?i)(?<={NUMBER} )(?:{UNITS})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.when(body.rlike(r"\p{N}"), numbers).otherwise(names)


def is_slot(word: Column) -> Column:
    return word.isin(NAME, NUMBER, UNIT)


def _windows(c: Column, w: Column, k: int) -> Column:
    """(pos, h) of all windows of k canonical words, and of the plain words of those with placeholders."""
    at = F.sequence(F.lit(1), F.greatest(F.size(c) - (k - 1), F.lit(1)))
    hashed = lambda words, places: F.transform(places, lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.slice(words, i, k)).alias("h")))
    slots = F.filter(F.transform(c, lambda x, i: F.when(is_slot(x), i + 1)), lambda i: i.isNotNull())
    slotted = F.array_distinct(F.flatten(F.transform(slots, lambda i: F.sequence(F.greatest(i - (k - 1), F.lit(1)), F.greatest(F.least(i, F.size(c) - (k - 1)), F.lit(1))))))
    every = F.when(w.isNull(), hashed(c, at)).otherwise(F.concat(hashed(c, at), hashed(w, slotted)))
    return F.when(F.size(c) >= k, every)


def item_classes(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """cid, item_id (smallest), items, c, pattern, members (the different plain word lists), n (words), k (window length); bounded by the benchmark.

    A class is the items of equal canonical words whose slots are equal to each other in the same places: `pattern` has, for a slot, the
    first slot of the same value.
    """
    body = benchmark.select(F.col(id_col).alias("item_id"), plain(text_of(text_col)).alias("body"))
    items = body.select("item_id", _words(canonical(F.col("body"))).alias("c"), _words(F.col("body")).alias("plain")).where(F.size("c") > 0)
    values = F.transform("c", lambda x, i: F.when(is_slot(x), F.get("plain", i)))
    items = items.withColumn("values", values).withColumn("pattern", F.transform("values", lambda v: F.array_position("values", v)))
    classes = items.groupBy("c", "pattern").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("items"), F.collect_set("plain").alias("members"))
    return classes.select(F.xxhash64("c", "pattern", "item_id").alias("cid"), "item_id", "items", "c", "pattern", "members", F.size("c").alias("n"), F.least(F.size("c"), F.lit(window)).alias("k"))


def bench_windows(classes: DataFrame, share: float = SHARE) -> DataFrame:
    """cid, n, k, ipos, h, slotted (holds slots), literal (the words of an item, not its placeholders)."""
    part = lambda words, i: F.slice(words, i, F.col("k"))
    starts = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("k") + 1), lambda i: F.struct((i - 1).alias("ipos"), F.xxhash64(part("c", i)).alias("h"), F.transform("members", lambda m: F.xxhash64(part(m, i))).alias("own"), F.size(F.filter(part("c", i), is_slot)).alias("slots")))
    rows = classes.select("cid", "n", "k", starts.alias("parts"))
    light = F.filter("parts", lambda x: x["slots"] * 2 <= F.col("k"))
    reach = F.size(F.array_distinct(F.flatten(F.transform(light, lambda x: F.sequence(x["ipos"], x["ipos"] + F.col("k") - 1)))))
    parts = rows.select("cid", "n", "k", (reach < F.col("n") * share).alias("heavy"), F.explode("parts").alias("x"))
    use = (F.col("x.slots") * 2 <= F.col("k")) | F.col("heavy") | (F.col("n") == F.col("k"))
    one = lambda h, literal: F.struct(h.alias("h"), F.lit(literal).alias("literal"))
    kinds = F.concat(F.transform(F.array_distinct("x.own"), lambda h: one(h, True)), F.when(use & (F.col("x.slots") > 0), F.array(one(F.col("x.h"), False))).otherwise(F.array().cast("array<struct<h:bigint,literal:boolean>>")))
    each = parts.select("cid", "n", "k", "x.ipos", (F.col("x.slots") > 0).alias("slotted"), F.inline(kinds))
    return each.groupBy("cid", "n", "k", "ipos", "slotted", "h").agg(F.max("literal").alias("literal"))


def _reach(starts: Column) -> Column:
    """Positions of the words in windows of k words at the starts."""
    return F.array_distinct(F.flatten(F.transform(starts, lambda a: F.sequence(a, a + F.col("k") - 1))))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """One row per contaminated document and class of items: doc_id, item_id, items, item_words, covered, share, n_slots, same_slots (every
    slot of the match stands literally in an item of the class)."""
    classes = stored(item_classes(benchmark, item_col, item_text_col, window), "classes")
    bench = stored(bench_windows(classes, share), "bench")
    lengths = sorted(r["k"] for r in classes.select("k").distinct().collect())  # at most `window` numbers
    # one row per hash, so that the join makes a row per matching window of a document, whatever the benchmark repeats
    hashes = stored(bench.select("h", "k").distinct(), "hashes")
    rows = docs.select(F.col(id_col).alias("doc_id"), plain(text_of(text_col)).alias("body")).where("doc_id is not null")
    rows = rows.select("doc_id", _words(canonical(F.col("body"))).alias("c"), "body")
    rows = rows.select("doc_id", "c", F.when(F.exists("c", is_slot), _words(F.col("body"))).alias("w"))
    found = None
    for k in lengths:
        part = rows.select("doc_id", F.inline(_windows(F.col("c"), F.col("w"), k)))
        part = part.join(small_side(hashes.where(F.col("k") == k).select("h")), "h").select("doc_id", "pos", "h", F.lit(k).alias("k"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select("doc_id", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("k")).limit(0)
    found = stored(found.distinct(), "windows")
    matches = found.join(small_side(bench), ["h", "k"]).select("doc_id", "cid", "n", "k", "pos", "ipos", "slotted", "literal")
    # a diagonal is one alignment of a document with a class; its size is bounded by the items'
    diagonal = matches.groupBy("doc_id", "cid", "n", "k", (F.col("pos") - F.col("ipos")).alias("diag")).agg(F.collect_set("ipos").alias("at"), F.collect_set(F.when(F.col("literal"), F.col("ipos"))).alias("said"), F.max("slotted").alias("slotted"))
    diagonal = diagonal.select("doc_id", "cid", "n", "k", "diag", "slotted", "said", F.col("at").alias("starts"), _reach(F.col("at")).alias("at"))
    # alignments that could matter, before texts are read again for their slots
    enough = diagonal.groupBy("doc_id", "cid").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("reach"), F.max("n").alias("whole")).where(F.col("reach") >= F.col("whole") * share)
    diagonal = stored(diagonal.join(enough.select("doc_id", "cid"), ["doc_id", "cid"], "left_semi"), "diagonals")
    checked = _slots(diagonal.where("slotted"), docs, classes, id_col, text_col)
    simple = diagonal.where("not slotted").select("doc_id", "cid", "n", "at", F.lit(0).alias("n_slots"), F.lit(True).alias("same"))
    total = simple.unionByName(checked).groupBy("doc_id", "cid").agg(F.max("n").alias("item_words"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("covered"), F.sum("n_slots").alias("n_slots"), F.min("same").alias("same_slots"))
    total = total.where(F.col("covered") >= F.col("item_words") * share).withColumn("share", F.col("covered") / F.col("item_words"))
    named = total.join(small_side(classes.select("cid", "item_id", "items")), "cid")
    kept = ["share", "item_words", "items", "covered", "n_slots", "same_slots"]
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct(*kept)).alias("b"))  # items that share an id
    return best.select("doc_id", "item_id", *[F.col(f"b.{c}").alias(c) for c in ("items", "item_words", "covered", "share", "n_slots", "same_slots")])


def _slots(diagonal: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Alignments without the windows that hold a contradictory slot: doc_id, cid, n, at, n_slots, same."""
    ids = stored(diagonal.select(F.col("doc_id").alias("wanted")).distinct(), "slotted")
    texts = docs.join(small_side(ids), F.col(id_col) == F.col("wanted"), "left_semi").dropDuplicates([id_col, text_col])
    texts = texts.select(F.col(id_col).alias("doc_id"), _words(plain(text_of(text_col))).alias("doc_words"))
    joined = diagonal.join(texts, "doc_id").join(small_side(classes.select("cid", "pattern")), "cid")
    slots = F.filter("at", lambda p: F.get("pattern", p).isNotNull())
    pairs = F.transform(slots, lambda p: F.struct(p.alias("p"), F.get("pattern", p).alias("theirs"), F.try_element_at("doc_words", F.greatest(F.col("diag") + p + 1, F.lit(1))).alias("ours")))
    joined = joined.select("doc_id", "cid", "n", "k", "starts", "said", pairs.alias("pairs"))
    clash = F.filter("pairs", lambda x: F.exists("pairs", lambda y: (x["theirs"] == y["theirs"]) & ~x["ours"].eqNullSafe(y["ours"])))
    joined = joined.select("doc_id", "cid", "n", "k", "starts", "said", "pairs", clash.alias("clash"))
    kept = lambda starts: F.filter(starts, lambda s: ~F.exists("clash", lambda x: (x["p"] >= s) & (x["p"] < s + F.col("k"))))
    joined = joined.select("doc_id", "cid", "n", "pairs", _reach(kept("starts")).alias("at"), F.coalesce(_reach(kept("said")), F.array().cast("array<int>")).alias("said")).where(F.size("at") > 0)
    joined = joined.select("doc_id", "cid", "n", "at", "said", F.filter("pairs", lambda x: F.array_contains("at", x["p"])).alias("pairs"))
    return joined.select("doc_id", "cid", "n", "at", F.size("pairs").alias("n_slots"), F.forall("pairs", lambda x: F.array_contains("said", x["p"])).alias("same"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without contaminated rows."""
    return without(docs, contaminated(docs, benchmark, **options).select("doc_id"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
