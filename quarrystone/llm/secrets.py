"""Secret scans: base patterns, plus sliding-window Shannon entropy per character class. DataFrame functions only.

Matches get positions by marking them in the text (a character that is first removed from it) and splitting: the
lengths of the pieces are code points. Candidate strings are runs of letters, digits and + / _ = - of at least
`least` characters. A window slides over a candidate; the counts of its characters change by one in and one out a
step, and with them the sum of c log2 c, which gives the entropy; no window is counted anew. That is done per character class with a threshold for
each: for whole candidates as mixed letters and digits, and for the runs inside them that are hexadecimal digits of one case or base32, so that
a prefix of another class ("KEY=", "id-") takes nothing from what follows it. Base spans and plain sequences end a candidate; what stands
before or after them is judged for itself. Allow-listed strings (UUIDs, and strings made of one repeated part, digits, capitals, plain
words) are suppressed. What has a window that passes is a span `entropy`, unless a longer one holds it; base spans always stay.

Cases: a null or empty text has no spans; repeated rows get equal results; an empty table gives an empty result;
extra columns are ignored; positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import let, read_table, starts_of, text_of

ASSIGN = r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"([0-9a-f]{32,})"
CANDIDATE = r"([A-Za-z0-9+/_=-]{%d,})"
WINDOW, LEAST = 20, 20
#: Least entropy of a window in bits, by class: hexadecimal digits of one case; base32; mixed letters and digits.
HEX_BITS, BASE32_BITS, MIXED_BITS = 3.0, 3.4, 3.7
SEQUENCE = "(?i)(0123456789|abcdefghij)"
#: Runs of one class inside candidates.
HEX_RUNS, BASE32_RUNS = (r"([0-9A-F]{%d,})", r"([0-9a-f]{%d,})"), r"([A-Z2-7]{%d,}=*)"
#: Counters of the characters from + to z, of five bits, as many in a long as fit.
FIRST_CODE, PER_LONG, LONGS = 43, 12, 7
MARK, SPARE = "\x01", "\x02"


def _parts(text: Column, pattern: str) -> Column:
    """The text in parts; those at odd places are the matches of the pattern's first group, leftmost and not overlapping.

    The mark is a control character that no pattern matches; where a text holds it, its neighbour stands in (same length)."""
    return F.split(F.regexp_replace(F.translate(text, MARK, SPARE), pattern, f"{MARK}$1{MARK}"), MARK)


def _every(found: Column) -> Column:
    return F.lit(True)


def spans_of(text: Column, pattern: str, kind: str, keep=_every) -> Column:
    """array<struct<start, kind, end, found>> of the matches."""

    def spans(parts: Column, at: Column) -> Column:
        span = lambda part, i: F.struct(F.get(at, i).alias("start"), F.lit(kind).alias("kind"), (F.get(at, i) + F.length(part)).alias("end"), part.alias("found"))
        return F.filter(F.transform(parts, lambda part, i: F.when((i % 2 == 1) & keep(part), span(part, i))), lambda x: x.isNotNull())

    every = lambda parts: F.when(F.size(parts) > 1, let(starts_of(F.transform(parts, F.length)), lambda at: spans(parts, at))).otherwise(F.from_json(F.lit("[]"), SPAN))
    return let(_parts(text, pattern), every)


def masked(text: Column, pattern: str, keep=_every) -> Column:
    """The text with the matches blotted out, of the same length."""
    blot = lambda part, i: F.when((i % 2 == 1) & keep(part), F.repeat(F.lit(SPARE), F.length(part))).otherwise(part)
    return F.array_join(F.transform(_parts(text, pattern), blot), "")


SPAN = "array<struct<start:int,kind:string,end:int,found:string>>"


def passes(word: Column, bits: float | Column, window: int = WINDOW) -> Column:
    """Whether some window of the string has a Shannon entropy of so many bits at least, by incremental counts.

    State: the counts of characters, five bits each in a few longs, and s, the sum of c log2 c over them; entropy is log2(w) - s / w.
    A step moves one character in and one out. After the first window that passes, steps do nothing.
    """
    if not 0 < window < 32:
        raise ValueError("a window has 1 to 31 characters")
    gain = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    f = lambda c: F.get(gain, c)
    most = F.lit(float(window)) * (F.lit(math.log2(window)) - bits) + 1e-9
    long = lambda code: F.floor(code / PER_LONG).cast("int")
    place = lambda code: (code % PER_LONG * 5).cast("int")
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), place(code))
    count = lambda counts, code: F.call_function("shiftright", F.get(counts, long(code)), place(code)).bitwiseAND(F.lit(31).cast("long")).cast("int")
    moves = let(F.transform(F.split(word, ""), lambda c: F.ascii(c) - FIRST_CODE), lambda codes: F.transform(codes, lambda new, i: F.struct(new.alias("new"), F.get(codes, i - window).alias("old"))))

    def step(acc: Column, p: Column) -> Column:
        full = p["old"].isNotNull()
        came, gone = count(acc["counts"], p["new"]), count(acc["counts"], p["old"])
        s = acc["s"] + f(came + 1) - f(came) + F.when(full, f(gone - 1) - f(gone)).otherwise(0.0)
        moved = lambda v, k: v + F.when(k == long(p["new"]), one(p["new"])).otherwise(F.lit(0).cast("long")) - F.when(full & (k == long(p["old"])), one(p["old"])).otherwise(F.lit(0).cast("long"))
        n = acc["n"] + F.when(full, 0).otherwise(1)
        after = F.struct(F.transform(acc["counts"], moved).alias("counts"), s.alias("s"), n.alias("n"), ((n == window) & (s <= most)).alias("done"))
        return F.when(acc["done"] | (full & (p["new"] == p["old"])), acc).otherwise(after)

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(moves, zero, step, lambda acc: acc["done"])


def allowed(word: Column) -> Column:
    """Strings that are no secrets: UUIDs, digits, capitals, plain words, and strings of one repeated part. Every test takes time
    in proportion to the string."""
    uuid = word.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    plain = word.rlike(r"^[A-Za-z][A-Za-z_/+=-]*$") & ~word.rlike("[A-Za-z][A-Z]")
    head = F.left(word, F.length(word) - 8)  # what follows the last whole part may differ
    repeated = F.lit(False)
    for k in range(1, 9):
        again = F.left(F.repeat(F.left(word, F.lit(k)), (F.length(word) / k).cast("int") + 1), F.length(word) - 8)
        repeated = repeated | ((F.length(word) >= 2 * k + 8) & (head == again))
    return uuid | word.rlike("^(?:[0-9_=+/-]+|[A-Z_/+=-]+)$") | plain | repeated


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least: int = LEAST, hex_bits: float = HEX_BITS, base32_bits: float = BASE32_BITS, mixed_bits: float = MIXED_BITS
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    group2 = lambda found: F.length(F.regexp_extract(found, ASSIGN, 2)) >= 8
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    none = F.from_json(F.lit("[]"), SPAN)
    # cheap tests first: most texts hold no separator after a key word, and no long run
    has_key = F.lower("text").rlike(r"(?:passw|secret|token|api_?key)")
    has_run = F.col("text").rlike(r"[A-Za-z0-9+/_=-]{%d}" % min(16, least))
    rows = rows.select("doc_id", "text", has_key.alias("has_key"), has_run.alias("has_run"))
    bare = F.when(F.col("has_key"), masked(F.col("text"), ASSIGN, group2)).otherwise(F.col("text"))
    bare = masked(masked(masked(bare, ACCESS), HEX), SEQUENCE)
    rows = rows.select(
        "doc_id",
        F.when(F.col("has_key"), spans_of(F.col("text"), ASSIGN, "assign", group2)).otherwise(none).alias("assign"),
        F.when(F.col("has_run"), spans_of(F.col("text"), ACCESS, "access")).otherwise(none).alias("access"),
        F.when(F.col("has_run"), spans_of(F.col("text"), HEX, "hex")).otherwise(none).alias("hex"),
        F.when(F.col("has_run"), bare).alias("bare"),
    )
    secret = lambda pattern, bits: F.when(F.col("bare").rlike(pattern % least), F.filter(spans_of(F.col("bare"), pattern % least, "entropy", lambda found: ~allowed(found)), lambda x: passes(x["found"], bits, window))).otherwise(none)
    rows = rows.withColumns({"mixed": secret(CANDIDATE, mixed_bits), "of_class": F.concat(*[secret(p, hex_bits) for p in HEX_RUNS], secret(BASE32_RUNS, base32_bits))})
    # of what a passing candidate holds, it alone is a span; a string of two classes counts once, the longer one
    holds = lambda y, x: (y["start"] <= x["start"]) & (y["end"] >= x["end"])
    larger = lambda y, x: holds(y, x) & (y["end"] - y["start"] > x["end"] - x["start"])
    alone = F.filter(F.array_distinct("of_class"), lambda x: ~F.exists("mixed", lambda y: holds(y, x)) & ~F.exists("of_class", lambda y: larger(y, x)))
    rank = lambda x: F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).when(x["kind"] == "hex", 2).otherwise(3)
    order = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    said = lambda spans: F.array_join(F.transform(order(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    rows = rows.withColumn("entropy", F.concat("mixed", alone))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        said(F.concat("base", "entropy")).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))
