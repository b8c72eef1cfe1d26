"""Fill-in-middle transformation by a secondary sort of pieces.

A text is cut into units: each is white space and the run of other characters after it; white space at the end is a unit
of its own. Draws from a digest of seed and id choose where prefix and middle end, whether the text is rearranged and in
which order. A rearranged text leaves its task as pieces of whole units (a unit longer than a piece is cut between bytes),
keyed by row and output position. Rows are dealt by key and sorted within partitions, so that a task meets the pieces of
a row in output order and feeds them to one digest; no text is put together unless texts are asked for. The same pass finds
the marks in the stream of output bytes, gives what stands between them its original position, and a second deal and
sort streams the restored text into another digest. Plain texts are their own output: they travel as a header without pieces.

Cases: a null text is empty; a null id stands for the empty string in the draws; repeated rows are rows of their
own; empty texts and texts with a mark in them stay plain; an empty table gives an empty result; extra columns are ignored;
very long texts move piece by piece. Rows are keyed by where they stand in their partition, so `docs` has to be a table or
anything else whose tasks give the same rows in the same order when they are repeated, as scans do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import binary_buffers, read_table, small_batches, text_of

SEED, RATE, SPM_SHARE, PIECE = 42, 50, 80, 1 << 16
#: Marks in output order, and where the part behind each stands in the text.
ORDERS = {"psm": (b"<P>", b"<S>", b"<M>"), "spm": (b"<S>", b"<P>", b"<M>")}
PLACES = {b"<P>": 0, b"<M>": 1, b"<S>": 2}
HEAD = "row long, doc_id long, n long, form string, prefix_chars long, middle_chars long"
MOVED = HEAD + ", part int, at long, content binary"


def draw(k: int, id_col: str, seed: int = SEED) -> Column:
    """The k-th group of eight digits of the digest of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where the units of a text end, as byte offsets."""
    if not len(raw):
        return np.zeros(0, np.int64)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    return np.append(ends, len(raw))


def chunks(lo: int, hi: int, ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """[lo, hi) in stretches of at most `most` bytes that end where units end if they can."""
    while lo < hi:
        to = min(lo + most, hi)
        if to < hi:
            k = int(np.searchsorted(ends, to, side="right")) - 1
            to = int(ends[k]) if k >= 0 and ends[k] > lo else to
        yield lo, to
        lo = to


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


class _Rows:
    """Rows of MOVED in Arrow batches of bounded bytes."""

    def __init__(self, most: int = 1 << 22):
        self.rows: list[tuple] = []
        self.bytes, self.most = 0, most

    def add(self, *row) -> None:
        self.rows.append(row)
        self.bytes += len(row[-1] or b"") + 64

    def full(self) -> bool:
        return self.bytes >= self.most

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in MOVED.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows, strict=True), kinds, strict=True)], names)
        self.rows, self.bytes = [], 0
        return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE, piece: int = PIECE) -> DataFrame:
    """MOVED: a header of part -1 for each row, which holds the text's digest if it stays plain, and the pieces of the others by output position."""
    small_batches(docs.sparkSession)
    text = text_of(text_col)
    marked = F.exists(F.array(*[F.lit(m.decode()) for m in PLACES]), lambda m: F.contains(text, m))
    form = F.when((text == "") | marked | (draw(3, id_col, seed) % 100 >= rate), "plain").when(draw(4, id_col, seed) % 100 < spm_share, "spm").otherwise("psm")
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), form.alias("form"), draw(1, id_col, seed).alias("a"), draw(2, id_col, seed).alias("b"), text.cast("binary").alias("raw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows()
        for batch in batches:
            raw, offsets = binary_buffers(batch.column(5))
            heads = zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True)
            for (row, doc, form, a, b), lo, hi in zip(heads, offsets, offsets[1:], strict=False):
                body = raw[lo:hi]
                ends = unit_ends(body)
                n = len(ends)
                if form == "plain":
                    out.add(row, doc, n, form, None, None, -1, 0, hashlib.sha256(body).digest())
                else:
                    first, last = sorted((a % (n + 1), b % (n + 1)))
                    edges = [0, *(int(ends[k - 1]) if k else 0 for k in (first, last)), len(body)]
                    out.add(row, doc, n, form, code_points(body[: edges[1]]), code_points(body[edges[1] : edges[2]]), -1, 0, None)
                    at = 0
                    for part, mark in enumerate(ORDERS[form]):
                        place = PLACES[mark]
                        spans = list(chunks(edges[place], edges[place + 1], ends, piece)) or [(0, 0)]
                        for k, (s, e) in enumerate(spans):
                            out.add(row, None, None, None, None, None, part, at, (b"" if k else mark) + body[s:e].tobytes())
                            at += 1
                if out.full():
                    yield out.batch()
        if out.rows:
            yield out.batch()

    return given.mapInArrow(cut, MOVED)


def dealt(moved: DataFrame) -> DataFrame:
    """All pieces of a row in one task, in order, its header first. The sort spills; a task holds a batch of pieces at a time."""
    return moved.repartition("row").sortWithinPartitions("row", "part", "at")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True)


def assemble(moved: DataFrame) -> DataFrame:
    """Pieces in output order become headers with the output's digest (in `content`), and pieces keyed by their place in the text.

    Where parts begin is read from the output alone: marks are looked for in the stream, also across pieces.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, digest = _Rows(), None, None
        marks: list[bytes] = []
        place, at, carry = -1, 0, b""

        def put(content: bytes) -> None:
            nonlocal at
            if content:
                out.add(head[0], None, None, None, None, None, place, at, content)
                at += 1

        def close() -> None:
            put(carry)
            if head:
                out.add(*head[:6], -1, 0, digest.digest() if digest else head[8])

        for row in _streams(batches):
            if row[6] == -1:
                close()
                head, digest, place, at, carry = row, None, -1, 0, b""
                if row[3] != "plain":
                    digest, marks = hashlib.sha256(), list(ORDERS[row[3]])
            else:
                digest.update(row[8])
                carry += row[8]
                while marks and (found := carry.find(marks[0])) >= 0:
                    put(carry[:found])
                    place, carry = PLACES[marks.pop(0)], carry[found + 3 :]
                keep = min(2, len(carry)) if marks else 0  # a mark may go on in the next piece
                put(carry[: len(carry) - keep])
                carry = carry[len(carry) - keep :]
            if out.full():
                yield out.batch()
        close()
        if out.rows:
            yield out.batch()

    return dealt(moved).mapInArrow(stream, MOVED)


def restore(found: DataFrame) -> DataFrame:
    """Pieces by place become the digest of the restored text: HEAD, output_sha256, restored_sha256."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        head, digest = None, None
        names = [f.split()[0] for f in HEAD.split(", ")] + ["output_sha256", "restored_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

        def close() -> None:
            if head:
                rows.append((*head[:6], head[8].hex(), digest.hexdigest() if digest else head[8].hex()))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for row in _streams(batches):
            if row[6] == -1:
                close()
                head, digest = row, hashlib.sha256() if row[3] != "plain" else None
            else:
                digest.update(row[8])
            if len(rows) >= 5000:
                yield batch()
                rows.clear()
        close()
        if rows:
            yield batch()

    return dealt(found).mapInArrow(stream, HEAD + ", output_sha256 string, restored_sha256 string")


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: one row per row of docs."""
    return restore(assemble(pieces(docs, **options))).drop("row")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the texts themselves, each put together in its task from its sorted pieces."""
    moved = pieces(docs, id_col, text_col, **options)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        names = [*(f.split()[0] for f in HEAD.split(", ")), "output"]

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            text = None if head[3] == "plain" else b"".join(parts).decode()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*head[:6], text), kinds, strict=True)], names)

        for row in _streams(batches):
            if row[6] == -1:
                if head:
                    yield batch()
                head, parts = row, []
            else:
                parts.append(row[8])
        if head:
            yield batch()

    moved = dealt(moved).mapInArrow(stream, HEAD + ", output string")
    # plain texts are read again where they stand, their rows have the same numbers
    given = docs.select(F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("__text"))
    return moved.join(given, "row").withColumn("output", F.coalesce("output", "__text")).drop("row", "__text")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) % (len(u) + 1) AS p, CAST('0x' || s[9:16] AS BIGINT) % (len(u) + 1) AS q,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || s[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || s[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(u[1:least(p, q)], '') AS a, array_to_string(u[least(p, q) + 1:greatest(p, q)], '') AS b, array_to_string(u[greatest(p, q) + 1:n], '') AS c
  FROM drawn
), made AS (
  SELECT *, CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE t END AS o FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'psm' THEN regexp_replace(o, '^<P>(.*)<S>(.*)<M>(.*)$', '\1\3\2', 's')
                        WHEN 'spm' THEN regexp_replace(o, '^<S>(.*)<P>(.*)<M>(.*)$', '\2\3\1', 's') ELSE o END) AS restored_sha256
FROM made
"""
