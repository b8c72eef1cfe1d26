"""WARC archives with one Zstandard dictionary each.

Pages are dealt by hash into archives of about `archive_mb` of payload. A task takes the records of an archive in blocks of
bounded size, builds a dictionary from records spread over the block (at most `train_bytes` of them, of each the first 16,384 bytes;
only the dictionary depends on that, records are written whole), puts it in a
leading skippable frame (magic 0x184D2A5D) and compresses every record as a frame of its own. Of records with equal
payloads, the one with the largest id is a response; the others become revisit records, which hold no payload.
An archive is a row (archive, content), stored as Parquet in the shared folder, since only Spark's own writers reach every
store; `export` writes them as .warc.zst files.

Cases: null html is an empty payload; null url is an empty target; a null id has no record number, loses against any
id and is null again when read back; rows that repeat the winning id are all responses; payloads are equal when length
and SHA-256 are; an empty table gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read_table, small_batches, stored, text_of

MAGIC = 0x184D2A5D
ARCHIVE_MB, DICT_BYTES, TRAIN_BYTES, LEVEL = 16, 32_768, 1 << 20, 3
DATE = "2020-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record: headers, HTTP headers with the full payload's length, then the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    name = "none" if page_id is None else str(page_id)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>"]
    lines += ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def train(records: list[bytes], dict_bytes: int = DICT_BYTES, train_bytes: int = TRAIN_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread evenly over all given; too few for training give their own bytes as content."""
    step = max(1, -(-sum(map(len, records)) // train_bytes))
    some = [r[:16_384] for r in records[::step]]
    if len(some) >= 8 and sum(map(len, some)) >= 8 * dict_bytes:
        try:
            return zstandard.train_dictionary(dict_bytes, some, k=512, d=8)
        except zstandard.ZstdError:  # too uniform to train on
            pass
    return zstandard.ZstdCompressionDict(b"".join(some)[-dict_bytes:] or b"\0", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_bytes(records: list[bytes], level: int = LEVEL) -> bytes:
    dictionary = train(records)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
    one = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
    return struct.pack("<II", MAGIC, len(packed)) + packed + b"".join(one.compress(r) for r in records)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, n = struct.unpack_from("<II", content)
    if magic != MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(content[8 : 8 + n])
    trained = dictionary[:4] == b"\x37\xa4\x30\xec"
    kind = zstandard.DICT_TYPE_AUTO if trained else zstandard.DICT_TYPE_RAWCONTENT
    reader, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind)), 8 + n
    while at < len(content):
        one, parts = reader.decompressobj(), []
        while not one.eof:
            chunk = content[at : at + 65_536]
            if not chunk:
                raise ValueError("the archive is cut short")
            parts.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> dict:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    full = int(http.rpartition(b"Content-Length: ")[2])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != full or digest32(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x[10:-1])
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To"))}


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, top (id of the response if this row revisits it, else null). Payloads move once, by row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), text_of(url_col).alias("url"), text_of(html_col).cast("binary").alias("payload"))
    key = F.struct(F.octet_length("payload").alias("n"), F.unhex(F.sha2("payload", 256)).alias("sha"))
    keys = rows.select("page_id", key.alias("key")).where(F.col("key.n") >= least_bytes)
    groups = keys.groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    # a group's response is looked up by its few fields; ids of rows that revisit are what travels on
    revisits = keys.join(groups.select("key", "top"), "key").where(~F.col("page_id").eqNullSafe(F.col("top")))
    revisits = revisits.select(F.col("page_id").alias("rid"), F.col("key").alias("rkey"), "top").distinct()
    on = F.col("page_id").eqNullSafe(F.col("rid")) & (key == F.col("rkey"))
    return rows.join(revisits, on, "left").select("page_id", "url", "payload", "top")


def archives(pages: DataFrame, archive_mb: int = ARCHIVE_MB, level: int = LEVEL, **columns) -> DataFrame:
    """Rows (archive, content). A task closes an archive when it holds about archive_mb of records."""
    small_batches(pages.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pd.DataFrame:
            return pd.DataFrame({"archive": [f"part-{part:06d}-{k:05d}.warc.zst"], "content": [archive_bytes(held, level)]})

        for batch in batches:
            for page_id, url, payload, top in zip(batch["page_id"], batch["url"], batch["payload"], batch["top"], strict=True):
                page_id, top = (None if pd.isna(x) else int(x) for x in (page_id, top))
                payload = bytes(payload)
                held.append(record_bytes(page_id, url, payload, digest32(payload), top, top is not None))
                size += len(held[-1])
                if size >= archive_mb << 20:
                    yield close()
                    k, held, size = k + 1, [], 0
        if held:
            yield close()

    rows = with_revisits(pages, **columns)
    ids = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("top").cast("string").alias("top"))
    return ids.mapInPandas(write, "archive string, content binary")


def read_back(stored_archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = [parse(r) for r in read_archive(bytes(content))]
                yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return stored_archives.select("content").mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(stored_archives: DataFrame, folder: str) -> int:
    """Write the archives as files into a folder that all executors mount; returns their number."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            with open(f"{folder}/.{row.archive}", "wb") as out:
                out.write(row.content)
            os.replace(f"{folder}/.{row.archive}", f"{folder}/{row.archive}")

    stored_archives.foreachPartition(put)
    return stored_archives.count()


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = stored(archives(read_table(spark, sf_dir, "pages")), "archives")
    return read_back(written).drop("url")


ORACLE_SQL = """
SELECT page_id, octet_length(encode(t)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))
"""
