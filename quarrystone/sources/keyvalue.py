"""A key-value store as a Spark data source: `quarrystone_kv`, rows (key string, value binary) in a folder.

Each writing task makes one file: blocks of records with ascending keys, then a footer with every block's place, number of rows, first and
last key. Only the files that the meta file names are part of the store: a commit adds the files of all tasks to it, a job that fails
deletes what its tasks wrote. A scan is split by bytes: a task takes the blocks that begin in its range, so that large files are read by many
tasks and the driver sees names and sizes of files only. What a scan wants of the key is part of its load and skips files and blocks by their first and last
keys. (Filters that Spark 4.1 hands to a Python source stay with it: the next scan of the same table without filters gets them as well and loses rows,
so the source takes none of those.)

Options: `path`; `keys` (see `read_store`); `split_mb` (bytes a task reads, 64); `block_kb` (256). Paths go through Arrow's file systems, so that a shared store can be one.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

META, TAIL = "meta.json", struct.Struct("<QI4s")
MAGIC = b"QKV1"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def read_meta(path: str) -> list[dict]:
    """name, bytes, rows, first and last key of each file of the store; none where there is no store."""
    system, base = _open(path)
    if system.get_file_info(f"{base}/{META}").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{base}/{META}") as f:
        return json.loads(f.read())["files"]


def _write_meta(path: str, files: list[dict]) -> None:
    system, base = _open(path)
    fresh = f"{base}/.{META}-{uuid.uuid4().hex}"
    with system.open_output_stream(fresh) as f:
        f.write(json.dumps({"files": files}).encode())
    system.move(fresh, f"{base}/{META}")


@dataclass
class _File(WriterCommitMessage):
    name: str
    entry: dict | None


@dataclass
class _Range(InputPartition):
    name: str
    start: int
    end: int


class KeyRange:
    """What a scan wants: tests (kind, value), all of which a key has to pass. Kinds: = in > >= < <= ^ (begins with)."""

    def __init__(self, tests: Iterable[tuple[str, object]]):
        self.tests = [(kind, frozenset(v) if kind == "in" else v) for kind, v in tests]
        if bad := {kind for kind, _ in self.tests} - {"=", "in", ">", ">=", "<", "<=", "^"}:
            raise ValueError(f"no tests of a key: {sorted(bad)}")

    def may_hold(self, first: str, last: str) -> bool:
        """Whether keys from first to last can pass. Keys are ordered by code points."""
        for kind, v in self.tests:
            bad = {
                "=": lambda v: not first <= v <= last,
                "in": lambda v: not any(first <= x <= last for x in v),
                ">": lambda v: last <= v,
                ">=": lambda v: last < v,
                "<": lambda v: first >= v,
                "<=": lambda v: first > v,
                "^": lambda v: last < v or first[: len(v)] > v,
            }[kind]
            if bad(v):
                return False
        return True

    def passes(self, key: str) -> bool:
        ok = {"=": lambda v: key == v, "in": lambda v: key in v, ">": lambda v: key > v, ">=": lambda v: key >= v, "<": lambda v: key < v, "<=": lambda v: key <= v, "^": lambda v: key.startswith(v)}
        return all(ok[kind](v) for kind, v in self.tests)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(float(options.get("split_mb", "64")) * (1 << 20))
        self.keys = KeyRange(json.loads(options.get("keys", "[]")))

    def partitions(self) -> list[InputPartition]:
        files = [f for f in read_meta(self.path) if self.keys.may_hold(f["first"], f["last"])]
        return [_Range(f["name"], at, min(at + self.split, f["bytes"])) for f in files for at in range(0, f["bytes"], self.split)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, base = _open(self.path)
        with system.open_input_file(f"{base}/{partition.name}") as f:
            size = f.size()
            f.seek(size - TAIL.size)
            at, length, magic = TAIL.unpack(f.read(TAIL.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.name} is no file of a key-value store")
            f.seek(at)
            for start, end, first, last in json.loads(f.read(length)):
                if partition.start <= start < partition.end and self.keys.may_hold(first, last):
                    f.seek(start)
                    yield self._rows(f.read(end - start))

    def _rows(self, block: bytes) -> pa.RecordBatch:
        keys, values, at = [], [], 0
        while at < len(block):
            k, v = struct.unpack_from("<II", block, at)
            key = block[at + 8 : at + 8 + k].decode()
            if self.keys.passes(key):
                keys.append(key)
                values.append(block[at + 8 + k : at + 8 + k + v])
            at += 8 + k + v
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.binary())], ["key", "value"])


class _Writer(DataSourceArrowWriter):
    """A task's rows come in ascending order of keys (see `write_store`); its file is named anew at each attempt."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.block, self.overwrite = options["path"], int(float(options.get("block_kb", "256")) * 1024), overwrite
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _File:
        system, base = _open(self.path)
        name, blocks, rows = f"data-{self.job}-{uuid.uuid4().hex}.kv", [], 0
        system.create_dir(base, recursive=True)
        out, held, at, first, last = None, [], 0, None, None
        size = 0
        try:
            for batch in iterator:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if key is None:
                        raise ValueError("a key is null")
                    if last is not None and key < last:
                        raise ValueError("keys of a task have to ascend: write with write_store")
                    k, v = key.encode(), value or b""
                    out = out or system.open_output_stream(f"{base}/{name}")
                    held.append(struct.pack("<II", len(k), len(v)) + k + v)
                    size += len(held[-1])
                    first, last, rows = first if first is not None else key, key, rows + 1
                    if size >= self.block:
                        out.write(b"".join(held))
                        blocks.append((at, at + size, first, last))
                        at, held, size, first = at + size, [], 0, None
            if out is None:
                return _File(name, None)
            if held:
                out.write(b"".join(held))
                blocks.append((at, at + size, first, last))
                at += size
            footer = json.dumps(blocks).encode()
            out.write(footer + TAIL.pack(at, len(footer), MAGIC))
            out.close()
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(f"{base}/{name}")
            raise
        return _File(name, {"name": name, "bytes": at, "rows": rows, "first": blocks[0][2], "last": blocks[-1][3]})

    def commit(self, messages: list[_File | None]) -> None:
        fresh = [m.entry for m in messages if m and m.entry]
        old = [] if self.overwrite else read_meta(self.path)
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        gone = read_meta(self.path) if self.overwrite else []
        _write_meta(self.path, old + fresh)
        for f in gone:
            system.delete_file(f"{base}/{f['name']}")

    def abort(self, messages: list[_File | None]) -> None:
        _delete(self.path, lambda name: name.startswith(f"data-{self.job}-"))


def _delete(path: str, which) -> None:
    system, base = _open(path)
    for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.endswith(".kv") and which(f.base_name):
            system.delete_file(f.path)


def vacuum(path: str) -> None:
    """Delete files that aren't part of the store: tasks that are killed while their job is aborted may leave one. For times without writers."""
    known = {f["name"] for f in read_meta(path)}
    _delete(path, lambda name: name not in known)


class KeyValueSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "quarrystone_kv"

    def schema(self) -> str:
        return "key string, value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


def write_store(rows, path: str, key: str = "key", value: str = "value", mode: str = "append", **options) -> None:
    """Rows to the store at `path`, dealt by ranges of keys and sorted, so that files and blocks hold narrow ranges."""
    from pyspark.sql import functions as F

    rows.sparkSession.dataSource.register(KeyValueSource)
    given = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("binary").alias("value"))
    given.repartitionByRange("key").sortWithinPartitions("key").write.format("quarrystone_kv").options(path=path, **{k: str(v) for k, v in options.items()}).mode(mode).save()


def read_store(spark, path: str, keys: list[tuple[str, object]] | None = None, **options):
    """The store as rows, of which `keys` says what it wants: [("^", "a/"), ("<", "a/7")], say. A key that was written twice gives two
    rows: the store adds, it doesn't replace."""
    spark.dataSource.register(KeyValueSource)
    wanted = json.dumps([(kind, sorted(v) if kind == "in" else v) for kind, v in keys or []])
    return spark.read.format("quarrystone_kv").options(path=path, keys=wanted, **{k: str(v) for k, v in options.items()}).load()


def get(spark, path: str, key: str) -> bytes | None:
    """The value of one key; skips all blocks that can't hold it."""
    row = read_store(spark, path, [("=", key)]).select("value").first()
    return bytes(row[0]) if row else None
