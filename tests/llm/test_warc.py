import base64
import hashlib
import os

from quarrystone.llm import warc

SCHEMA = "html string, page_id long, url string, content string"


def test_round_trip(spark, tmp_path):
    body = "<p>" + "the of and to " * 300 + "</p>"
    rows = [(body + str(i), i, f"http://h{i}.example/", "clash") for i in range(60)]
    rows += [(body + "7", 100, "http://copy/", None), (None, 101, None, None), ("", 102, "u", None), ("é" * 300_000, 103, "a\r\nb", None), ("x", None, "n", None), ("x", None, "n", None), (body + "7", 100, "http://copy/", None), ("", None, None, None)]
    kept = warc.archives(spark.createDataFrame(rows, SCHEMA).repartition(3)).cache()
    out = warc.read_back(kept).collect()
    assert len(out) == len(rows)
    want = []
    for html, page, *_ in rows:
        data = (html or "").encode()
        top = max((p for h, p, *_ in rows if (h or "") == (html or "") and p is not None), default=None)
        kind = "response" if top is None or page == top else "revisit"
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, top if kind == "revisit" else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    n = warc.export(kept, str(tmp_path))
    files = [f for f in os.listdir(tmp_path) if f.endswith(".warc.zst")]
    assert len(files) == n
    assert (tmp_path / files[0]).read_bytes()[:4] == bytes.fromhex("5d2a4d18")


def test_dictionary_helps():
    records = [warc.record_bytes(i, "http://x", (f"<html>{i}" + "shared boiler plate %d " * 40 % tuple(range(40))).encode(), "D", None, False) for i in range(2000)]
    content = warc.archive_bytes(records)
    assert list(warc.read_archive(content)) == records
    import zstandard

    assert len(content) < 0.7 * sum(len(zstandard.compress(r, 3)) for r in records)


def test_empty(spark):
    assert warc.read_back(warc.archives(spark.createDataFrame([], SCHEMA))).count() == 0
