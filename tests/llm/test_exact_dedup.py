import hashlib
import random
from collections import defaultdict

from quarrystone.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        g = groups[t or ""]
        top = max((x for x in g if x is not None), default=None)
        out.append((d, top, len(g), d == top, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def fixture():
    rng = random.Random(1)
    long = "".join(rng.choices("abc défg\n", k=200_000))
    texts = [None, "", "a", "a ", long, long, long[:-1], "x" * 100_000, "x" * 100_000, "x" * 100_001, long[1:]]
    texts += ["".join(rng.choices("ab ", k=rng.randint(0, 3000))) for _ in range(40)] * 2
    return [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (None, "only null"), (4, long)]


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(t, "clash", d, 1) for d, t in rows], "text string, keep_id string, doc_id long, n int")
    assert rows_of(exact_dedup.exact_groups(df)) == brute(rows)


def test_colliding_hashes_get_ranks(spark, monkeypatch):
    rows = fixture()
    df = spark.createDataFrame([(t, d) for d, t in rows], "text string, doc_id long")
    real = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: exact_dedup.F.pmod(real(c), exact_dedup.F.lit(3)))
    assert rows_of(exact_dedup.exact_groups(df)) == brute(rows)


def test_cuts_follow_content():
    import numpy as np

    rng = random.Random(2)
    body = bytes(rng.choices(range(97, 110), k=60_000))
    a, b = (exact_dedup.cut_points(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in (body, b"moved by some bytes" + body))
    assert len(set(a + 19) & set(b)) > 0.8 * len(a)


def test_empty(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_groups_are_broadcast_or_not(spark, monkeypatch):
    rows = [(i, f"text {i % 3}") for i in range(60)] + [(100 + i, f"own {i}") for i in range(20)] + [(200 + i, "pair") for i in range(2)]
    want = sorted(brute(rows), key=str)
    for large, most in ((10, 5), (10, 2), (1, 100), (1000, 5)):
        monkeypatch.setattr(exact_dedup, "LARGE", large)
        monkeypatch.setattr(exact_dedup, "MOST_LARGE", most)
        assert rows_of(exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == want
