import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarrystone.llm import spelling

SCHEMA = "text string, word string, doc_id long, n int"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute(words):
    out, forms, found = [], {}, {}
    for w, n in words.items():
        found[w] = [v for v in words if near(w, v)]
        best = min(found[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * n else None
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(found[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def made(rng, letters, n, long=9):
    seeds = ["".join(rng.choices(letters, k=rng.randint(5, long))) for _ in range(n)]
    out = set(seeds)
    for w in seeds:
        for _ in range(3):
            k = rng.randrange(len(w) + 1)
            out.add(rng.choice([w[:k] + rng.choice(letters) + w[k:], w[: max(k - 1, 0)] + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    return sorted(w for w in out if len(w) >= 5)


@pytest.mark.parametrize(("letters", "n", "long"), [("ab", 60, 8), ("aé", 100, 20), ("abcÿ÷", 150, 9), ("a", 6, 30), ("abcdefghijklmnopqrstuvwxyz", 80, 40)])
def test_search_against_brute_force(letters, n, long):
    words = made(random.Random(n), letters, n, long)
    index = spelling.Index(words)
    asked = words + made(random.Random(n + 1), letters, 20, long)
    for pick in (None, 0.5):
        mine = words if pick is None else words[:: 2]
        at = index if pick is None else spelling.Index(mine)
        got = []
        for side in (True, False):
            q, w = at.near(asked, np.full(len(asked), side))
            got += [(asked[a], mine[b]) for a, b in zip(q, w, strict=True)]
        # asked words that repeat are patterns of their own
        assert Counter(got) == Counter((a, b) for a in asked for b in mine if near(a, b))


def test_suffix_ranks():
    words = made(random.Random(4), "ab", 40, 30)
    flat, offsets = spelling.codes_of(words)
    ranks = spelling.Ranks(flat, offsets)
    text = "\0" + "\0".join(words) + "\1"  # the last delimiter ranks behind the others
    order = sorted(range(len(text)), key=lambda k: text[k:])
    assert [text[k - 1] for k in order[1:]] == ["\0" if c == 0 else chr(96 + c) for c in ranks.rows.ravel()[1 : ranks.n]]
    assert order[0] == 0 and ranks.rows[0, 0] == spelling.SIGMA


def test_pairs_and_groups_however_dealt(spark):
    rng = random.Random(6)
    words = {w: rng.choice([3, 3, 4, 7, 15, 40]) for w in made(rng, "abé", 120)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted((a, b) for a in words for b in words if near(a, b))
    groups = [r[:2] + r[3:] for r in brute(words)]
    for chars, most in ((1_000_000, 50_000), (50, 50_000), (300, 4), (1_000_000, 1)):
        assert sorted(tuple(r) for r in spelling.near_pairs(df, chars, most).collect()) == want
        assert sorted((r.word, r.form, r.n, r.n_near, r.form_n) for r in spelling.variants(df, chars, most).collect()) == groups


def test_documents_against_brute_force(spark):
    rng = random.Random(7)
    pool = made(rng, "abcdé", 60) + ["Straße", "ÀÉÎÕÜ", "naïveté", "abcd", "x" * 3000]
    rows = [(k, " ".join(rng.choice(pool) + rng.choice(["", ",", "1", "Ā", "日"]) for _ in range(rng.randint(0, 60)))) for k in range(200)]
    rows += [(None, "Straße Straße naïveté"), (3, None), (4, ""), (5, rows[7][1]), (5, rows[7][1]), (900, "ABCDEF " * 30_000)]
    rows += [(k, "crown crownn crowm " * (2 + k % 3)) for k in range(300, 700)]
    df = spark.createDataFrame([(t, "clash", d, 1) for d, t in rows], SCHEMA)
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == brute_words(rows)
    out = spelling.spelling_groups(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in out.collect()) == brute(brute_words(rows))


def test_chains_lead_to_the_last(spark):
    words = {"aaaaa" + "b" * k: 3 * 2**k for k in range(12)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    last = max(words, key=len)
    assert {r.word: r.root for r in spelling.roots(spelling.variants(df)).collect()} == {w: last for w in words if w != last}


def test_empty(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([("a b, 12", "x", 1, 1)], SCHEMA)).count() == 0
