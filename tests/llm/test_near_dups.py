import random
import re

import numpy as np

from quarrystone.llm import near_dups

SCHEMA = "text string, doc_id long, component_id string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets, top = {d: shingles(t) for t, d, _ in rows}, {d: d for _, d, _ in rows}
    ids = sorted(sets)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(rng):
    words = [a + b for a in ("th", "er", "on", "ñi", "Sch") for b in ("ea", "ou", "ing", "er", "ion", "é")]
    texts = [None, "", " \t\n", "one", "One", "a b c d", "a b c d e", "A b\nc\x0bd e", "a b c d e f"]
    shared = " ".join(rng.choices(words, k=25))
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([3, 8, 20, 60, 150]))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + (" " + shared if rng.random() < 0.4 else ""))
    base = rng.choices(words, k=120)
    for _ in range(70):  # a chain of near copies: not all link with each other
        base = list(base)
        base[rng.randrange(120)] = rng.choice(words)
        base[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(base))
    texts += [texts[12]] * 40
    return [(t, i, "clash") for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus(random.Random(8))
    want = brute(rows)
    for few in (16, 3, 1):  # the fewer classes a key may have, the more sets are in the crowd
        out = near_dups.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), few=few).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def keys_of(grams, common):
    return near_dups.block_keys(grams, np.array([0, len(grams)]), common[near_dups.counter(grams)])[0]


def sketch(grams):
    return near_dups.sketches(grams, np.array([0, len(grams)]))[0]


def test_similar_sets_share_a_key_and_sketches_bound():
    rng = np.random.default_rng(0)
    pairs, common_of = 0, rng.integers(0, 3, 1 << near_dups.COUNTER_BITS).astype(np.uint8)
    for _ in range(3000):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 200))).astype(np.uint64))
        cut = int(rng.integers(0, len(a) // 4 + 2))
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, int(rng.integers(0, cut + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b):
            continue
        differ = len(a) + len(b) - 2 * common
        x, y = sorted((sketch(a), sketch(b)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        bits = np.unpackbits((x ^ y).view(np.uint8)).sum()
        assert bits <= differ
        if 100 * common >= 75 * (len(a) + len(b) - common):
            pairs += 1
            assert len(np.intersect1d(keys_of(a, common_of), keys_of(b, common_of)))
    assert pairs > 400


def test_batches_of_sets_give_the_keys_of_single_ones():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in rng.integers(0, 90, 60)]
    common = rng.integers(0, 3, 1 << near_dups.COUNTER_BITS).astype(np.uint8)
    bounds, every = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets)
    keys, rows = near_dups.block_keys(every, bounds, common[near_dups.counter(every)])
    names, (words, at) = near_dups.class_ids(every, bounds), near_dups.sketches(every, bounds)
    for k, s in enumerate(sets):
        assert np.array_equal(keys[rows == k], keys_of(s, common) if len(s) else keys[:0])
        assert np.array_equal(words[at[k] : at[k + 1]], sketch(s))
        assert not len(s) or names[k] == near_dups.class_ids(s, np.array([0, len(s)]))[0]


def crowds(rng):
    """Documents that consist mostly of common passages, in several mixtures, and independent near copies of one text."""
    words = [a + b for a in ("th", "er", "on", "ñi", "Sch") for b in ("ea", "ou", "ing", "er", "ion", "é")]
    passages = [rng.choices(words, k=40) for _ in range(4)]
    texts = []
    for _ in range(250):
        parts = [rng.choices(words, k=rng.randint(0, 12))] + rng.sample(passages, rng.choice([1, 1, 2, 3]))
        rng.shuffle(parts)
        texts.append(" ".join(sum(parts, [])))
    base = rng.choices(words, k=100)
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(100)] = rng.choice(words)
        texts.append(" ".join(copy[: rng.choice([100, 100, 97, 80])]))
    return [(t, i, None) for i, t in enumerate(texts)]


def test_crowds_against_brute_force(spark):
    rows = crowds(random.Random(2))
    want = brute(rows)
    for few in (16, 4):
        out = near_dups.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3), few=few).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_documents_around_one_passage_make_no_pairs(spark, monkeypatch):
    """Documents of one 60-word passage around six own words: similar, but none links, and none is compared."""
    counts, met = [], near_dups._bounded
    monkeypatch.setattr(near_dups, "_bounded", lambda pairs, classes: counts.append(pairs.count()) or met(pairs, classes))
    passage = ["p%d" % k for k in range(60)]
    for n in (100, 200):
        rows = [(" ".join(passage[:30] + ["w%d_%d" % (i, k) for k in range(6)] + passage[30:]), i, None) for i in range(n)]
        out = near_dups.jaccard_components(spark.createDataFrame(rows, SCHEMA))
        assert out.where("doc_id <> component_id").isEmpty()
    assert sum(counts) < 200


def test_nulls_repeats_and_long_texts(spark):
    long = "w%d " * 50_000 % tuple(range(50_000))
    rows = [(long, 5, None), (long + " x", 9, None), (long, 5, None), (long, None, None), (None, None, None), ("q r s t u", None, None), (None, 7, None)]
    out = near_dups.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    assert got == sorted([(5, 49_996, 5), (9, 49_997, 5), (5, 49_996, 5), (None, 49_996, 5), (None, 0, None), (None, 1, None), (7, 0, 7)], key=str)
    assert near_dups.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counters_cover_all_documents(spark):
    rows = corpus(random.Random(3))
    both = near_dups.classes_of_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), "doc_id", "text")
    assert near_dups.counted(both).sum() == sum(len(shingles(t)) for t, *_ in rows)
