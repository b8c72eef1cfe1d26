import random
import re

from quarrystone.llm import licenses

SCHEMA = "text string, doc_id long, labels string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def base(text):
    w, places, labels = words_of(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def verified(text, counts=None):
    """Labels of which every mandatory phrase stands near its place, by the definition: the rarest word's phrase names a bucket of starts, the
    others may be off by the tolerance and an eighth of their distance from it. counts: documents that hold each word."""
    w, labels = words_of(text), set()
    places = lambda p: [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    for label, body, phrases in licenses.TEMPLATES:
        body = body.split()
        keys = [(licenses._index(body, p), p.split()) for p in phrases]
        centre = min(((counts or {}).get(x, 1), x, at) for at, p in keys for x in p)[2]
        own = next(p for at, p in keys if at == centre)
        for q in places(own):
            b = (q - centre) // 8 * 8
            if all(any(b + at - 8 - abs(at - centre) // 8 <= k <= b + 7 + at + 8 + abs(at - centre) // 8 for k in places(p)) for at, p in keys):
                labels.add(label)
    return labels


def held(rows):
    counts = {}
    for t, *_ in rows:
        for x in set(words_of(t or "")):
            counts[x] = counts.get(x, 0) + 1
    return counts


def test_against_brute_force(spark):
    rng = random.Random(2)
    bits = ["GNU General Public License", "Apache License", "CC BY", "cc by cc", "MIT", "License", "the", "of", "ERth", "é", "ñandú", "_x9", "version 3", ".", "\n", "-NC 4.0", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License."]
    rows = [(" ".join(rng.choices(bits, k=rng.randint(0, 8))), i, "clash") for i in range(200)]
    rows += [("the of erth on " * 10, 300 + i, None) for i in range(300)]
    rows += [("gnu general public license " * 3, 1000, None), (None, 1001, None), ("", 1002, None), ("the of " * 30_000 + licenses.TEMPLATES[6][1].upper(), 1003, None), (rows[0][0], 0, None), ("license " * 20_000, 1004, None), ("the mit license", None, None)]
    rows += [(body, 2000 + i, None) for i, (_, body, _) in enumerate(licenses.TEMPLATES)]
    counts = held(rows)
    out = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert len(out) == len(rows)
    text = {d: t or "" for t, d, _ in rows}
    for r in out:
        n, k, first, last, labels = base(text[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, k, first, last, labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if len(text[r.doc_id]) < 10_000:
            assert set(filter(None, r.labels.split(","))) == set(filter(None, labels.split(","))) | verified(text[r.doc_id], counts), text[r.doc_id]
    by = {r.doc_id: r for r in out}
    assert by[1003].labels == "mit" and by[1003].base_labels == "" and by[2000].score == 1.0
    for i, (label, *_) in enumerate(licenses.TEMPLATES):
        assert label in by[2000 + i].labels.split(",")


def test_common_notices_and_mixes(spark):
    """A notice that most rows hold, all notices in one file, and rows in which rarer words of other templates stand alone."""
    every = " . ".join(body for _, body, _ in licenses.TEMPLATES)
    loose = "redistribution binary forms permission mozilla creative commons attribution warranty hereby charge obtaining conditions "
    rows = [("Licensed under the Apache License, Version 2.0.", k, None) for k in range(40)] + [("plain text", 100 + k, None) for k in range(20)]
    rows += [(every, 200, None), (loose + "released under the mit license", 201, None), (loose + "apache license version 2 0 " + loose, 202, None)]
    out = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    counts = held(rows)
    for text, k, _ in rows:
        assert out[k] == set(filter(None, base(text)[4].split(","))) | verified(text, counts), text
    assert out[0] == {"apache", "apache-2.0"} and "mit" in out[201] and out[200] >= {label for label, *_ in licenses.TEMPLATES}


def test_edited_licences(spark):
    """Words put in, left out and replaced outside the mandatory phrases, in text before and after: by alignment the licence is still there."""
    rng = random.Random(5)
    filler = ["der", "ung", "erth", "ou", "le", "con", "of", "the", "software", "license", "notice", "is", "and"]
    rows, want = [], []
    for label, text, phrases in licenses.TEMPLATES:
        body = text.split()
        kept = set()
        for p in phrases:
            at = licenses._index(body, p)
            kept |= set(range(at, at + len(p.split())))
        for _ in range(12):
            out = []
            for k, w in enumerate(body):
                inside = k in kept and k - 1 in kept
                if not inside and rng.random() < 0.05:
                    out.append(rng.choice(filler))
                if k not in kept and rng.random() < 0.05:
                    continue
                out.append(rng.choice(filler) if k not in kept and rng.random() < 0.05 else w)
            said = " ".join(rng.choices(filler, k=rng.randint(0, 80))) + " * " + "\n * ".join(out).title() + " " + " ".join(rng.choices(filler, k=rng.randint(0, 80)))
            rows.append((said, len(rows), None))
            want.append(label)
    rows += [(" ".join(rng.choices(filler, k=300)), 10_000 + k, None) for k in range(100)]
    by = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(label in by[k] for k, label in enumerate(want))
    assert found >= 0.9 * len(want), (found, len(want))
    assert all(by[10_000 + k] == {""} for k in range(100))
    said = "redistribution and use in source and binary forms, with or without changes, are hereby permitted provided that the following conditions are met"
    more = spark.createDataFrame([(said, 1, None), ("GNU Lesser General Public License version 3", 2, None), ("the " + " ".join(["software"] * 20_000), 3, None), (" ".join(licenses.TEMPLATES[6][1].split() * 300), 4, None)], SCHEMA)
    out = {r.doc_id: r for r in licenses.scan_licenses(more).collect()}
    assert out[1].labels == "bsd-3-clause" and out[2].labels == "lgpl-3.0" and out[3].labels == "" and out[4].labels == "mit"


def test_empty(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
