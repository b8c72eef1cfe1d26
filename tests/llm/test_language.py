import random

from quarrystone.llm import language

SCHEMA = "text string, doc_id long, lang string, score string"
WORDS = {"en": ["the", "ing", "tion", "whether", "of"], "de": ["über", "keit", "schön", "der", "ung"], "ru": ["привет", "мир", "это", "слово"]}


def make(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_learn_and_predict(spark):
    rng = random.Random(1)
    rows = [(make(rng, lang, 40), i, lang, "clash") for i, lang in enumerate(["en", "de", "ru"] * 30)]
    rows += [(make(rng, "en", 30), 500, None, None)]
    model = language.train(spark.createDataFrame(rows, SCHEMA))
    assert model.names == ["de", "en", "ru"]
    mixed = make(rng, "en", 30) + ". " + make(rng, "de", 10) + " " + make(rng, "ru", 3)
    asked = [(None, 1, None, None), ("", 2, None, None), ("123 !? …", 3, None, None), (mixed, 4, "ru", None), (make(rng, "ru", 50_000), 5, None, None), (mixed, 4, "ru", None), ("日本", 6, None, None)]
    out = {r.doc_id: r for r in language.predict(spark.createDataFrame(asked, SCHEMA), model).collect()}
    assert [(out[k].lang_pred, out[k].score) for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert out[4].lang_pred == "en" and [s.lang for s in out[4].spans] == ["en", "de", "ru"]
    assert out[5].lang_pred == "ru" and out[5].score == 1.0
    assert out[6].lang_pred in model.names


def test_nothing_to_learn_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = language.train(empty)
    assert language.predict(empty, model).count() == 0
    assert language.predict(spark.createDataFrame([("abc", 1, None, None)], SCHEMA), model).first().lang_pred == "und"


def test_viterbi_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    first, last, n = [0], [], 0
    for size in (1, 4, 0, 6, 3):
        n += size
        last.append(n)
        first.append(n)
    scores = rng.normal(0, 2, (n, 3))
    got = language.decode(scores, np.array(first[:-1]), np.array(last), 1.5)
    value = lambda path, s: sum(s[i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))
    for a, b in zip(first[:-1], last, strict=True):
        if b > a:
            best = max(value(p, scores[a:b]) for p in itertools.product(range(3), repeat=b - a))
            assert abs(value(got[a:b], scores[a:b]) - best) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where(language.fold() != 0))
    held = docs.where(language.fold() == 0)
    out = language.predict(held, model).join(held.select("doc_id", "lang"), "doc_id").selectExpr("avg(double(lang = lang_pred))").first()[0]
    assert out > 0.97


def test_letters_by_category():
    import unicodedata

    import numpy as np

    for text in ("→ ✓ 😀", "5 € → 😀 12", "٣٤", "№ ™ x", "µ ª", "ＡＢ", "々", "ﻼ", "नमस्ते ा", "é\u0301x", "\u0301a", "𐍈𝔸"):
        raw = np.frombuffer(text.encode(), np.uint8)
        mask, want, after = language._letters(raw, np.array([0, len(raw)])), [], False
        for c in text:
            kind = unicodedata.category(c)[0]
            after = kind == "L" or (kind == "M" and after)
            want += [after] * len(c.encode())
        assert mask.tolist() == want, text


def test_texts_without_letters_are_und(spark):
    rows = [("the of ing tion " * 5, 1, "en", None), ("der keit ung " * 5, 2, "de", None)]
    model = language.train(spark.createDataFrame(rows, SCHEMA))
    asked = [(t, i, None, None) for i, t in enumerate(["→ ✓ 😀", "5 € → 😀 12", "٣٤", "\u0301", "µ", "ＡＢ"])]
    out = {r.doc_id: r.lang_pred for r in language.predict(spark.createDataFrame(asked, SCHEMA), model).collect()}
    assert [out[k] == "und" for k in range(6)] == [True] * 4 + [False] * 2


def test_many_languages():
    """More languages than a byte can number, long and short texts."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for k in (128, 150, 300):
        scores = rng.normal(0, 1, (400, k))
        scores[:300, k - 1] += 9
        got = language.decode(scores, np.array([0, 300, 390]), np.array([300, 390, 400]), 2.0)
        assert set(got[:300]) == {k - 1} and got.min() >= 0 and got.max() < k
        value = lambda path: sum(scores[i, c] for i, c in enumerate(path, 390)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: E731, B023
        best = np.zeros(k)
        for i in range(390, 400):
            best = np.maximum(best, best.max() - 2.0) + scores[i] if i > 390 else scores[i].copy()
        assert abs(value(got[390:]) - best.max()) < 1e-9


def test_a_million_marks():
    import time

    import numpy as np

    text = "a" + "\u0301" * 1_000_000 + " " + "\u0301" * 10 + "b"
    raw = np.frombuffer(text.encode(), np.uint8)
    start = time.perf_counter()
    mask = language._letters(raw, np.array([0, len(raw)]))
    assert time.perf_counter() - start < 5
    assert mask.sum() == 1 + 2_000_000 + 1 and not mask[2_000_001]
    # a mark at the start of a row belongs to nothing, whatever ends the row before
    two = np.frombuffer("a\u0301\u0301b".encode(), np.uint8)
    assert language._letters(two, np.array([0, 3, len(two)])).tolist() == [True] * 3 + [False] * 2 + [True]
