import random

import corpus_pipeline
from quarrystone.llm import decontaminate, language
from tests.llm.test_near_dups import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def say(rng, lang, n):
    words = {"en": ["the", "thing", "tion", "whether", "of", "and", "ough"], "de": ["über", "keit", "schön", "der", "ung", "nicht", "zu"]}[lang]
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    item = say(rng, "en", 30)
    texts = [(say(rng, "de" if k % 3 else "en", rng.randint(30, 80)), "de" if k % 3 else "en") for k in range(60)]
    texts += [texts[3], texts[3], (texts[7][0] + " more", texts[7][1]), (say(rng, "en", 20) + " " + item, "en"), ("1234 !!", "en"), (None, "de"), ("", None)]
    rows = [(k, t, lang, "clash", len(t or "")) for k, (t, lang) in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {k: t for k, t, *_ in rows if t and any(c.isalpha() for c in t)}
    latest = {}
    for k in sorted(kept):
        latest[kept[k]] = k
    exact = {k: kept[k] for k in latest.values()}
    near = {}
    for k in sorted(exact):
        s = shingles(exact[k])
        if not any(len(s & o) * 100 >= 75 * len(s | o) for o in map(shingles, near.values())):
            near[k] = exact[k]
    clean = {k for k, t in near.items() if item not in t}
    want = [set(kept), set(exact), set(near), clean]
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        state = corpus_pipeline.stored(stage(spark, state, str(tmp_path)), "stage")
        assert state.columns == docs.columns
        assert {r.doc_id for r in state.collect()} == ids
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == clean


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert decontaminate.WINDOW == 8 and language.BITS == 16
