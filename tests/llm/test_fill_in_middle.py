import hashlib
import random
import re

from quarrystone.llm import fill_in_middle as fim

SCHEMA = "text string, row string, doc_id long, form int"


def brute(doc, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    plain = form == "plain"
    return (doc, n, form, None if plain else len(prefix), None if plain else len(middle), out)


def fixture():
    rng = random.Random(3)
    texts = [None, "", " ", "a", " a ", "\n\n", "a<P>b", "x <S", "S>", "<", "P> y", "é ü  z", "no" * 200, " " * 900, "<<P", "ab<", "<S <P <M >"]
    texts += ["".join(rng.choices(["a", "é", "日", "<", "P", "S", "M", ">", " ", "\n", "\t", "😀"], k=rng.randint(1, 400))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k + 1000, t) for k, t in enumerate(texts)] + [(None, "a null id"), (7, texts[30]), (7, texts[30]), (7, texts[31])]
    return rows + [(5000 + k, "long text here " * 3000 + "z" * 5000) for k in range(8)]


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(t, "clash", d, 1) for d, t in rows], SCHEMA).repartition(3).cache()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((*brute(d, t)[:5], sha(brute(d, t)[5]), sha(t or "")) for d, t in rows), key=str)
    for piece in (1, 7, 64, fim.PIECE):  # marks and code points are split over pieces
        out = fim.digests(df if piece > 7 else df.where("length(text) < 2000 or text is null"), piece=piece)
        mine = want if piece > 7 else [w for w in want if w[0] is None or w[0] < 5000]
        assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        assert sorted((tuple(r) for r in out.collect()), key=str) == mine
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_texts(spark):
    rows = fixture()
    df = spark.createDataFrame([(t, "clash", d, 1) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fim.transform(df, piece=100).collect()), key=str)
    assert got == sorted((brute(d, t) for d, t in rows), key=str)


def test_chunks_end_with_units():
    import numpy as np

    body = np.frombuffer(b"aa bbb  c dddddddddd e", np.uint8)
    ends = fim.unit_ends(body)
    assert [bytes(body[a:b]) for a, b in fim.chunks(0, len(body), ends, 6)] == [b"aa bbb", b"  c", b" ddddd", b"ddddd", b" e"]


def test_empty(spark):
    assert fim.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0
