import itertools

import numpy as np

from quarrystone.llm import line_quality as q

SCHEMA = "text string, doc_id long, lang string, score string, good int"


def chains(seed, sizes, k=3):
    rng = np.random.default_rng(seed)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return rng, row, rng.normal(0, 1, (len(row), k))


def value(path, unary, moves):
    return sum(u for u, s in zip(unary, path, strict=True) if s) + sum(moves[a, b] for a, b in itertools.pairwise(path))


def test_marginals_against_all_paths():
    rng, row, x = chains(1, [1, 4, 7, 2, 1, 6])
    unary, moves = x @ rng.normal(0, 2, 3), rng.normal(0, 1, (2, 2))
    both, pairs, log_z = q.forward_backward(unary, moves, row)
    for d in range(row.max() + 1):
        at = np.flatnonzero(row == d)
        paths = list(itertools.product((0, 1), repeat=len(at)))
        p = np.exp([value(s, unary[at], moves) for s in paths])
        assert abs(log_z[at[-1]] - np.log(p.sum())) < 1e-9
        for i, k in enumerate(at):
            assert abs(both[k, 1] - sum(w for w, s in zip(p, paths, strict=True) if s[i]) / p.sum()) < 1e-9
            for a, b in itertools.product((0, 1), repeat=2):
                want = sum(w for w, s in zip(p, paths, strict=True) if i and s[i - 1 : i + 1] == (a, b)) / p.sum()
                assert abs(pairs[k, a, b] - want) < 1e-9


def test_likelihood_and_gradient():
    rng, row, x = chains(2, [3, 1, 5, 2])
    good = np.array([True, False, False, True])
    theta = rng.normal(0, 0.7, 7)
    got, grad = q.likelihood(x, row, good, theta)
    unary, moves, want = x @ theta[:3], theta[3:].reshape(2, 2), 0.5 * theta @ theta
    for d in range(4):
        at = np.flatnonzero(row == d)
        p = [np.exp(value(s, unary[at], moves)) for s in itertools.product((0, 1), repeat=len(at))]
        chance = p[-1] / sum(p)
        want -= np.log(chance if good[d] else 1 - chance)
    assert abs(got - want) < 1e-9
    for k in range(7):
        e = np.eye(7)[k] * 1e-6
        slope = (q.likelihood(x, row, good, theta + e)[0] - q.likelihood(x, row, good, theta - e)[0]) / 2e-6
        assert abs(slope - grad[k]) < 1e-5


def test_features_against_plain_loops():
    texts = ["One two two.\n\n  \nA | b | a b\nOne two two.", "", "###x!\nÉé 12", "no end", "\n \n"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    starts, ends, row = q.line_spans(data, offsets)
    lines = [(d, line + ("\n" if k + 1 < len(t.split("\n")) else "")) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[1].strip()]
    assert [(int(r), bytes(data[a:b]).decode()) for a, b, r in zip(starts, ends, row, strict=True)] == lines
    own, length = q.line_features(data, starts, ends, row)
    at, seen = {n: k for k, n in enumerate(q.NAMES)}, set()
    for f, n, (d, line) in zip(own, length, lines, strict=True):
        words = line.split()
        pairs = list(itertools.pairwise(words))
        assert n == len(line)
        assert np.isclose(f[at["letters"]], sum(c.isalpha() for c in line) / len(line))
        assert np.isclose(f[at["digits"]], sum(c.isdigit() for c in line) / len(line))
        assert np.isclose(f[at["bars"]], line.count("|") / len(line))
        assert np.isclose(f[at["same_word"]], sum(a == b for a, b in pairs) / len(words))
        assert np.isclose(f[at["known_word"]], (len(words) - len(set(words))) / len(words))
        assert np.isclose(f[at["known_pair"]], (len(pairs) - len(set(pairs))) / len(words))
        assert f[at["one_word"]] == (len(words) == 1)
        assert f[at["known_line"]] == ((d, tuple(words)) in seen)
        seen.add((d, tuple(words)))


def test_neighbours_stay_within_documents():
    own, row = np.arange(1.0, 6.0)[:, None], np.array([0, 0, 0, 1, 2])
    assert q.with_neighbours(own, row)[:, :5].tolist() == [[1, 0, 2, 1, 0], [2, 1, 3, 0, 0], [3, 2, 0, 0, 1], [4, 0, 0, 1, 1], [5, 0, 0, 1, 1]]


def prose(rng, n):
    return "\n".join(" ".join(rng.choice(["stone", "water", "little", "grows", "under", "hills", "where", "green"], 9)) + "." for _ in range(n))


def test_cases(spark):
    rng = np.random.default_rng(5)
    junk = "### $$$ %%% x | y | z\n" * 3
    rows = [((prose(rng, 4) if k % 2 else prose(rng, 2) + "\n" + junk + prose(rng, 1)), k, "en", "clash", k % 2) for k in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.selectExpr("doc_id", "good as quality", "'x' as text")
    model = q.train(df, labels.unionByName(labels.selectExpr("cast(null as long) as doc_id", "quality", "text").limit(1)))
    asked = [(None, 1, None, None, 0), ("", 2, None, None, 0), (" \n\n", 3, None, None, 0), (prose(rng, 6), 4, "x", "y", 0), (junk * 5, 5, None, None, 1), (prose(rng, 6), None, None, None, 1), ("a" * 200_000, 6, None, None, 0), (junk * 5, 5, None, None, 0), (prose(rng, 30_000), 7, None, None, 0)]
    out = q.predict(spark.createDataFrame(asked, SCHEMA), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(asked) and all(0 <= r.score <= 1 for r in out)
    assert {by[k].score for k in (1, 2, 3)} == {model.share} and not by[1].lines
    assert by[4].score > 0.7 and by[None].score > 0.7 and by[7].score > 0.7 and by[5].score < 0.2
    assert len({r.score for r in out if r.doc_id == 5}) == 1 and len(by[7].lines) == 30_000
    empty = spark.createDataFrame([], SCHEMA)
    assert q.predict(empty, model).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1"), labels.selectExpr("doc_id", "cast(null as int) as quality")):
        flat = q.train(df, some)
        assert flat.weights is None and q.predict(df, flat).where(f"score <> {flat.share}").count() == 0
    both = q.train(df, labels.unionByName(labels.selectExpr("doc_id", "1 - quality as quality", "text")))
    assert abs(both.share - 0.5) < 1e-9


def test_bounds_of_the_sample(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(prose(rng, 3 if k % 3 else 300), k, None, None, k % 2) for k in range(60)], SCHEMA)
    seen = []
    real, q.fit = q.fit, lambda own, length, row, good: seen.append((len(own), len(good))) or real(own, length, row, good)
    try:
        q.train(df, df.selectExpr("doc_id", "good as quality"), fit_docs=30)
    finally:
        q.fit = real
    assert seen[0][1] <= 30 and seen[0][0] == 3 * seen[0][1]


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = q.op13_line_quality(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.97 and out.loc[out["quality"] == 1, "predicted"].mean() > 0.98
