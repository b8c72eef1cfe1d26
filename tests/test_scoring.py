"""Scores by key: batches, models loaded once, reruns that score new keys only, joins by key."""

import numpy as np

from quarrystone.functions import arrays, resample
from quarrystone.operators import scoring


def test_weights_are_those_of_the_table(spark):
    for a, b in ((8, 4), (7, 5), (4, 9), (1, 3), (16, 3)):
        table = np.zeros((b, a))
        for r in arrays.resize_weights(spark, a, b).collect():
            table[r.o, r.i] = r.w
        assert np.allclose(resample.axis_matrix(a, b, b / a, pad="symmetric"), table)


def counting(folder, name):
    """A scorer that leaves a mark for each load and each batch."""

    def load():
        import os
        import uuid

        open(f"{folder}/load-{name}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def score(x):
            open(f"{folder}/batch-{name}-{len(x)}-{uuid.uuid4().hex}", "w").close()
            return x.reshape(len(x), -1).sum(1)

        return score

    return load


def test_batches_and_reruns(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    rows = spark.createDataFrame([(k, [float(k), 1.0, 2.0, 3.0]) for k in range(250)] + [(900, None)], "id long, t array<double>").repartition(2)
    path, scorers = f"{tmp_path}/scores", {"total": counting(str(marks), "total")}
    scoring.score_new(rows.where("id < 130 or id = 900"), path, "id", "t", [2, 2], scorers, 1, batch=20)
    sizes = [int(m.name.split("-")[2]) for m in marks.glob("batch-*")]
    assert max(sizes) == 20 and sum(sizes) == 130
    for m in marks.iterdir():
        m.unlink()
    scoring.score_new(rows, path, "id", "t", [2, 2], scorers, 2, batch=20)
    assert sum(int(m.name.split("-")[2]) for m in marks.glob("batch-*")) == 120
    scoring.score_new(rows, path, "id", "t", [2, 2], scorers, 3, batch=20)
    got = {r.id: (r.score, r.run) for r in scoring.read_scores(spark, path, "id").collect()}
    assert got == {k: (k + 6.0, 1 if k < 130 else 2) for k in range(250)} | {900: (None, 1)}
    # a score that is written again replaces the one before
    scoring.upsert_scores(spark.createDataFrame([(3, "total", -1.0)], "id long, metric string, score double"), path, "id", 4)
    assert {(r.id, r.score) for r in scoring.read_scores(spark, path, "id").where("run = 4").collect()} == {(3, -1.0)}
    assert scoring.read_scores(spark, path, "id").count() == 251


def test_scores_meet_their_keys(spark):
    manifest = spark.createDataFrame([("b", 1, 0.0), ("a", 2, 0.0), ("b", 3, 0.0), ("x", 4, 0.0)], "path string, n int, total double")
    scores = spark.createDataFrame([("a", "total", 1.0), ("b", "total", 2.0), ("b", "other", 3.0)], "path string, metric string, score double")
    out = scoring.with_scores(manifest, scores, "path", ["total", "other"])
    assert out.columns == ["path", "n", "total", "other"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("b", 1, 2.0, 3.0), ("a", 2, 1.0, None), ("b", 3, 2.0, 3.0), ("x", 4, None, None)], key=str)


def test_input_and_scorers(spark):
    x = np.random.default_rng(1).random((6, 9, 3)) * 300 - 20
    df = spark.createDataFrame([(1, x.ravel().tolist(), 6, 9), (2, [1.0], 6, 9), (3, None, 1, 1), (4, [], 0, 0)], "id long, image array<double>, h int, w int")
    rows = df.select("id", scoring.model_input("image", "h", "w", 4, 3).alias("t"))
    want = np.einsum("ah,hwc,bw->abc", resample.axis_matrix(6, 4, 4 / 6), x, resample.axis_matrix(9, 4, 4 / 9))
    got = {r.id: r.t for r in rows.collect()}
    assert np.allclose(got[1], want.ravel()) and [got[k] for k in (2, 3, 4)] == [None] * 3
    levels = df.select("id", scoring.model_input(df.image, "h", "w", 4, 3, eight_bit=True).alias("t")).where("id = 1").first().t
    assert np.allclose(np.array(levels) * 255, np.floor(np.clip(want.ravel(), 0, 255)))
    out = {(r.id, r.metric): r.score for r in scoring.predicted(rows, "id", "t", [4, 4, 3], {"contrast": scoring.contrast, "sharpness": scoring.sharpness}).collect()}
    flat = want.reshape(4, 12)
    assert np.isclose(out[1, "contrast"], want.var()) and np.isclose(out[1, "sharpness"], np.abs(np.diff(flat, axis=1)).mean())
    assert out[2, "contrast"] is None and len(out) == 8
    assert scoring.predicted(rows, "id", "t", [4, 4, 3], {}).count() == 0
    assert scoring.artifacts()(np.zeros((2, 4, 4))).tolist() == [0.0, 0.0]
    assert scoring.predicted(rows.limit(0), "id", "t", [4, 4, 3], {"contrast": scoring.contrast}).count() == 0
