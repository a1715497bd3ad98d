"""Quality votes: held-out accuracy, plain neighbours, awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from movara.llm import quality_votes as module
from movara.llm.queries import held_out, op3
from movara.llm.quality_votes import Counting, fit_votes, score_uploads

from tests.llm.plain import frame

REVIEWS = "dataset_id long, accepted int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(held_out(F.col("doc_id")))
    rows = op3(spark, sf).join(labels, "doc_id").collect()
    assert len(rows) > 1000
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    for label in (0, 1):
        assert np.mean([r.predicted == label for r in rows if r.quality == label]) > 0.93


def test_votes_are_the_weighted_nearest():
    rng = np.random.default_rng(0)
    model = module.Votes(
        np.ones(module.FEATURES), np.eye(module.FEATURES, 8, dtype=np.float32), module.unit(rng.random((2500, 8), np.float32)), (rng.random(2500) < 0.4).astype(np.float32)
    )
    rows = [(np.arange(8), rng.random(8)) for _ in range(20)]
    for (found, counts), score in zip(rows, model.score(rows)):
        asked = np.zeros(module.FEATURES, np.float32)
        asked[found] = counts
        cosines = (model.vectors @ (module.unit(asked[None]) @ model.axes)[0]).astype(np.float64)
        near = np.argsort(-cosines, kind="stable")[: module.NEIGHBOURS]
        weight = np.clip(cosines[near], 0, None) ** module.SHARPNESS
        assert abs(score - (weight * model.labels[near]).sum() / weight.sum()) < 1e-3


def test_awkward_rows(spark):
    reviews = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (6, None), (99, 1)], REVIEWS)
    model = fit_votes(frame(spark), reviews)
    assert sorted(model.labels.tolist()) == [0, 1]
    rows = score_uploads(frame(spark), model).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    unlabelled = fit_votes(frame(spark), spark.createDataFrame([], REVIEWS))
    assert {r.score for r in score_uploads(frame(spark), unlabelled).collect()} == {0.5}
    assert score_uploads(frame(spark, []), fit_votes(frame(spark, []), reviews)).count() == 0


def test_counts():
    count = Counting()
    assert count(None)[0].tolist() == count(b"")[0].tolist() and len(count(b"")[0]) >= 1
    same, other = count(b"the best table"), count(b"THE!! BEST!! TABLE!!")
    assert set(same[0]) != set(other[0])


def test_texts_that_differ_in_long_words_only(spark):
    rng = np.random.default_rng(1)
    vocabulary = [["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(60)] for _ in range(2)]
    rows = [(i, "a", " ".join(rng.choice(vocabulary[i % 2], 40, replace=False))) for i in range(80)]
    uploads = spark.createDataFrame(rows, "dataset_id long, file_name string, content string")
    model = fit_votes(uploads, spark.createDataFrame([(i, i % 2) for i in range(60)], REVIEWS))
    scores = {r.dataset_id: r.score for r in score_uploads(uploads, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 2 == 1) for i in range(60, 80))


def test_long_texts_without_blanks():
    count = Counting()
    for start, one, other in (("字" * 30, "這是第一段文字內容" * 20, "另有不同的句子在此" * 20), ("x" * 70, "var=1;" * 30, "let(2)," * 30)):
        a, b = (count((start + rest).encode()) for rest in (one, other))
        assert len(set(a[0]) ^ set(b[0])) > 5
    marks = module.shape_features(b"a" * 70 + b"0-A"), module.shape_features(b"a" * 70 + b"0+A")
    assert marks[0][0] != marks[1][0]
    assert module.shape_features(b"a!!!!?")[1] != module.shape_features(b"a!!!!.")[1]
