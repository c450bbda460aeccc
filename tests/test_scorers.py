"""Scorers handed to the operators that score, recommend and gather."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovec.functions.vectors import dot
from chronovec.operators import candidates, preference, recommend, scorers, scoring

FRAMES = "key string, frame_idx int, time double, vec array<double>"


def frames(spark, n=40, null=()):
    rng = random.Random(1)
    rows = [(f"k{i % 3}", i, float(i), None if i in null else [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, FRAMES)


def scores(df):
    return {r.frame_idx: r.score for r in df.collect()}


def test_columns_and_matrices_give_the_same_scores(spark):
    rows, own = frames(spark, null=(3, 17))
    w, b = [0.5, -1.0, 2.0, 0.25], 0.3
    plain = {i: None if v is None else 1 / (1 + math.exp(-(sum(x * y for x, y in zip(v, w)) + b))) for _, i, _, v in rows}
    for scorer in (
        scorers.logistic_scorer(w, b),
        scorers.column_scorer(lambda v: 1 / (1 + F.exp(-(dot(v, F.array(*map(F.lit, w))) + b)))),
        scorers.arrow_scorer(lambda x: 1 / (1 + np.exp(-(x @ np.array(w) + b)))),
    ):
        got = scores(scorer(own, "vec", "score"))
        assert got.keys() == plain.keys() and all(got[i] is None if p is None else got[i] == pytest.approx(p) for i, p in plain.items())


def test_scorers_that_are_no_scorers_raise(spark):
    _, own = frames(spark, 5)
    for bad in (lambda x: x, lambda x: x.sum(1)[:-1], lambda x: 1.0):
        with pytest.raises(Exception, match="got scores of shape"):
            scorers.arrow_scorer(bad)(own, "vec", "score").collect()
    with pytest.raises(Exception, match="need 2 numbers"):
        scorers.logistic_scorer([1.0, 2.0])(own, "vec", "score").collect()
    mixed = spark.createDataFrame([("a", 0, 0.0, [1.0]), ("a", 1, 1.0, [1.0, 2.0])], FRAMES).coalesce(1)
    with pytest.raises(Exception, match="several lengths"):
        scorers.arrow_scorer(lambda x: x.sum(1))(mixed, "vec", "score").collect()
    none = own.limit(0)
    assert scorers.arrow_scorer(lambda x: x.sum(1))(none, "vec", "score").count() == 0


def test_a_fitted_model_scores_as_it_predicts(spark):
    rows, own = frames(spark, 60, null=(5,))
    data = own.where("vec IS NOT NULL").withColumn("label", (F.col("vec")[0] + F.col("vec")[1] > 0).cast("int"))
    for kind in ("logreg", "mlp"):
        model = preference.train(data, kind)
        want = {r.frame_idx: r.probability for r in preference.predict(model, data).collect()}
        got = scores(scorers.model_scorer(model)(own, "vec", "score"))
        assert got.pop(5) is None and got == pytest.approx(want)


def test_null_vectors_have_null_scores_and_series_go_on_over_them(spark, monkeypatch):
    own = spark.createDataFrame([("a", i, float(i), None if i == 2 else [1.0, 0.0] if 0 < i < 5 else [0.0, 1.0]) for i in range(8)], FRAMES)
    refs = spark.createDataFrame([([1.0, 0.0],), (None,), ([0.6, -0.8],)], "vec array<double>")
    for block in (4096, 1):
        monkeypatch.setattr(scoring, "BLOCK", block)
        got = scores(scoring.similarity_scores(own, refs))
        assert got[2] is None and got[1] == pytest.approx(1.0) and len(got) == 8
    found = recommend.score_scenes(own, refs, 0.8, 0.5, min_duration=1.0, merge_gap=0.0).collect()
    assert [(r.start, r.end) for r in found] == [(1.0, 4.0)]


def test_recommendations_by_a_scorer_need_no_likes(spark):
    rows, own = frames(spark, 30)
    first = scorers.column_scorer(lambda v: v[0])
    none = spark.createDataFrame([], "key string, time double")
    some = spark.createDataFrame([("k1", 0.0)], "key string, time double")
    assert recommend.recommend(own, none, -9.0, -9.0, min_duration=0.0).count() == 0
    got = recommend.recommend(own, none, -9.0, -9.0, scorer=first, min_duration=0.0).collect()
    best = {k: max(v[0] for key, _, _, v in rows if key == k) for k in ("k0", "k1", "k2")}
    assert [(r.key, r.score) for r in got] == [(k, pytest.approx(b, abs=1e-4)) for k, b in sorted(best.items(), key=lambda x: -x[1])]
    assert {r.key for r in recommend.recommend(own, some, -9.0, -9.0, scorer=first, min_duration=0.0).collect()} == {"k0", "k2"}


def test_candidates_by_a_scorer(spark):
    rows, own = frames(spark, 30)
    labeled = spark.createDataFrame([("k0", 0)], "key string, time_cs long")
    got = candidates.gather(own, labeled, 1, 0, scorer=scorers.column_scorer(lambda v: -v[1])).collect()
    want = {k: min((v[1], i) for key, i, _, v in rows if key == k)[1] for k in ("k0", "k1", "k2")}
    if want["k0"] == 0:
        del want["k0"]
    assert {r.key: r.frame_idx for r in got} == want
