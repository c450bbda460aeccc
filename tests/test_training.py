"""Training of profiles: folds at once, the weighted bootstrap, statistics; against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovec.operators import preference, slices


def data(spark, n=150, d=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) * 0.8 > 0.6).astype(int)
    return spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y)], "vec array<double>, label int").repartition(5)


def newton(x, y):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    penalty = np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (p - y)) + penalty @ b)
    return b


def rank_auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return float(np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]))


def test_models_of_all_folds_equal_numpy(spark):
    own = preference.written(preference.stratified_folds(data(spark), 4, 3), "folds")
    rows = own.collect()
    x, y, fold = np.array([r.vec for r in rows]), np.array([r.label for r in rows]), np.array([r.fold for r in rows])
    got = preference.fold_models(own, 4)
    areas = []
    for k in range(4):
        b = newton(x[fold != k], y[fold != k])
        assert got[k] == pytest.approx(b, abs=1e-7)
        areas.append(rank_auc(x[fold == k] @ b[:-1] + b[-1], y[fold == k]))
    assert preference.cross_validated_auc(data(spark), 4, seed=3) == pytest.approx(np.mean(areas), abs=1e-9)


def test_a_model_of_all_rows_equals_the_trained_one(spark):
    own = data(spark, 80)
    model = preference.train(own, "logreg")
    got = preference.fold_models(own.withColumn("fold", F.lit(9)), 1)[0]  # no row is left out
    assert got[:-1] == pytest.approx(model.coefficients.toArray(), abs=1e-4) and got[-1] == pytest.approx(model.intercept, abs=1e-4)


def test_bootstrap_equals_cumulated_weights(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, int(i % 3 == 0), rng.choice([0.0, 0.05, 1.0, 3.0])) for i in range(90)]
    own = spark.createDataFrame(rows, "_row long, label int, weight double")
    share = F.shiftrightunsigned(F.xxhash64("id", F.lit(0), F.lit(7)), 11).cast("double") / float(1 << 53)
    for size in (20, 1000):
        monkeypatch.setattr(slices, "SLICE", size)
        got = {r["_row"]: r.times for r in preference.drawn_rows(own, "weight", 7).collect()}
        for label in (0, 1):
            held = [(i, max(w, 1e-9)) for i, y, w in rows if y == label]
            ends = np.cumsum([w for _, w in held])
            draws = [r[0] for r in spark.range(len(held)).select((share if label == 0 else F.shiftrightunsigned(F.xxhash64("id", F.lit(1), F.lit(7)), 11).cast("double") / float(1 << 53)) * float(ends[-1])).collect()]
            at = np.searchsorted(ends, draws, side="right")
            want = {held[k][0]: int(n) for k, n in zip(*np.unique(at, return_counts=True))}
            assert {i: n for i, n in got.items() if rows[i][1] == label} == want and sum(want.values()) == len(held)


def test_recent_rows_decide_a_weighted_network(spark):
    rows = [([float(i % 2), 1.0], i % 2, 1.0) for i in range(60)] + [([float(i % 2), 1.0], 1 - i % 2, 1e-9) for i in range(60)]
    model = preference.train(spark.createDataFrame(rows, "vec array<double>, label int, weight double"), "mlp", "weight")
    got = preference.predict(model, spark.createDataFrame([([0.0, 1.0],), ([1.0, 1.0],)], "vec array<double>")).orderBy("probability").collect()
    assert [r.vec[0] for r in got] == [0.0, 1.0] and got[0].probability < 0.1 and got[1].probability > 0.9


def profile(spark, n, unknown=False):
    rng = np.random.default_rng(5)
    frames = [(f"k{i % 4}", i // 4, float(i // 4), rng.normal(size=3).tolist()) for i in range(4 * n)]
    marked = [(k, t + 0.2, int(v[0] > 0.2), "p", 0.0 if unknown else float(i)) for i, (k, _, t, v) in enumerate(frames[: 2 * n])]
    marked += [("k0", 0.0, 1, "other", 1.0), ("gone", 0.0, 1, "p", 1.0)]
    schema = "key string, time double, label int, profile string, ts double"
    return spark.createDataFrame(marked, schema), spark.createDataFrame(frames, "key string, frame_idx int, time double, vec array<double>"), marked, frames


def test_statistics_of_a_profile(spark):
    labels, frames, marked, known = profile(spark, 30)
    model, stats = preference.train_profile(labels, frames, "p", "auto", 1.0, 100.0)
    own = [m for m in marked if m[3] == "p" and m[0] != "gone"]
    pos = sum(m[2] for m in own)
    assert stats["samples"] == len(own) == 60 and stats["positives"] == pos and stats["kind"] == "logreg" and stats["recency"] and stats["cv_folds"] == min(5, pos, 60 - pos)
    dealt = preference.stratified_folds(preference.training_set(labels, frames, "p").select("vec", "label"), stats["cv_folds"]).collect()
    x, y, fold = np.array([r.vec for r in dealt]), np.array([r.label for r in dealt]), np.array([r.fold for r in dealt])
    areas = []
    for k in range(stats["cv_folds"]):
        b = newton(x[fold != k], y[fold != k])
        areas.append(rank_auc(x[fold == k] @ b[:-1] + b[-1], y[fold == k]))
    assert stats["cv_auc"] == pytest.approx(np.mean(areas), abs=6e-4) and stats["cv_auc"] > 0.9
    vec = known[0][3]
    assert preference.predict(model, spark.createDataFrame([(vec,)], "vec array<double>")).first()["probability"] is not None


def test_rows_that_stand_for_several_are_dealt_as_these(spark):
    own = spark.createDataFrame([([float(i)], i % 2, 1 + i * 7 % 23) for i in range(30)], "vec array<double>, label int, times long")
    each = own.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("again", "times")
    want = {(r.vec[0], r.label, r.fold): r["count"] for r in preference.stratified_folds(each, 4, 2, 3).groupBy("vec", "label", "fold").count().collect()}
    got = {(r.vec[0], r.label, r.fold): r.times for r in preference.stratified_folds(own, 4, 2, 3, "times").collect()}
    assert got == want


def test_labels_of_one_frame_are_one_row(spark, monkeypatch):
    labels, frames, *_ = profile(spark, 10)
    labels = labels.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("ts", F.col("ts") + 3600.0 * F.col("again"))
    labels = labels.withColumn("label", F.when(F.col("again") <= 3, 1 - F.col("label")).otherwise(F.col("label"))).drop("again")
    tables, written = {}, preference.written
    monkeypatch.setattr(preference, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    model, stats = preference.train_profile(labels, frames, "p", "logreg", 0.2, 100.0)
    each = preference.training_set(labels, frames, "p")
    assert tables["examples"].count() == 40 and stats["samples"] == each.count() == 240
    want = preference.train(preference.recency_weights(each, 0.2, 100.0), "logreg", "weight")
    assert model.coefficients.toArray() == pytest.approx(want.coefficients.toArray(), abs=1e-5) and model.intercept == pytest.approx(want.intercept, abs=1e-5)
    tables.clear()
    assert stats["cv_auc"] == pytest.approx(preference.cross_validated_auc(each.select("vec", "label"), 5), abs=6e-4)


def test_large_profiles_take_the_network_and_unknown_times_no_weights(spark):
    labels, frames, *_ = profile(spark, 110, unknown=True)
    _, stats = preference.train_profile(labels, frames, "p", "auto", 1.0, 100.0)
    assert stats == {"samples": 220, "positives": stats["positives"], "kind": "mlp", "recency": False}
    with pytest.raises(ValueError, match="both"):
        preference.train_profile(labels.where("label = 1"), frames, "p")
