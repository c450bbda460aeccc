"""Recommendation from likes, saved scenes, weighted models and counts of a sync, on small tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from chronovec.functions import binary
from chronovec.operators import catalog, joins, preference, recommend
from chronovec.sources import stores

FRAMES = "key string, frame_idx int, time double, vec array<double>"
RULES = {"high": 0.5, "low": 0.4, "min_duration": 1.0, "merge_gap": 2.0, "max_duration": 30.0}


def axis(i, n=8):
    return [float(i == j) for j in range(n)]


@pytest.fixture
def frames(spark):
    rows = [(k, i, 2.0 * i, axis(a)) for k, a in (("A", 0), ("B", 1), ("C", 0)) for i in range(10)]
    return spark.createDataFrame(rows, FRAMES)


def test_recommendation_follows_the_likes(spark, frames):
    likes = spark.createDataFrame([("A", 4.2), ("A", 4.3), ("gone", 1.0)], "key string, time double")
    assert [(r.key, r.frame_idx) for r in recommend.liked_vectors(likes, frames).collect()] == [("A", 2)]
    own = recommend.recommend(frames, likes, exclude_seeds=False, **RULES).collect()
    assert {r.key for r in own} == {"A", "C"} and own[0].score > 0.9 and [r.rank for r in own] == [1, 2]
    other = recommend.recommend(frames, likes, **RULES).collect()
    assert [(r.key, r.start, r.end) for r in other] == [("C", 0.0, 18.0)]
    assert recommend.recommend(frames, likes.where("key = 'gone'"), **RULES).count() == 0
    assert recommend.recommend(frames, likes.limit(0), **RULES).count() == 0


def test_repeated_likes_are_looked_up_once(spark, frames, monkeypatch):
    asked = []
    monkeypatch.setattr(recommend, "nearest", lambda likes, frames: asked.append(likes.count()) or joins.nearest(likes, frames))
    likes = spark.createDataFrame([("A", 4.2), ("A", 9.9), ("B", 4.2)] * 20, "key string, time double")
    assert {(r.key, r.frame_idx) for r in recommend.liked_vectors(likes, frames).collect()} == {("A", 2), ("A", 5), ("B", 2)} and asked == [3]


def test_a_saved_scene_leaves_the_others(spark, tmp_path):
    at = str(tmp_path / "frames")
    rows = [("m", k, i, float(i), [1.0 * i, 2.0], None) for k in "ab" for i in range(3)] + [("n", "a", 0, 0.0, [1.0], "x")]
    schema = "model string, key string, frame_idx int, time float, vec array<float>, meta string"
    frames = spark.createDataFrame(rows, schema)
    stores.write_frames(frames, at)
    stores.write_frames(spark.createDataFrame([("m", "a", 0, 9.0, [5.0, 5.0], None)], schema), at)
    got = {(r.model, r.key): r["count"] for r in stores.read_frames(spark, at).groupBy("model", "key").count().collect()}
    assert got == {("m", "a"): 1, ("m", "b"): 3, ("n", "a"): 1}
    for wrong in ([("m", "c", 0, 0.0, [1.0], None), ("m", "c", 1, 1.0, [1.0, 2.0], None)], [("m", "c", 0, None, [1.0], None)]):
        with pytest.raises(ValueError):
            stores.write_frames(spark.createDataFrame(wrong, schema), at)
    assert {(r.model, r.key) for r in stores.read_frames(spark, at, keys=["b"]).select("model", "key").collect()} == {("m", "b")}
    many = spark.range(2000).select(F.lit("m").alias("model"), F.concat(F.lit("x"), "id").alias("key"), F.lit(0).alias("frame_idx"), F.lit(0.0).cast("float").alias("time"), F.array(F.lit(1.0).cast("float")).alias("vec"), F.lit(None).cast("string").alias("meta"))
    stores.write_frames(many, str(tmp_path / "many"))
    assert len(list((tmp_path / "many").rglob("*.parquet"))) == stores.BUCKETS and stores.read_frames(spark, str(tmp_path / "many")).count() == 2000
    held = stores.read_frames(spark, at)
    assert [r.key for r in catalog.cache_keys(held, "m").collect()] == ["a", "b"] and catalog.cache_models(held).count() == 2
    assert {(r.model, r.key): r.frames for r in catalog.peek_counts(held).collect()} == got


def test_weights_count_in_both_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    # at the same place both labels; the weights say which one counts
    rows = [([float(x) for x in rng.normal(side, 0.3, 4)], y, 1000.0 if y == (side > 0) else 0.001) for side in (1, -1) for y in (0, 1) for _ in range(60)]
    data = spark.createDataFrame(rows, "vec array<double>, label int, w double")
    probe = spark.createDataFrame([([1.0] * 4,), ([-1.0] * 4,)], "vec array<double>")
    for kind in ("logreg", "mlp"):
        model = preference.train(data, kind, weight="w")
        high, low = (r.probability for r in preference.predict(model, probe).collect())
        assert high > 0.8 and low < 0.2, kind
        preference.save(model, str(tmp_path / kind))
        back = preference.predict(preference.load(str(tmp_path / kind)), probe).collect()
        assert [r.probability for r in back] == pytest.approx([high, low])
        assert preference.predict(model, probe.limit(0)).count() == 0
        with pytest.raises(PySparkException):
            preference.predict(model, spark.createDataFrame([([1.0],)], "vec array<double>")).collect()
    with pytest.raises(ValueError):
        preference.train(data.unionByName(spark.createDataFrame([([1.0], 1, 1.0)], data.schema)))


def test_pruned_entries_were_orphans(spark):
    schema = "key string, path string, scene_id string"
    cached = spark.createDataFrame([("a", "/a", "1"), ("b", "/b", "2"), ("c", "/c", "3")], schema)
    library = spark.createDataFrame([("a", "/a", "1"), ("b", "/new", "2")], schema)
    for prune in (False, True):
        assert tuple(catalog.sync_counts(catalog.reconcile(cached, library, prune)).first()) == (3, 1, 1, int(prune))


def test_hashed_vectors_have_fixed_values():
    found = [float(x) for x in binary.hashed_vector(b"frame", 4)]
    seed = int(hashlib.sha256(b"frame").hexdigest()[:16], 16)
    swapped = sum(((seed >> (8 * i)) & 255) << (8 * (7 - i)) for i in range(8))
    draws = np.random.default_rng(swapped).standard_normal(4)
    assert found == pytest.approx(draws / np.linalg.norm(draws), abs=1e-6)
