"""The clustered index against the search over all frames."""

import random

import numpy as np
import pytest

from chronovec.operators import index, search
from chronovec.plans import queries
from chronovec.sources import shared

FRAMES = "key string, frame_idx int, time double, vec array<double>"


def clustered(spark, n=1200, d=12, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(15, d)) * 3
    rows = [(f"k{i % 37}", i // 37, float(i // 37), (centers[rng.integers(15)] + rng.normal(size=d) * 0.3).tolist()) for i in range(n)]
    rows += [("ties", i, float(i), rows[5][3]) for i in range(9)] + [("none", 0, 0.0, None), ("zero", 0, 0.0, [0.0] * d)]
    return spark.createDataFrame(rows, FRAMES)


def rows(df):
    return sorted((r.query_key, r.query_idx, r["rank"], r.key, r.frame_idx, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("options", [{"top_k": 10}, {"top_k": 7, "per_scene": 1}, {"top_k": 25, "per_scene": None, "exclude_own": False}])
def test_rows_equal_the_search_over_all_frames(spark, options):
    frames = clustered(spark)
    asked = frames.where("frame_idx = 3 OR key IN ('ties', 'zero')")
    own = index.VectorIndex(frames, rows_of_slice=30, centers=15)
    found = own.search(asked, **options)
    assert rows(found.hits) == rows(search.search_each(frames.where("vec IS NOT NULL"), asked, **options))
    assert 0 < found.meetings < found.possible and 0 < found.slices_read <= found.slices
    assert found.share < 0.6  # clusters are far apart, so that most slices stay unread


def test_any_centers_give_the_same_rows(spark):
    frames = clustered(spark, 300, 6, 2)
    asked = frames.where("frame_idx = 1")
    want = rows(search.search_each(frames.where("vec IS NOT NULL"), asked, 5))
    for centers, size, sample in ((1, 1000, 50), (4, 7, 20), (40, 50, 300)):
        assert rows(index.VectorIndex(frames, centers=centers, rows_of_slice=size, sample=sample).search(asked, 5).hits) == want


def test_many_queries_of_one_slice_meet_it_in_blocks(spark, monkeypatch):
    frames = clustered(spark, 200, 4, 3)
    want = rows(search.search_each(frames.where("vec IS NOT NULL"), frames.where("vec IS NOT NULL"), 4))
    monkeypatch.setattr(index, "QUERIES_AT_ONCE", 16)
    assert rows(index.VectorIndex(frames, rows_of_slice=50).search(frames, 4).hits) == want


def test_a_query_travels_once_to_the_slices_of_a_shelf(spark, monkeypatch):
    counts = []
    monkeypatch.setattr(index, "written", lambda df, name: counts.append((name, shared.written(df, name))) or counts[-1][1])
    frames = clustered(spark, 400, 5, 6)
    asked = frames.where("frame_idx = 2 AND vec IS NOT NULL")
    found = index.VectorIndex(frames, rows_of_slice=5, centers=1).search(asked, 4)
    assert rows(found.hits) == rows(search.search_each(frames.where("vec IS NOT NULL"), asked, 4))
    n = asked.count()
    assert found.meetings > 4 * n and all(held.count() <= n * (4 if name == "hits" else 1) for name, held in counts if name in ("visits", "hits"))


def test_the_best_under_a_cap_equal_a_full_sort():
    rng = random.Random(7)
    for _ in range(200):
        n, top, cap = rng.randrange(60), rng.randrange(6), rng.choice([None, 1, 3])
        scores, scenes = np.array([rng.randrange(9) / 9 for _ in range(n)]), np.array([rng.randrange(-1, 3) for _ in range(n)], int)
        want = []
        for i in sorted(range(n), key=lambda i: (-scores[i], i)):
            if not cap or sum(scenes[j] == scenes[i] for j in want) < cap:
                want.append(i)
        assert search._best(scores, scenes, top, cap).tolist() == want[:top]


def test_halves_of_the_sixth_place_round_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    scores = [0.2611555, -0.2611555, 0.1234565, 0.0000005, 0.0, 1.0, -0.9999995] + [round(i / 977 + 5e-7, 9) for i in range(1, 900, 7)]
    got = [r.score for r in spark.createDataFrame([(i, x) for i, x in enumerate(scores)], "i int, score double").select("i", queries._six_places("score")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in scores]


def test_similar_frames_leave_out_labeled_ones(spark):
    frames = clustered(spark, 400, 5, 4)
    labeled = spark.createDataFrame([("k1", 0), ("k2", 100), ("k3", 300)], "key string, time_cs long")
    got = index.VectorIndex(frames, normalize=True, rows_of_slice=40).similar("k4", 2.2, labeled, 12, 2)
    want = search.similar_frames(frames.where("vec IS NOT NULL"), "k4", 2.2, labeled, 12, 2)
    plain = lambda df: [(r.key, r.frame_idx, round(r.score, 6)) for r in df.orderBy("score", "key", "frame_idx").collect()]
    assert plain(got) == plain(want)


def test_nothing_to_search_or_to_ask(spark):
    frames = clustered(spark, 40, 3, 5)
    assert index.VectorIndex(frames).search(frames.limit(0)).hits.count() == 0
    assert index.VectorIndex(frames.limit(0)).search(frames.where("vec IS NOT NULL")).hits.count() == 0
