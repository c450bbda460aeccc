"""Labels, joins, catalog, names, playlists, models and sources on small tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovec.functions import binary, names
from chronovec.operators import candidates, catalog, joins, labels, playlist, preference
from chronovec.sources import stores
from chronovec.streaming import playback


def test_label_algebra(spark):
    rows = [("k", 100, "base:a", 1, 1, 5.0), ("k", 100, "base:a", 0, 2, 9.0), ("k", 200, "base", 1, 3, None), ("j", 1, "base2", 1, 4, 1.0), ("j", 1, "base:a", 1, 5, 7.0)]
    store = labels.upsert(spark.createDataFrame(rows, "key string, time_cs long, profile string, label int, seq long, ts double"))
    assert store.count() == 4
    assert {r.profile: (r.pos, r.neg) for r in labels.counts(store).collect()} == {"base:a": (1, 1), "base": (1, 0), "base2": (1, 0)}
    assert {r.profile: r.likes for r in labels.summary(store, "base").collect()} == {"base:a": 1, "base": 1, "*": 2}
    assert {r.profile for r in labels.reset(store, "base").collect()} == {"base2"}
    assert labels.remove(store, "base:a", 8.0).count() == 3 and labels.remove(store, "base", 0.0).count() == 3
    assert {r.base for r in labels.bases(store, "x").collect()} == {"base", "base2", "x"}
    marks = spark.createDataFrame([(1, 48.0, 50.0, 53.0), (2, None, 5.0, 5.0)], "id int, in_time double, time double, out_time double")
    assert [(r.id, r.mark) for r in labels.mark_times(marks).orderBy("id", "mark").collect()] == [(1, 48.0), (1, 50.0), (1, 53.0), (2, 5.0)]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(4)
    frames = [(k, i, i * 2.0) for k in "abc" for i in range(rng.choice([1, 5, 20]))]
    marks = [(k, rng.choice([rng.uniform(-5, 50), float(rng.randrange(40))]), n) for n, k in enumerate("abcd" * 40)]
    frames += [("a", 30, 30.0), ("a", 31, 30.0), ("a", 32, None), (None, 0, 1.0)]
    odd = [("a", None, 900), (None, 1.0, 901)]
    for span in (1.0, 7.0, joins.SPAN):
        found = joins.nearest(spark.createDataFrame(marks + odd, "key string, time double, n int"), spark.createDataFrame(frames, "key string, frame_idx int, time double"), span)
        got = {r.n: r.frame_idx for r in found.collect()}
        assert not {900, 901} & set(got)
        for k, t, n in marks:
            own = [(abs(ft - t), i) for fk, i, ft in frames if fk == k and ft is not None]
            assert got.get(n) == (min(own)[1] if own else None)


def test_nearest_of_many_labels_runs_in_streams(spark):
    rng = random.Random(8)
    frames = [(k, i, i * 2.0) for k in "ab" for i in range(20)] + [("a", 30, 30.0), ("b", 40, 90.0)]
    marks = [("a" if n % 7 else "b", rng.choice([rng.uniform(-5, 50), float(rng.randrange(40)), 31.0]), n, {"n": n}) for n in range(300)]
    found = joins.nearest(spark.createDataFrame(marks, "key string, time double, n int, more map<string,int>"), spark.createDataFrame(frames, "key string, frame_idx int, time double"), 60.0, 20)
    # such a frame is computed from its start for each row
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    got = {r.n: (r.frame_idx, r.more["n"]) for r in found.collect()}
    assert got == {n: (min((abs(ft - t), i) for fk, i, ft in frames if fk == k)[1], n) for k, t, n, _ in marks}


def test_overlap_equals_brute_force(spark):
    rng = random.Random(6)
    time = lambda: rng.choice([None, float(rng.randrange(40)), float(rng.randrange(40))])
    segs = [(k, t, a, a + rng.randrange(4), n) for n in range(80) for k in ("a", None) for t in (1, 2) for a in [float(rng.randrange(40))]] + [("a", 1, None, 3.0, 80), ("a", 1, 3.0, None, 81)]
    marks = [(k, t, time(), time()) for _ in range(6) for k in ("a", None) for t in (1, 2, None)]
    got = joins.without_overlap(
        spark.createDataFrame(segs, "key string, tag int, start double, end double, n int"), spark.createDataFrame(marks, "key string, tag int, seconds double, end_seconds double")
    )
    touches = lambda s, m: None not in (s[0], s[2], s[3], m[2]) and s[:2] == m[:2] and s[2] <= (m[2] if m[3] is None else m[3]) and s[3] >= m[2]
    want = [s for s in segs if not any(touches(s, m) for m in marks)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want)) and len(want) < len(segs)


def test_folds_are_even_in_each_class(spark):
    data = spark.createDataFrame([([float(i // 2)], i % 3 % 2) for i in range(100)], "vec array<double>, label int")
    counts = {(r.label, r.fold): r["count"] for r in preference.stratified_folds(data, 4, buckets=7).groupBy("label", "fold").count().collect()}
    assert len(counts) == 8 and all(max(c) - min(c) <= 1 for c in ([n for (y, _), n in counts.items() if y == label] for label in (0, 1)))


def test_auc_sums_over_ranges(spark):
    rng = random.Random(8)
    rows = [(m, float(rng.randrange(60)), rng.randrange(2)) for m in ("x", "y") for _ in range(300)]
    got = {r.model: r.auc for r in preference.auc(spark.createDataFrame(rows, "model string, score double, label int").repartition(4)).collect()}
    for m in got:
        pos, neg = ([s for k, s, y in rows if k == m and y == label] for label in (1, 0))
        assert got[m] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def test_overlap_and_catalog(spark):
    segs = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, 0.0, 5.0), ("b", 1, 0.0, 5.0), ("a", 1, 9.0, 9.5)], "key string, tag int, start double, end double")
    marks = spark.createDataFrame([("a", 1, 5.0, None), ("b", 1, 6.0, 8.0)], "key string, tag int, seconds double, end_seconds double")
    assert joins.without_overlap(segs, marks).count() == 3
    cached = spark.createDataFrame([("a", "/x", 1, -108.0), ("b", "/y", 2, 8.0), ("c", "/z", 3, None)], "key string, path string, scene_id int, interval double")
    library = spark.createDataFrame([("a", "/moved", 1), ("b", "/y", 2)], "key string, path string, scene_id int")
    assert {r.key: r.status for r in catalog.reconcile(cached, library).collect()} == {"a": "moved", "b": "unchanged", "c": "orphaned"}
    assert {r.status for r in catalog.reconcile(cached, library, prune=True).collect()} == {"moved", "unchanged", "pruned"}
    scenes = spark.createDataFrame([("a", -108.0), ("b", -108.0), ("c", -108.0)], "key string, signature double")
    assert {r.key for r in catalog.worklist(scenes, cached).collect()} == {"b", "c"} and catalog.fresh(scenes, cached).count() == 1


@pytest.mark.parametrize(
    "name,aspect,assume,want",
    [
        ("clip_MKX200_SBS.mp4", None, None, ("fisheye", "sbs", 200.0, "filename")),
        ("clip 180 LR", None, "mkx220_tb", ("equirect", "sbs", 180.0, "filename")),
        ("clip", 2.0, "180", ("equirect", "sbs", 180.0, "aspect+assumed")),
        ("clip", None, None, ("unknown", "unknown", None, "none")),
        ("clip 360", 1.3, None, ("equirect", "unknown", 360.0, "filename")),
    ],
)
def test_formats(spark, name, aspect, assume, want):
    row = spark.createDataFrame([(name, aspect, assume)], "name string, aspect double, assume string")
    f = row.select(names.detect_format(F.col("name"), F.col("aspect"), F.col("assume")).alias("f")).first()["f"]
    assert (f.projection, f.layout, f.fov, f.source) == want


def test_names(spark):
    row = spark.range(1).select(
        names.resolve_profile(F.lit("b"), F.lit(" a b/é ")).alias("p"), names.resolve_profile(F.lit("b"), F.lit("  ")).alias("q"),
        names.log_times(F.lit("x pts_time: 1.5 y pts_time:2")).alias("t"), names.model_namespace(F.lit("dinov2_vitb14")).alias("m"),
        names.model_namespace(F.lit("ViT-L-14")).alias("c"), names.display_name(F.lit("a/b\\c.mp4")).alias("d"),
        names.scene_key(F.create_map(F.lit("oshash"), F.lit(""), F.lit("md5"), F.lit("m")), F.lit("p"), F.lit("i")).alias("k"),
    ).first()
    assert (row.p, row.q, row.t, row.m, row.c, row.d, row.k) == ("b:a_b_é", "b", [1.5, 2.0], "dinov2-vitb14", "clip-vit-l-14", "c.mp4", "m")


def test_schedule(spark):
    rows = [(1, "A", 0.0, 8.0), (2, "A", 20.0, 28.0), (3, "B", 5.0, 6.0)]
    got = playlist.schedule(spark.createDataFrame(rows, "rank int, path string, start double, end double").withColumn("playlist", F.lit(1))).orderBy("rank").collect()
    assert [(r.action, r.hold, r["at"]) for r in got] == [("load", 8.5, 0.0), ("seek", 8.0, 8.5), ("load", 2.5, 16.5)]


def test_candidates(spark):
    scored = spark.createDataFrame([("k%d" % k, i, i * 1.0, (i * 7 % 10) / 10) for k in range(3) for i in range(10)], "key string, frame_idx long, time double, score double")
    known = spark.createDataFrame([("k0", 700)], "key string, time_cs long")
    got = candidates.gather(scored, known, 3, 1).collect()
    assert sum(r.pool == "top" for r in got if r.key == "k0") == 2 or ("k0", 7) not in {(r.key, r.frame_idx) for r in got}
    assert candidates.gather(scored, known, 3, 1, limit=6).count() == 6
    assert {r.score for r in candidates.suggest(scored, known, likes=0).collect()} == {0.0}


def test_a_budget_of_candidates_is_cut_by_rounded_scores(spark):
    rows = [(f"k{k}", i, float(i), 1.0 - 1e-9 * (9 - k) if i == 0 else 0.1) for k in range(10) for i in range(4)]
    none = spark.createDataFrame([], "key string, time_cs long")
    got = candidates.gather(spark.createDataFrame(rows, "key string, frame_idx long, time double, score double"), none, 2, 1, limit=6).collect()
    assert {(r.key, r.frame_idx) for r in got if r.pool == "top"} == {(f"k{k}", 0) for k in range(4)}


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [([float(x) for x in rng.normal(1 if y else -1, 0.3, 6)], y) for y in (0, 1) for _ in range(40)]
    data = spark.createDataFrame(rows, "vec array<double>, label int")
    probe = spark.createDataFrame([([1.0] * 6, 1), ([-1.0] * 6, 0)], "vec array<double>, label int")
    for kind in ("logreg", "mlp"):
        p = [r.probability for r in preference.predict(preference.train(data, kind), probe).collect()]
        assert p[0] > 0.8 and p[1] < 0.2
    assert preference.cross_validated_auc(data, 3) > 0.95
    with pytest.raises(ValueError):
        preference.train(data.where("label = 1"))
    w = preference.recency_weights(spark.createDataFrame([(0.0,), (86400.0,), (10 * 86400.0,)], "ts double"), 1.0, 0.0).collect()
    assert [r.weight for r in w] == pytest.approx([0.05, 0.05, 1.0])


def test_sources(spark, tmp_path):
    vecs = np.eye(3, dtype=np.float16)
    (tmp_path / "npz").mkdir()
    np.savez(tmp_path / "npz" / "k1.npz", times=np.arange(3, dtype=np.float32), vecs=vecs, meta=json.dumps({"path": "x"}))
    (tmp_path / "npz" / "bad.npz").write_bytes(b"no")
    got = stores.read_archives(spark, str(tmp_path / "npz")).orderBy("frame_idx").collect()
    assert [(r.key, r.frame_idx, list(r.vec)) for r in got] == [("k1", i, [float(i == j) for j in range(3)]) for i in range(3)]
    (tmp_path / "labels.json").write_text(json.dumps([{"key": "a", "time": 1.0, "label": 1, "profile": "p"}]))
    assert stores.read_json_list(spark, str(tmp_path / "labels.json"), stores.LABELS).first()["ts"] is None
    (tmp_path / "broken.json").write_text("{not json")
    assert stores.read_json_list(spark, str(tmp_path / "broken.json"), stores.LABELS).count() == 0
    (tmp_path / "v" / "w").mkdir(parents=True)
    for n in ("v/a.MP4", "v/w/b.mkv", "v/c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert {r.title for r in stores.video_files(spark, str(tmp_path / "v")).collect()} == {"a", "b"}
    moments = spark.createDataFrame([("p", 1, "f", "k", 0.0, 2.0, 0.5), ("p", 0, "f", "k", 5.0, 9.0, None)], "profile string, rank int, path string, key string, start double, end double, score double")
    stores.write_playlist(moments, str(tmp_path / "list"))
    back = stores.read_playlist(spark, str(tmp_path / "list")).orderBy("rank").collect()
    assert [(r.start, r.score) for r in back] == [(5.0, 0.0), (0.0, 0.5)]
    assert stores.decode_packets('{"a":1} \n{"b":{}}{"c"') == [{"a": 1}, {"b": {}}]


def test_playback(spark, tmp_path):
    packets = [('{"resource":"/r","currentTime":3}',), ('{"path":"/p","playerState":1,"playbackSpeed":2}',), ("{}",)]
    s = [r.s for r in spark.createDataFrame(packets, "p string").select(playback.playback_state(F.col("p")).alias("s")).collect()]
    assert [(x.path, x.current_time, x.playing, x.playback_speed) for x in s] == [("/r", 3.0, True, 1.0), ("/p", 0.0, False, 2.0), (None, 0.0, True, 1.0)]
    states = spark.createDataFrame([("x", "/p"), ("y", None)], "source string, path string")
    marks = spark.createDataFrame([("x", 1.0, 2.0, 3.0, 9.0), ("y", 1.0, 2.0, 3.0, 9.0)], "source string, in_time double, time double, out_time double, marked_at double")
    assert [r.time for r in playback.marks_to_labels(marks, states, "p").orderBy("time").collect()] == [1.0, 2.0, 3.0]


def test_entry_imports_without_training_data_operators():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_label_store_and_playlists_of_several_records(spark, tmp_path):
    at = str(tmp_path / "labels")
    rows = [("k", 1.0, 1, "p", None, 5.0), ("k", 1.001, 0, "p", "s", None), ("j", 2.0, 1, "p", None, 1.0)]
    for n in (3, 2):
        stores.write_labels(spark.createDataFrame(rows[:n], stores.LABELS).coalesce(1), at)
        assert sorted((r.key, r.label, r.ts) for r in stores.read_labels(spark, at).collect()) == [("j", 1, 1.0), ("k", 0, 0.0)][3 - n :]
    # a store is written from what was read of itself
    stores.write_labels(stores.read_labels(spark, at), at)
    assert stores.read_labels(spark, at).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["labels"]
    (tmp_path / "list.json").write_text(json.dumps([{"key": "k", "time": 1.0, "label": n, "profile": "p"} for n in (1, 0)], indent=1))
    assert [r.label for r in stores.read_labels(spark, str(tmp_path / "list.json"), lines=False).collect()] == [0]
    moments = spark.createDataFrame([(p, i, "/x", "k", 0.0, 1.0, 0.5) for p in "ab" for i in range(2)], "profile string, rank int, path string, key string, start double, end double, score double")
    stores.write_playlist(moments.coalesce(1), str(tmp_path / "lists"))
    assert stores.read_playlist(spark, str(tmp_path / "lists")).count() == 4


def test_reference_stills_and_named_files(spark, tmp_path):
    base = tmp_path / "refs"
    (base / "a_b").mkdir(parents=True)
    for name in ("x.JPG", "y.png", "z.txt", "a_b/w.png"):
        (base / name).write_bytes(name.encode())
    names = lambda df: {r.path.rsplit("/", 1)[1] for r in df.collect()}
    assert names(stores.reference_files(spark, str(base))) == {"x.JPG", "y.png"}
    assert stores.references_dir(spark, str(base), "a b") == f"{base}/a_b" and stores.references_dir(spark, str(base), "other") == str(base)
    held = stores.load_references(spark, f"{base}/a_b", binary.hashed_embedding).collect()
    assert [r.vec for r in held] == [pytest.approx(binary.hashed_vector(b"a_b/w.png", 32).tolist())]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        stores.load_references(spark, str(tmp_path / "none"), binary.hashed_embedding)
    (base / "v.MP4").write_bytes(b"")
    assert names(stores.video_files(spark, [str(base), str(base / "z.txt"), str(base / "v.MP4")])) == {"v.MP4", "z.txt"}
