"""Connections, progress, tags and markers to write on small tables."""

import math
import random
import struct
from datetime import datetime

import pytest

from chronovec.operators import catalog, joins, library, search
from chronovec.streaming import playback


def test_connections_end_after_a_longer_silence(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", at(s)) for s in (0, 1, 1, 3, 6, 20)] + [("b", at(2)), (None, at(2)), ("b", None)]
    packets = spark.createDataFrame(rows, "source string, ts timestamp")
    want = {("a", at(0), at(9), 5), ("a", at(20), at(23), 1), ("b", at(2), at(5), 1)}
    assert {tuple(r) for r in playback.connections(packets).collect()} == want
    assert playback.connections(packets.limit(0)).count() == 0
    packets.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    got = playback.run_to_table(playback.connections(stream), "held", str(tmp_path / "at"))
    assert {tuple(r) for r in got.collect()} == want


def test_states_of_a_stream_are_written_not_collected(spark, tmp_path):
    rows = [(i % 50, i, f"p{i}") for i in range(200)]
    spark.createDataFrame(rows, "source int, seq int, path string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source int, seq int, path string").parquet(str(tmp_path / "in"))
    got = playback.run_to_table(playback.latest_state(stream, "source", "seq"), "states", str(tmp_path / "at"))
    assert got.inputFiles() and all(str(tmp_path) in f for f in got.inputFiles())
    assert {tuple(r) for r in got.collect()} == {(i % 50, i, f"p{i}") for i in range(150, 200)}


def test_progress_is_unknown_without_steps(spark):
    jobs = spark.createDataFrame([(1, 4, 10, 8.0), (2, 0, 10, 8.0), (3, None, 10, 8.0), (4, 1, 0, 8.0), (5, 10, 10, None)], "job int, done long, total long, elapsed double")
    assert {r.job: r.eta for r in catalog.progress(jobs).collect()} == {1: 12.0, 2: None, 3: None, 4: None, 5: None}


def test_tags_and_new_markers(spark):
    tags = spark.createDataFrame([(2, "x"), (1, "x"), (3, "X"), (4, None)], "id int, name string")
    assert [tuple(r) for r in library.tag_named(tags, "x").collect()] == [(1, "x")]
    assert library.tag_named(tags, "y").count() == 0
    own = spark.createDataFrame([("k", "t", 0.0, 4.0, 0.5), ("k", "t", 10.0, 12.0, 0.25), ("k", "u", 0.0, 4.0, 1.0), ("n", "t", 0.0, 4.0, None)], "key string, tag string, start double, end double, peak double")
    held = spark.createDataFrame([("k", "t", 4.0, None), ("k", "t", None, 11.0)], "key string, tag string, seconds double, end_seconds double")
    got = {(r.key, r.tag, r.title, r.seconds, r.end_seconds) for r in joins.new_markers(own, held).collect()}
    assert {g for g in got if g[0] == "k"} == {("k", "t", "t 0.250", 10.0, 12.0), ("k", "u", "u 1.000", 0.0, 4.0)} and len(got) == 3


def test_messages_go_on_over_chunks(spark, tmp_path):
    data = struct.pack(">I", 5) + b"hello" + struct.pack(">I", 0) + struct.pack(">I", 3) + "nö".encode()
    chunks = [("a", i, data[i * 4 : i * 4 + 4]) for i in range(-(-len(data) // 4))] + [("b", 0, data[:9]), ("b", 1, None), ("b", 2, data[9:])]
    schema = "source string, seq int, data binary"
    for i in range(6):
        part = [c for c in chunks if c[1] // 2 == i]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = playback.run_to_table(playback.messages(stream), "messages", str(tmp_path / "at"), "append")
    rows = sorted((r.source, r.seq, r.nth, r.message) for r in got.collect())
    assert [r[3] for r in rows if r[0] == "a"] == ["hello", None, "nö"] and [r for r in rows if r[0] == "b"] == [("b", 0, 0, "hello"), ("b", 2, 0, None), ("b", 2, 1, "nö")]


def test_demo_feed_loops(spark):
    feed = playback.demo_feed(spark, "/x", 10.0)
    assert feed.isStreaming and {"source", "path", "current_time", "duration"} <= set(feed.columns)


def test_search_for_each_query_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vec = [[float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(12)] + [[0.0] * 3]
    rows = [(rng.choice([*"abc", None]), i, float(i), rng.choice(vec)) for i in range(120)]
    frames = spark.createDataFrame(rows, "key string, frame_idx int, time double, vec array<double>")
    asked = rows[:15]
    want = {}
    for key, idx, _, q in asked:
        n = math.sqrt(sum(x * x for x in q)) or 1.0
        found = [(-round(sum(a * b / n for a, b in zip(v, q)), 9), k or "", i) for k, i, _, v in rows if key is None or k != key]
        seen: dict = {}
        kept = []
        for s, k, i in sorted(found):
            seen[k] = seen.get(k, 0) + 1
            if seen[k] <= 4:
                kept.append((i, -s))
        want[idx] = kept[:9]
    for sizes in ((1024, 16384), (4, 25)):
        monkeypatch.setattr(search, "QUERIES_AT_ONCE", sizes[0]), monkeypatch.setattr(search, "FRAMES_AT_ONCE", sizes[1])
        got = search.search_each(frames, spark.createDataFrame(asked, frames.schema), 9, 4).orderBy("query_idx", "rank").collect()
        for idx in want:
            assert [r.frame_idx for r in got if r.query_idx == idx] == [i for i, _ in want[idx]]
            assert [r.score for r in got if r.query_idx == idx] == pytest.approx([s for _, s in want[idx]])
        assert search.search_each(frames, frames.limit(0)).count() == 0 and search.search_each(frames.limit(0), frames).count() == 0
