"""Stores by version: what readers see after a crash at every step, conflicts, and batches that come again."""

import json

import pytest
from pyspark.sql import functions as F

from chronovec.operators.label_store import FailureLog, LabelStore, OverrideStore, marks_into
from chronovec.sources import stores, versions
from chronovec.streaming import playback


class Crash(Exception):
    pass


def likes(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, time double, label int, profile string, ts double")


def held(store):
    return sorted((r.key, r.time_cs, r.profile, r.label) for r in store.load().collect())


def test_a_crash_at_every_step_leaves_the_last_version(spark, tmp_path, monkeypatch):
    store = LabelStore(spark, str(tmp_path / "labels"))
    assert store.load().count() == 0 and store.rows() == 0
    store.add(likes(spark, ("a", 1.0, 1, "p", 1.0)))
    before = held(store)
    assert before == [("a", 100, "p", 1)] and store.rows() == 1

    def failing(name, late):
        plain = getattr(versions.VersionedStore, name)

        def run(self, *args):
            if late:
                plain(self, *args)
            raise Crash

        return run

    for step in ("_write_data", "_write_aside", "_publish"):
        for late in (False, True):
            with monkeypatch.context() as m:
                m.setattr(versions.VersionedStore, step, failing(step, late))
                with pytest.raises(Crash):
                    store.add(likes(spark, ("b", 2.0, 1, "p", 2.0)))
            done = step == "_publish" and late
            assert held(LabelStore(spark, store.path)) == ([*before, ("b", 200, "p", 1)] if done else before)
    store.add(likes(spark, ("a", 1.0, 0, "p", 3.0)))
    store.vacuum(1)
    assert held(store) == [("a", 100, "p", 0), ("b", 200, "p", 1)] and len(store.versions()) == 1


def test_of_two_writers_one_begins_anew(spark, tmp_path):
    path = str(tmp_path / "labels")
    first, second = LabelStore(spark, path), LabelStore(spark, path)
    first.add(likes(spark, ("a", 1.0, 1, "p", 1.0)))
    seen = []

    def change(rows, number):
        if not seen:  # the other writer is faster
            second.add(likes(spark, ("b", 1.0, 1, "p", 1.0)))
        seen.append(number)
        return rows.withColumn("label", F.lit(0))

    assert first.save(change) == 3 and seen == [2, 3]
    assert held(first) == [("a", 100, "p", 0), ("b", 100, "p", 0)]
    with pytest.raises(versions.Conflict):
        first.save(lambda rows, _: second.add(likes(spark, ("c", 1.0, 1, "p", 1.0))) and rows, tries=1)


def test_the_last_rating_counts_whatever_the_order_of_files(spark, tmp_path):
    store = LabelStore(spark, str(tmp_path / "labels"))
    store.add(likes(spark, ("a", 1.0, 0, "p", 5.0), ("a", 1.001, 1, "p", 9.0), ("c", 3.0, 1, "q:x", 0.0)), order="ts")
    assert held(store) == [("a", 100, "p", 1), ("c", 300, "q:x", 1)]
    store.add(likes(spark, ("a", 1.0, 0, "p", 2.0)), now=2.0)  # later, though its time is earlier
    assert held(store)[0] == ("a", 100, "p", 0) and {r.seq for r in store.load().where("key = 'a'").collect()} == {2}
    assert store.undo("p", 3.0) == 0 and store.undo("p", 2.0) == 1 and store.undo("p") == 0
    assert store.reset("q") == 1 and store.rows() == 0


def test_json_files_in_any_order_of_size(spark, tmp_path):
    row = lambda label, pad="": json.dumps({"key": "k", "time": 1.0, "label": label, "profile": "p", "scene_id": pad, "ts": 1.0})
    at = tmp_path / "files"
    at.mkdir()
    (at / "part-00000.json").write_text(row(1, "x" * 5000) + "\n" + row(0) + "\n")
    (at / "part-00001.json").write_text(row(1) + "\n")
    assert [r.label for r in stores.read_labels(spark, str(at)).collect()] == [1]
    (at / "part-00001.json").write_text(row(1, "x" * 90000) + "\n")
    assert [r.label for r in stores.read_labels(spark, str(at)).collect()] == [1]
    (at / "part-00002.json").write_text(row(0) + "\n")
    assert [r.label for r in stores.read_labels(spark, str(at)).collect()] == [0]


def test_failures_and_overrides(spark, tmp_path):
    log = FailureLog(spark, str(tmp_path / "failures"))
    failed = spark.createDataFrame([("k", "x" * 900, 1.0), ("j", "short", 2.0)], "key string, error string, ts double")
    log.record(failed)
    assert {r.key: len(r.error) for r in log.load().collect()} == {"k": 500, "j": 5}
    assert log.resolve(failed.where("key = 'k'")) == 1 and log.clear() == 1 and log.rows() == 0
    formats = OverrideStore(spark, str(tmp_path / "formats"))
    formats.put(spark.createDataFrame([("/a", "180_sbs", 1.0)], "path string, format string, ts double"))
    formats.put(spark.createDataFrame([("/a", None, True)], "path string, format string, flat boolean"))
    assert [(r.path, r.format, r.flat, r.fov) for r in formats.load().collect()] == [("/a", None, True, None)]


def test_marks_of_a_batch_that_runs_again_change_nothing(spark, tmp_path):
    marks = "key string, scene_id string, in_time double, time double, out_time double, marked_at double"
    source, at = str(tmp_path / "in"), str(tmp_path / "at")
    store = LabelStore(spark, str(tmp_path / "labels"))
    write, crashes = marks_into(store, "p", "marks"), [True]

    def crashing(batch, number):
        write(batch, number)
        if crashes:
            crashes.pop()
            raise Crash  # after the store, before the batch is known as done

    def run(sink):
        stream = spark.readStream.schema(marks).parquet(source)
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()

    spark.createDataFrame([("k", "/k", 1.0, 2.0, 3.0, 7.0), (None, None, None, 5.0, None, 7.0)], marks).write.parquet(source)
    with pytest.raises(Exception):
        run(crashing)
    assert store.current()[0] == 1
    store.undo("p", 0.0)  # what came in between stays
    run(crashing)
    assert store.current()[0] == 2 and held(store) == []
    spark.createDataFrame([("k", "/k", None, 4.0, None, 8.0)], marks).write.mode("append").parquet(source)
    run(crashing)
    assert held(store) == [("k", 400, "p", 1)]


def test_a_stream_that_runs_again_returns_what_it_wrote(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2)], "source string, seq int").write.parquet(source)
    stream = lambda: spark.readStream.schema("source string, seq int").parquet(source)
    append = lambda: sorted(tuple(r) for r in playback.run_to_table(stream(), "again", str(tmp_path / "append"), "append").collect())
    latest = lambda: sorted(tuple(r) for r in playback.run_to_table(playback.latest_state(stream(), "source", "seq"), "last", str(tmp_path / "complete")).collect())
    for _ in range(2):
        assert append() == latest() == [("a", 1), ("b", 2)]
    spark.createDataFrame([("a", 3)], "source string, seq int").write.mode("append").parquet(source)
    for _ in range(2):
        assert append() == [("a", 1), ("a", 3), ("b", 2)] and latest() == [("a", 3), ("b", 2)]
