"""Sources that fall silent, and JSON without framing, as streams."""

import json
import time

import pytest

from chronovec.streaming import jsonstream, liveness, playback

STATES = "source string, seq long, path string, current_time double"


def test_a_silent_source_is_no_longer_connected_over_batches_and_a_restart(spark, tmp_path):
    source, at, got = str(tmp_path / "in"), str(tmp_path / "at"), []

    def add(*rows):
        spark.createDataFrame(list(rows), STATES).coalesce(1).write.mode("append").parquet(source)

    def run(wanted, seconds=60.0):
        """Runs the stream until a row is there, and stops it."""
        stream = spark.readStream.schema(STATES).parquet(source)
        keep = lambda batch, n: got.extend((r.source, r.seq, r.path, r.connected) for r in batch.collect())
        query = liveness.mirror(stream, "source", "seq", 2.0).writeStream.foreachBatch(keep).outputMode("update")
        query = query.option("checkpointLocation", at).trigger(processingTime="300 milliseconds").start()
        try:
            until = time.time() + seconds
            while not set(wanted) <= set(got) and time.time() < until and query.isActive:
                time.sleep(0.1)
        finally:
            query.stop()
        found = list(got)
        got.clear()
        assert set(wanted) <= set(found), (found, query.exception())
        return found

    add(("a", 1, "/x", 1.0), ("a", 3, "/z", 3.0), ("a", 2, "/y", 2.0), ("b", 1, None, None))
    found = run([("a", 3, "/z", True), ("b", 1, None, True)])
    assert {r[1] for r in found if r[0] == "a"} == {3}
    time.sleep(2.5)
    add(("b", 2, "/b", 0.0))
    # a restart: a's timer has run out; b is connected again, then silent in the same run
    found = run([("a", 3, "/z", False), ("b", 2, "/b", True), ("b", 2, "/b", False)])
    assert [r for r in found if r[0] == "a"] == [("a", 3, "/z", False)]


STREAM = '{"a": "}{", "b": [1, {"c": "\\\\\\""}]} {"ü": "日本\\n"}\n[1, {"no": 1}]{"x":{}} junk {"last": "\\u007b"}'
WHOLE = [{"a": "}{", "b": [1, {"c": '\\"'}]}, {"ü": "日本\n"}, {"x": {}}, {"last": "{"}]


def test_objects_are_found_whatever_the_cuts():
    data = STREAM.encode()
    for a in range(len(data) + 1):
        for b in range(a, len(data) + 1, 3):
            rest, found = b"", []
            for part in (data[:a], data[a:b], data[b:]):
                own, rest = jsonstream.split_objects(rest, part)
                found += own
            objects = [json.loads(t) for t in map(jsonstream._text, found) if t is not None]
            assert objects == WHOLE and rest == b""
    own, rest = jsonstream.split_objects(b"", data + b' {"open": "')
    assert len(own) == 5 and rest == b'{"open": "'


def test_objects_of_a_batch_and_of_a_stream(spark, tmp_path):
    data, schema = STREAM.encode(), "source string, seq long, data binary"
    cuts = [0, 3, 20, 21, 47, 50, 51, len(data)]
    chunks = [("s", i, data[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [("t", 0, b'{"t": '), ("t", 1, None), ("t", 2, b"1}"), ("u", 0, b'{"never')]
    batch = jsonstream.json_objects(spark.createDataFrame(chunks, schema)).collect()
    want = sorted((r.source, r.seq, r.nth, r.message) for r in batch)
    assert [json.loads(m) for s, _, _, m in want if s == "s"] == WHOLE and [json.loads(m) for s, _, _, m in want if s == "t"] == [{"t": 1}]
    for i in range(0, 8, 2):  # files in order
        part = [c for c in chunks if c[1] // 2 * 2 == i]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = playback.run_to_table(jsonstream.json_objects(stream), "objects", str(tmp_path / "at"), "append").collect()
    assert sorted((r.source, r.seq, r.nth, r.message) for r in got) == want
