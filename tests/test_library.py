"""Library records, byte strings and stored formats on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronovec.functions import binary, names
from chronovec.operators import labels, library

SCENES = (
    "scene_id int, title string, studio string, people array<struct<id:int,name:string>>, files array<struct<path:string,duration:double>>, "
    "markers array<struct<marker_id:int,seconds:double,end_seconds:double,title:string,tags:array<string>>>"
)


@pytest.fixture
def scenes(spark):
    rows = [
        (1, None, "s", [(7, "Ann"), (8, None)], [("/a", 5.0), ("/b", 6.0)], [(1, 2.0, 0.0, None, ["x"]), (2, 3.0, 4.0, "t", ["y", "x"]), (3, 1.0, 2.0, "u", None)]),
        (2, "two", None, None, None, None),
        (3, "three", "s", [(7, "Ann"), (7, "Ann")], [], [(4, None, None, "v", ["x"])]),
    ]
    return spark.createDataFrame(rows, SCENES)


def test_scene_records(spark, scenes):
    found = library.markers_by_tag(scenes, "x").collect()
    assert [(r.scene_id, r.marker_id, r.seconds, r.end_seconds, r.title) for r in found] == [(1, 1, 2.0, None, ""), (1, 2, 3.0, 4.0, "t"), (3, 4, 0.0, None, "v")]
    assert library.markers_by_tag(scenes.limit(0), "x").count() == 0
    wanted = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,)], "scene_id int")
    got = {r.scene_id: (r.title, r.studio, r.people, r.duration) for r in library.scene_details(scenes, wanted).collect()}
    assert got == {1: ("", "s", ["Ann", ""], 5.0), 2: ("two", "", [], None)}
    assert sorted(r.scene_id for r in library.scenes_with(scenes, F.lit(7)).collect()) == [1, 3]
    assert {(r.id, r.name): r.scene_count for r in library.find_people(scenes, "^A").collect()} == {(7, "Ann"): 2}
    assert library.find_people(scenes).count() == 2
    gone = spark.createDataFrame([(2,), (2,)], "marker_id int")
    assert {r.marker_id for r in library.without_markers(library.markers_by_tag(scenes, "x"), gone).collect()} == {1, 4}


def test_tags(spark):
    tags = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")
    wanted = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "name string")
    got = {r.name: (r.id, r.created) for r in library.find_or_create_tags(tags, wanted).collect()}
    assert got["a"] == ("1", False) and got["b"] == ("2", False) and got["c"][1] and len(got) == 3
    scenes = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, None), (4, ["a"])], "scene_id int, tags array<string>")
    changes = spark.createDataFrame([(1, "b"), (1, "c"), (1, "c"), (2, "d"), (4, None), (9, "z")], "scene_id int, tag string")
    run = lambda mode: {r.scene_id: r.tags for r in library.change_tags(scenes, changes, mode).collect()}
    assert run("add") == {1: ["a", "b", "c"], 2: ["d"], 3: None, 4: ["a"]}
    assert run("set") == {1: ["b", "c"], 2: ["d"], 3: None, 4: ["a"]}
    assert run("remove") == {1: ["a"], 2: [], 3: None, 4: ["a"]}


def test_urls_and_newest(spark):
    rows = spark.createDataFrame([(1, 2.5), (2, None), (3, 100.0)], "id int, start double")
    urls = lambda key: [r.u for r in rows.orderBy("id").select(library.stream_url("http://h/", F.col("id"), F.col("start"), key).alias("u")).collect()]
    assert urls(None) == ["http://h/scene/1/stream?start=2.5", "http://h/scene/2/stream", "http://h/scene/3/stream?start=100"]
    assert urls("k")[:2] == ["http://h/scene/1/stream?start=2.5&apikey=k", "http://h/scene/2/stream?apikey=k"]
    store = spark.createDataFrame([("a", 1, "p", 1, 3.0), ("b", 1, "p", 1, None), ("c", 1, "p", 1, 9.0), ("d", 1, "p", 0, 10.0), ("e", 1, "q", 1, 10.0), ("f", 1, None, 1, 1.0)], "key string, time_cs long, profile string, label int, ts double")
    assert [r.key for r in labels.newest(store, "p").collect()] == ["c", "a", "b"]
    assert {r.key for r in labels.reset(store, "p").collect()} == {"e", "f"}


def test_bytes(spark):
    image = b"\xff\xd8ab\xff\x00\xff\xd9"
    data = [b"", None, b"abcdefg", b"x" + image + b"yy" + image + b"\xff\xd8tail"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "id int, x binary")
    got = {r.id: r for r in rows.select("id", binary.fixed_chunks(F.col("x"), 3).alias("c"), binary.split_images(F.col("x")).alias("i"), binary.hashed_embedding(F.col("x"), 8).alias("v")).collect()}
    assert [bytes(c) for c in got[2].c] == [b"abc", b"def"] and got[0].c == [] and got[1].c == []
    assert [bytes(i) for i in got[3].i] == [image, image] and got[1].i == []
    for i, x in enumerate(data):
        assert np.allclose(got[i].v, binary.hashed_vector(x or b"", 8)) and np.isclose(np.linalg.norm(got[i].v), 1)
    assert got[0].v == got[1].v and got[2].v != got[3].v


@pytest.mark.parametrize("little", [False, True])
def test_framed_messages(spark, little):
    texts = ["", None, '{"a":1}', "ä" * 300]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    frames = {r.id: bytes(r.f) for r in rows.select("id", binary.frame_message(F.col("t"), little).alias("f")).collect()}
    order = "little" if little else "big"
    for i, t in enumerate(texts):
        body = (t or "").encode()
        assert frames[i] == len(body).to_bytes(4, order) + body
    whole = b"".join(frames[i] for i in range(4))
    for cut, want in ((len(whole), [None, None, texts[2], texts[3]]), (len(whole) - 1, [None, None, texts[2]]), (3, [])):
        one = spark.createDataFrame([(whole[:cut],)], "b binary").select(binary.unframe_messages(F.col("b"), little).alias("m"))
        assert one.first().m == want


def test_stored_format(spark):
    rows = [("mkx200 tb", False, "a 180 sbs"), ("mkx200 tb", True, "a 180 sbs"), ("junk", None, "a 180 sbs"), (None, None, "a")]
    df = spark.createDataFrame(rows, "stored string, flat boolean, name string")
    f = names.effective_format(F.col("stored"), F.col("flat"), F.col("name"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    got = [(r.f.projection, r.f.layout, r.f.fov, r.f.source) for r in df.select(f.alias("f")).collect()]
    assert got == [("fisheye", "tb", 200.0, "filename"), ("unknown", "mono", None, "override:flat"), ("equirect", "sbs", 180.0, "filename"), ("unknown", "unknown", None, "none")]


def test_changes_of_scenes_and_full_records(spark):
    scenes = spark.createDataFrame([(1, "a", 3, True), (2, None, None, None)], "scene_id int, title string, rating int, organized boolean")
    changes = spark.createDataFrame([(1, None, 5), (2, "b", None), (9, "c", 1)], "scene_id int, title string, rating int")
    assert sorted(tuple(r) for r in library.update_scenes(scenes, changes).collect()) == [(1, "a", 5, True), (2, "b", None, None)]
    with pytest.raises(ValueError):
        library.update_scenes(scenes, changes.withColumnRenamed("rating", "path"))
    full = spark.createDataFrame(
        [(1, "t", None, [(7, None)], [("/x.mp4", 1920)], "2024-01-01", None, ["x"]), (2, None, "s", None, None, None, 4, None)],
        "scene_id int, title string, studio string, people array<struct<id:int,name:string>>, files array<struct<path:string,width:int>>, date string, count long, tags array<string>",
    )
    got = {r.scene_id: r for r in library.scene_details(full, full).collect()}
    assert (got[1].date, got[1]["count"], got[1].tags, got[1].path, got[1].width, got[1].height, got[1].organized) == ("2024-01-01", 0, ["x"], "/x.mp4", 1920, None, False)
    assert [tuple(p) for p in got[1].people_detail] == [("7", "")] and (got[2].date, got[2]["count"], got[2].people_detail, got[2].path, got[2].rating) == ("", 4, [], None, None)
    assert library.scene_count(full.union(full)).first().scenes == 2
