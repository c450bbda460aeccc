"""A library in pages as a data source."""

import json

import pytest
from pyspark.sql import functions as F

from chronovec.sources import paged


def library(spark, n):
    file = F.struct(F.concat(F.lit("/lib/"), F.when(F.col("id") % 3 == 0, "a").otherwise("ab"), F.lit("/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("double").alias("duration"))
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), "id")).alias("title"), F.when(F.col("id") != 4, F.array(file)).alias("files"))


@pytest.mark.parametrize("n,per_page,parts", [(25, 10, 3), (20, 10, None), (1, 10, None), (0, 10, None), (30, 1, 4)])
def test_every_scene_is_on_its_page(spark, tmp_path, n, per_page, parts):
    at = str(tmp_path / "library")
    paged.write_pages(library(spark, n), at, per_page, parts)
    rows = paged.read_pages(spark, at)
    assert rows.rdd.getNumPartitions() == max(1, -(-n // per_page))
    got = rows.orderBy(F.col("scene_id").cast("int")).collect()
    assert [r.scene_id for r in got] == [str(i) for i in range(n)]
    assert all(r.title == ("" if i % 2 else f"t{i}") and r.path == ("" if i == 4 else f"/lib/{'a' if i % 3 == 0 else 'ab'}/{i}") for i, r in enumerate(got))
    assert all(json.loads(r.details)["id"] == i and r.duration == (None if i == 4 else i) for i, r in enumerate(got))
    if n:
        page = paged.PagedLibrary({"path": at}).fetch(1)["scenes"]
        assert [s["id"] for s in page] == list(range(min(n, per_page)))


def test_a_folder_is_asked_of_the_source(spark, tmp_path, capfd):
    at = str(tmp_path / "library")
    paged.write_pages(library(spark, 40), at, 7)
    for prefix in ("/lib/a", "/lib/a/"):
        assert {int(r.scene_id) for r in paged.read_pages(spark, at, prefix).collect()} == {i for i in range(40) if i % 3 == 0}
    assert [r.scene_id for r in paged.read_pages(spark, at, "/lib/ab/5").collect()] == ["5"]
    assert paged.read_pages(spark, at, "/other").count() == 0
    paged.read_pages(spark, at, "/lib/a").explain("formatted")
    reader = paged.PagedReader(paged.PagedLibrary({"path": at}))
    kept = list(reader.pushFilters([paged.StringStartsWith(("path",), "/lib/a/"), paged.EqualTo(("title",), "t3")]))
    assert reader.prefix == "/lib/a/" and len(kept) == 2
    assert {int(r[0]) for r in reader.read(paged.Page(1))} == {0, 3, 6}


def test_a_client_gives_its_own_pages(spark):
    class Numbers(paged.PagedLibrary):
        @classmethod
        def name(cls):
            return "numbers"

        def size(self):
            return 5, 2

        def fetch(self, page):
            return {"scenes": [{"id": i} for i in range((page - 1) * 2, min(page * 2, 5))]}

    rows = paged.read_pages(spark, "unused", source=Numbers)
    assert sorted(r.scene_id for r in rows.collect()) == list("01234") and rows.rdd.getNumPartitions() == 3
