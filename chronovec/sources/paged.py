"""A library that gives its scenes in pages, as a batch source: each page is a partition of its own.

The driver asks for the number of scenes only; executors fetch the pages. A filter on the beginning of the path is pushed
into the source, so that other scenes are dropped before they become rows. Pages come from a folder here, written by
`write_pages`; a client of a server overrides `fetch`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from chronovec.functions.names import under_path
from chronovec.sources.shared import written

SCENES = "scene_id string, title string, path string, duration double, details string"


@dataclass
class Page(InputPartition):
    number: int


class PagedReader(DataSourceReader):
    def __init__(self, source: "PagedLibrary"):
        self.source, self.prefix = source, ""

    def pushFilters(self, filters):
        """Takes beginnings and values of the path; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, StringStartsWith | EqualTo) and f.attribute == ("path",) and isinstance(f.value, str):
                self.prefix = max(self.prefix, f.value, key=len)
            yield f  # rows are compared again, as an equal path is more than a beginning

    def partitions(self):
        count, size = self.source.size()
        return [Page(n) for n in range(1, -(-count // size) + 1)] or [Page(0)]  # no page at all is one without scenes

    def read(self, partition):
        # fixed values: names of a page's fields, and what stands for a missing one
        for scene in self.source.fetch(partition.number)["scenes"] if partition.number else []:
            first = (scene.get("files") or [{}])[0]
            path = first.get("path") or ""
            if path.startswith(self.prefix):
                duration = first.get("duration")
                yield str(scene["id"]), scene.get("title") or "", path, None if duration is None else float(duration), json.dumps(scene)


class PagedLibrary(DataSource):
    """Option `path`: a folder of pages."""

    @classmethod
    def name(cls) -> str:
        return "paged_library"

    def schema(self) -> str:
        return SCENES

    def reader(self, schema) -> PagedReader:
        return PagedReader(self)

    def _lines(self, folder: str) -> list[str]:
        from pyarrow import fs

        at = f"{self.options['path'].rstrip('/')}/{folder}"
        system, base = fs.FileSystem.from_uri(at) if "://" in at or at.startswith("file:/") else (fs.LocalFileSystem(), at)
        files = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.is_file and not f.base_name.startswith(("_", "."))]
        lines: list[str] = []
        for file in files:
            with system.open_input_stream(file) as stream:
                lines += stream.read().decode().splitlines()
        return lines

    def size(self) -> tuple[int, int]:
        """Number of scenes, and of scenes a page."""
        known = json.loads(self._lines("count")[0])
        return known["count"], known["per_page"]

    def fetch(self, page: int) -> dict:
        """A page: its scenes in order of id."""
        return {"scenes": [json.loads(x) for x in self._lines(f"pages/page={page}")]}


def write_pages(scenes: DataFrame, path: str, per_page: int = 1000, parts: int | None = None) -> None:
    """Pages of scenes(id, title, files) in order of id; ids are numbered in ranges, so that no task orders them all."""
    ranges = scenes.repartitionByRange(parts, "id") if parts else scenes.repartitionByRange("id")
    held = written(ranges.withColumn("part", F.spark_partition_id()), "scenes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = held.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    page = F.floor((F.col("offset") + nth) / per_page) + 1
    rows = held.join(F.broadcast(offsets), "part").withColumn("page", page).select("page", "id", F.to_json(F.struct("id", "title", "files")).alias("value"))
    # a page is in one file, in order
    rows = rows.repartition("page").sortWithinPartitions("page", "id").select("page", "value")
    rows.write.mode("overwrite").partitionBy("page").text(f"{path}/pages")
    counted = held.agg(F.to_json(F.struct(F.count("*").alias("count"), F.lit(per_page).alias("per_page"))).alias("value"))
    counted.coalesce(1).write.mode("overwrite").text(f"{path}/count")


def read_pages(spark: SparkSession, path: str, prefix: str = "", source: type[DataSource] = PagedLibrary) -> DataFrame:
    """Scenes of a paged library whose file lies under a folder; all without one."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # asked for when the read is planned
    rows, base = spark.read.format(source.name()).option("path", path).load(), prefix.rstrip("/")
    return rows.where(F.col("path").startswith(base) & under_path(F.col("path"), base)) if base else rows
