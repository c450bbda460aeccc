"""A clustered index of vectors: exact search that reads only the slices of frames that can still win.

Frames are dealt to the nearest of some centers, and those of a center, in order of their distance to it, are cut into
slices. By the triangle inequality a query's distance to a center and the least and largest distance in a slice bound the
dot product with any frame of the slice. A search visits the slices of the highest bounds first; what it finds there is a
score that the last of the best can't fall below, and of the other slices only those whose bound reaches it are read.
Neighbouring slices stand on a shelf. A query travels to each shelf that holds slices for it, with their numbers, once and not for each
slice, so that many small slices cost no more rows than few large ones; it gives the shelf's best rows only, and those that its bound admits.

Centers are fitted on at most SAMPLE frames. Any centers give the same rows; good ones leave more slices unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronovec.functions.vectors import l2_normalize, unit
from chronovec.sources.shared import written

from .search import FRAMES_AT_ONCE, QUERIES_AT_ONCE, best_of, meeting

#: Frames that the centers are fitted on, centers at most, frames of a slice, and slices at most: larger tables have larger slices.
SAMPLE, CENTERS, FRAMES_OF_SLICE, SLICES = 50_000, 1024, 4096, 1 << 16
#: Bounds of queries with slices that are held at once.
BOUNDS_AT_ONCE = 1 << 20
#: Added to bounds, as scores are compared after rounding.
SLACK = 2e-9


@dataclass
class Found:
    """hits as of search_each; slices read at least once of all; meetings of a query and a slice of all possible ones."""

    hits: DataFrame
    slices_read: int
    slices: int
    meetings: int
    possible: int

    @property
    def share(self) -> float:
        return self.meetings / self.possible if self.possible else 0.0


def _nearest(centers: np.ndarray):
    """(cluster, distance, length) of the vectors of a batch."""

    def run(batches):
        for batch in batches:
            rows = [np.asarray(v, float) for v in batch.column("vec").to_pandas()]
            x = np.stack(rows) if rows else np.zeros((0, centers.shape[1]))
            square = (x * x).sum(1)
            away = square[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(1)
            cluster = away.argmin(1).astype(np.int32)
            distance = np.sqrt(((x - centers[cluster]) ** 2).sum(1))
            columns = [pa.array(cluster), pa.array(distance), pa.array(np.sqrt(square))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "cluster", "distance", "length"])

    return run


class VectorIndex:
    """An index of frames(key, frame_idx, time, vec); null vectors are left out. normalize: search by cosine."""

    def __init__(self, frames: DataFrame, normalize: bool = False, centers: int | None = None, rows_of_slice: int | None = None, sample: int = SAMPLE, seed: int = 0):
        vec = F.col("vec").cast("array<double>")
        held = written(frames.where(F.col("vec").isNotNull()).select("key", "frame_idx", "time", (l2_normalize(vec) if normalize else vec).alias("vec")), "indexed")
        self.normalize, total = normalize, held.count()
        self.total, self.rows_of_slice = total, rows_of_slice or max(FRAMES_OF_SLICE, -(-total // SLICES))
        self.slices_of_shelf = max(1, FRAMES_AT_ONCE // self.rows_of_slice)
        self.centers = self._fit(held, centers or min(CENTERS, max(1, int(total**0.5) // 4)), total, sample, seed)
        dealt = held.mapInArrow(_nearest(self.centers), held.selectExpr("*", "0 AS cluster", "0D AS distance", "0D AS length").schema)
        ranges = dealt.repartitionByRange(max(1, -(-total // (16 * self.rows_of_slice))), "cluster", "distance").withColumn("part", F.spark_partition_id())
        ranges = written(ranges, "ranges")
        nth = F.row_number().over(Window.partitionBy("part", "cluster").orderBy("distance", "key", "frame_idx")) - 1
        place = F.concat_ws("-", "cluster", "part", F.floor(nth / self.rows_of_slice).cast("string"))
        rows = written(ranges.withColumn("place", place).drop("part"), "placed")
        spans = rows.groupBy("cluster", "place").agg(
            F.min("distance").alias("nearest"), F.max("distance").alias("farthest"), F.max("length").alias("longest"), F.count("*").alias("frames")
        )
        # SLICES rows and one for each center and range at most
        self.spans = spans.orderBy("cluster", "nearest", "place").toPandas()
        self.spans["slice"] = np.arange(len(self.spans), dtype=np.int32)
        numbers = frames.sparkSession.createDataFrame(self.spans[["place", "slice"]], "place string, slice int")
        numbered = rows.join(F.broadcast(numbers), "place").select("key", "frame_idx", "time", "vec", "slice")
        self.frames = written(numbered.repartitionByRange("slice").sortWithinPartitions("slice", "key", "frame_idx"), "vector-index")

    def _fit(self, held: DataFrame, centers: int, total: int, sample: int, seed: int) -> np.ndarray:
        if not total:
            return np.zeros((1, 1))
        share = F.shiftrightunsigned(F.xxhash64("key", "frame_idx", F.lit(seed)), 11).cast("double") / float(1 << 53)
        drawn = held.where(share < (1.2 * sample + 100) / total).orderBy(share, "key", "frame_idx").limit(sample)
        drawn = written(drawn.select(array_to_vector("vec").alias("features")), "sample")
        model = KMeans(k=centers, seed=seed, maxIter=10).fit(drawn) if centers > 1 else None
        return np.array(model.clusterCenters()) if model else np.array([drawn.first()["features"].toArray()])

    def _bounds(self):
        """Upper bounds of the dot products of queries with any frame of each slice."""
        centers, spans = self.centers, self.spans
        cluster, nearest, farthest, longest = (spans[c].to_numpy() for c in ("cluster", "nearest", "farthest", "longest"))

        def bound(x: np.ndarray) -> np.ndarray:
            size = np.sqrt((x * x).sum(1))[:, None]
            dot = x @ centers.T
            away = np.sqrt(np.maximum(size * size - 2 * dot + (centers * centers).sum(1), 0))[:, cluster]
            gap = np.maximum(np.maximum(away - farthest, nearest - away), 0)
            by_distance = (size * size + longest**2 - gap * gap) / 2
            return np.minimum(np.minimum(dot[:, cluster] + size * farthest, size * longest), by_distance) + SLACK

        return bound

    def _visits(self, asked: DataFrame, first: int, again: bool) -> DataFrame:
        """(_query, shelf, slices): the `first` slices of the highest bounds, or the others whose bound reaches the query's `least`."""
        bound, total, per_shelf = self._bounds(), len(self.spans), self.slices_of_shelf
        step = max(1, min(256, BOUNDS_AT_ONCE // max(1, total)))

        def run(batches):
            for batch in batches if total else []:
                queries = [np.asarray(v, float) for v in batch.column("query").to_pandas()]
                least = batch.column("least").to_numpy(zero_copy_only=False) if again else None
                numbers = batch.column("_query").to_numpy()
                for at in range(0, len(queries), step):
                    high = bound(np.stack(queries[at : at + step]))
                    if high.shape[1] > first:
                        top = np.argpartition(-high, first - 1, axis=1)[:, :first]
                    else:
                        top = np.tile(np.arange(high.shape[1]), (len(high), 1))
                    chosen = np.zeros(high.shape, bool)
                    np.put_along_axis(chosen, top, True, axis=1)
                    if again:
                        chosen = ~chosen & (high >= least[at : at + step, None])
                    row, column = np.nonzero(chosen)
                    shelf = (column // per_shelf).astype(np.int32)
                    starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(shelf, prepend=-1) != 0))
                    slices = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(column, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[at : at + step][row[starts]]), pa.array(shelf[starts]), slices], ["_query", "shelf", "slices"])

        return asked.mapInArrow(run, "_query long, shelf int, slices array<int>")

    def _read(self, visits: DataFrame) -> DataFrame:
        """(slice) that any query visits; a task gives each slice once at most."""
        total = len(self.spans)

        def run(batches):
            seen = np.zeros(total, bool)
            for batch in batches:
                seen[batch.column("slices").flatten().to_numpy()] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], ["slice"])

        return visits.select("slices").mapInArrow(run, "slice int").distinct()

    def _hits(self, visits: DataFrame, asked: DataFrame, frames: DataFrame, top_k: int, per_scene: int | None, exclude_own: bool) -> DataFrame:
        """The best of each query on each shelf; frames of slices that some query visits are given once for each block of their shelf's queries."""
        # a row for each shelf at most, and for each slice
        sizes = F.broadcast(visits.groupBy("shelf").agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).cast("int").alias("blocks")))
        read = F.broadcast(self._read(visits))
        shelf = F.floor(F.col("slice") / self.slices_of_shelf).cast("int")
        left = frames.join(read, "slice", "left_semi").withColumn("shelf", shelf).join(sizes, "shelf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = visits.join(sizes, "shelf").withColumn("block", F.pmod(F.xxhash64("_query"), F.col("blocks")).cast("int")).drop("blocks")
        return meeting(left, right.join(asked.drop("query_idx"), "_query"), ["shelf", "block"], top_k, per_scene, exclude_own)

    def search(self, queries: DataFrame, top_k: int = 60, per_scene: int | None = 3, exclude_own: bool = True, exclude: DataFrame | None = None, first: int = 2) -> Found:
        """The best of the index for each of queries(key, frame_idx, vec), the same rows as search_each gives.

        exclude(key, time_cs): frames that no query may find. first: slices that a query visits before it has a bound.
        """
        number = F.monotonically_increasing_id()
        vec = F.col("vec").cast("array<double>")
        asked = queries.where(F.col("vec").isNotNull()).select(F.col("key").alias("query_key"), F.col("frame_idx").alias("query_idx"), unit(vec).alias("query"))
        asked = written(asked.withColumn("_query", number), "queries")
        frames = self.frames
        if exclude is not None:
            ids = exclude.select("key", "time_cs").distinct()
            frames = frames.withColumn("time_cs", F.rint(F.col("time") * 100).cast("long")).join(ids, ["key", "time_cs"], "left_anti").drop("time_cs")
        frames = frames.select("key", "frame_idx", "time", "vec", "slice")

        opened = written(self._visits(asked, first, False), "visits")
        hits = written(self._hits(opened, asked, frames, top_k, per_scene, exclude_own), "hits")
        ranked = best_of(hits, top_k, per_scene)
        # below this score no row of a query can come among its best
        least = ranked.where(F.col("rank") == top_k).select(F.col("_query").alias("of"), F.col("score").alias("least"))
        bounded = written(asked.join(least, F.col("_query") == F.col("of"), "left").drop("of").fillna(float("-inf"), subset=["least"]), "bounded")
        more = written(self._visits(bounded, first, True), "visits")
        hits = hits.unionByName(written(self._hits(more, bounded, frames, top_k, per_scene, exclude_own), "hits"))
        found = best_of(hits, top_k, per_scene).join(asked.drop("query"), "_query")
        visits = opened.unionByName(more)
        meetings = visits.agg(F.coalesce(F.sum(F.size("slices")), F.lit(0))).first()[0]
        columns = ["query_key", "query_idx", "rank", "key", "frame_idx", "time", "score"]
        return Found(found.select(columns), self._read(visits).count(), len(self.spans), meetings, len(self.spans) * asked.count())

    def similar(self, key: str, time: float, labeled: DataFrame, count: int = 60, per_scene: int = 3) -> DataFrame:
        """Frames like the one at (key, time), without labeled(key, time_cs) frames and the requested time itself."""
        anchor = self.frames.where(F.col("key") == key).orderBy(F.abs(F.col("time") - time), "frame_idx").limit(1)
        own = self.frames.sparkSession.createDataFrame([(key, round(time * 100))], "key string, time_cs long")
        found = self.search(anchor, count, per_scene, False, labeled.select("key", "time_cs").unionByName(own))
        return found.hits.drop("query_key", "query_idx", "rank")
