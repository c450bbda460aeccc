"""Top-k similarity search with caps for each scene."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from chronovec.functions.vectors import dot, unit
from chronovec.sources.shared import written

from .scoring import similarity_scores

#: Queries of a block, and frames, on average, of a slice that meets it.
QUERIES_AT_ONCE, FRAMES_AT_ONCE = 1024, 16384
#: Queries whose products with all frames of a meeting are held at once.
PRODUCTS_AT_ONCE = 64


def capped(rows: DataFrame, by: str | list[str], cap: int | None, order: list[Column]) -> DataFrame:
    """The first `cap` rows of each group in order; null groups share one cap."""
    if not cap:
        return rows
    return rows.withColumn("rank_in", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank_in") <= cap).drop("rank_in")


def search(
    frames: DataFrame, query: list[float], top_k: int | None = 60, per_scene: int | None = None, exclude_key: str | None = None,
    min_score: float | None = None, cap_by: str = "key",
) -> DataFrame:
    """Frames by dot product with the unit query; ranked exactly before caps and limit."""
    q = unit(F.array(*(F.lit(float(x)) for x in query)))
    hits = frames if exclude_key is None else frames.where(F.col("key") != exclude_key)
    hits = hits.withColumn("score", dot(F.col("vec"), q))
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    order = [F.desc("score"), F.col("key"), F.col("frame_idx")]
    hits = capped(hits, cap_by, per_scene, order)
    return hits.orderBy(*order).limit(top_k) if top_k else hits


def vector_at(frames: DataFrame, key: str, time: float) -> DataFrame:
    """The frame of a scene nearest to a time, the earlier one on ties."""
    return frames.where(F.col("key") == key).orderBy(F.abs(F.col("time") - time), "frame_idx").limit(1)


def search_by_frame(frames: DataFrame, key: str, time: float, top_k: int = 60, per_scene: int = 3, **options) -> DataFrame:
    """Search with a frame's vector, its own scene excluded."""
    found = vector_at(frames, key, time).select("vec").first()
    if found is None:
        return frames.withColumn("score", F.lit(0.0)).limit(0)
    return search(frames, list(found["vec"]), top_k, per_scene, exclude_key=key, **options)


def similar_frames(frames: DataFrame, key: str, time: float, labeled: DataFrame, count: int = 60, per_scene: int = 3) -> DataFrame:
    """Frames like the one at (key, time), without labeled(key, time_cs) frames and the requested time itself."""
    scored = similarity_scores(frames, vector_at(frames, key, time).select("vec"))
    at = F.round(F.col("time") * 100).cast("long")
    fresh = scored.withColumn("time_cs", at).join(labeled.select("key", "time_cs").distinct(), ["key", "time_cs"], "left_anti")
    fresh = fresh.where(~((F.col("key") == key) & (F.col("time_cs") == round(time * 100))))
    order = [F.desc("score"), F.col("key"), F.col("frame_idx")]
    return capped(fresh, "key", per_scene, order).orderBy(*order).limit(count)


def _nth(groups: np.ndarray) -> np.ndarray:
    """For each place the number of places before it with the same value."""
    order = np.argsort(groups, kind="stable")
    held = groups[order]
    starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else held
    nth = np.empty(len(groups), np.int64)
    nth[order] = np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))
    return nth


def _best(scores: np.ndarray, scenes: np.ndarray, top_k: int, per_scene: int | None) -> np.ndarray:
    """Places of the top_k scores under the cap; equal scores in order of place.

    Some multiple of top_k is sorted with all that is equal to the last of it, and more only where the cap leaves too few.
    """
    many = max(4 * top_k, 1)
    while True:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - many)[len(scores) - many]) if many < len(scores) else np.arange(len(scores))
        order = near[np.argsort(-scores[near], kind="stable")]
        if per_scene:
            order = order[_nth(scenes[order]) < per_scene]
        if len(order) >= top_k or many >= len(scores):
            return order[:top_k]
        many *= 8


def meeting(left: DataFrame, right: DataFrame, by: list[str], top_k: int, per_scene: int | None, exclude_own: bool) -> DataFrame:
    """_query, key, frame_idx, time, score: the best of left(key, frame_idx, time, vec) for each of right(_query, query_key, query) of its group.

    right(slices): only frames of these slices, named by left(slice). right(least): only scores from there on, where it isn't null.
    """
    schema = StructType([StructField("_query", LongType()), *(left.schema[c] for c in ("key", "frame_idx", "time")), StructField("score", DoubleType())])

    def meet(own: pa.Table, others: pa.Table) -> pa.Table:
        own = own.take(pc.sort_indices(own, [("key", "ascending"), ("frame_idx", "ascending")], null_placement="at_start"))
        scenes, known = pd.factorize(own.column("key").to_pandas())
        scene_of = {k: i for i, k in enumerate(known)}
        vectors = [np.asarray(v) for v in own.column("vec").to_pandas()]
        column = lambda name: others.column(name).to_pylist() if name in others.column_names else None
        numbers, keys, least = others.column("_query").to_pylist(), column("query_key"), column("least")
        wanted = others.column("slices").to_pandas() if "slices" in others.column_names else None
        slices = own.column("slice").to_numpy() if wanted is not None else None
        queries = [np.asarray(q) for q in others.column("query").to_pandas()]
        found, rows, scores = [], [], []
        for at in range(0, len(queries) if vectors else 0, PRODUCTS_AT_ONCE):
            if not at:
                matrix = np.stack(vectors)
            some = range(at, min(at + PRODUCTS_AT_ONCE, len(queries)))
            masks = np.ones((len(some), len(matrix)), bool)
            for mask, i in zip(masks, some):
                if wanted is not None:
                    flags = np.zeros(max(slices.max(), wanted[i].max()) + 1, bool)
                    flags[wanted[i]] = True
                    mask &= flags[slices]
                if exclude_own and keys[i] is not None:
                    mask &= scenes != scene_of.get(keys[i], -2)
            # one product of all where most of it is asked for
            products = np.stack([queries[i] for i in some]) @ matrix.T if masks.mean() > 0.25 else None
            for n, (mask, i) in enumerate(zip(masks, some)):
                places = np.flatnonzero(mask)
                score = np.round(matrix[places] @ queries[i] if products is None else products[n, places], 9) + 0.0  # no -0
                if least is not None and least[i] is not None:
                    places, score = places[score >= least[i]], score[score >= least[i]]
                best = _best(score, scenes[places], top_k, per_scene)
                found.append(np.full(len(best), numbers[i])), rows.append(places[best]), scores.append(score[best])
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        kept = own.select(["key", "frame_idx", "time"]).take(pa.array(at))
        return kept.add_column(0, "_query", pa.array(np.concatenate(found) if found else at, pa.int64())).append_column("score", pa.array(np.concatenate(scores) if scores else at, pa.float64()))

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)


def best_of(hits: DataFrame, top_k: int, per_scene: int | None) -> DataFrame:
    """hits(_query, key, frame_idx, time, score) with their rank, the top_k under the cap for each query."""
    order = [F.desc("score"), F.col("key"), F.col("frame_idx")]
    hits = capped(hits, ["_query", "key"], per_scene, order)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("_query").orderBy(*order))).where(F.col("rank") <= top_k)


def search_each(frames: DataFrame, queries: DataFrame, top_k: int = 60, per_scene: int | None = 3, exclude_own: bool = True) -> DataFrame:
    """query_key, query_idx, rank, key, frame_idx, time, score: the best of frames for each of queries(key, frame_idx, vec).

    Dot products with unit queries, compared after rounding to nine places; equal ones by key and frame_idx. With
    exclude_own a query's own scene is left out. Blocks of queries meet slices of frames in a shuffle as matrix
    products, and each meeting gives its top_k under the cap only. That is exact: before a frame that a slice
    leaves out stand top_k others under the cap there, and no fewer over all slices.
    """
    number = F.monotonically_increasing_id()
    held = written(frames.select("key", "frame_idx", "time", F.col("vec").cast("array<double>").alias("vec")).withColumn("_row", number), "frames")
    asked = written(queries.select(F.col("key").alias("query_key"), F.col("frame_idx").alias("query_idx"), unit(F.col("vec").cast("array<double>")).alias("query")).withColumn("_query", number), "queries")
    slices, blocks = (max(-(-t.count() // size), 1) for t, size in ((held, FRAMES_AT_ONCE), (asked, QUERIES_AT_ONCE)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.withColumn("slice", deal("_row", slices)).drop("_row").withColumn("block", every(blocks))
    right = asked.select("_query", "query_key", "query", deal("_query", blocks).alias("block")).withColumn("slice", every(slices))
    found = best_of(meeting(left, right, ["slice", "block"], top_k, per_scene, exclude_own), top_k, per_scene)
    return found.join(asked.drop("query"), "_query").select("query_key", "query_idx", "rank", "key", "frame_idx", "time", "score")
