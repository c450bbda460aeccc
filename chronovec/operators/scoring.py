"""Scores of frames against reference vectors, and operators on score series.

Frames: key, frame_idx, time, vec. Series: key, idx, time, score. Everything a
series needs is partitioned by key once; windows in key order reuse that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronovec.functions.vectors import EPS, norm
from chronovec.sources.shared import written

from . import slices
from .scorers import arrow_scorer

#: Reference vectors that are broadcast at most.
BLOCK = 4096
#: References of a slice of their index.
REFERENCES_OF_SLICE = 512
#: Rows of a matrix product that are held at once.
STEP = 1024


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + EPS)


def _reduced(rows: np.ndarray, refs: np.ndarray, reduce: str) -> np.ndarray:
    """The largest or summed product of each row with all refs; few rows at a time, as a product holds len(refs) numbers a row."""
    parts = (rows[at : at + STEP] @ refs.T for at in range(0, len(rows), STEP))
    return np.concatenate([x.max(1) if reduce == "max" else x.sum(1) for x in parts])


def _mean_vector(refs: DataFrame, vec: str) -> np.ndarray:
    """The mean of the unit vectors of refs(vec); sums of tasks are added by place."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _unit_rows(np.stack([np.asarray(v, float) for v in batch.column("vec").to_pandas()])).sum(0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    sums = refs.select(F.col(vec).cast("array<double>").alias("vec")).mapInArrow(run, "sums array<double>")
    # a row for each number of a vector
    return np.array([r["x"] for r in sums.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])


def _by_index(frames: DataFrame, refs: DataFrame, vec: str, into: str) -> DataFrame:
    """The largest cosine through an index of the references: a frame meets the slices of references that can still win."""
    from .index import VectorIndex

    number = F.monotonically_increasing_id()
    held = written(frames.withColumn("_row", number), "frames")
    known = refs.select(F.lit("r").alias("key"), number.alias("frame_idx"), F.lit(0.0).alias("time"), F.col(vec).cast("array<double>").alias("vec"))
    asked = held.select(F.lit("f").alias("key"), F.col("_row").alias("frame_idx"), F.col(vec).cast("array<double>").alias("vec"))
    index = VectorIndex(written(known, "references"), normalize=True, rows_of_slice=REFERENCES_OF_SLICE)
    best = index.search(asked, 1, None, False).hits.select(F.col("query_idx").alias("_row"), F.col("score").alias("_best"))
    size = norm(F.col(vec).cast("array<double>"))
    # queries are of length 1 there, frames of length n / (n + EPS) here
    return held.join(best, "_row", "left").withColumn(into, F.col("_best") * size / (size + EPS)).drop("_row", "_best")


def similarity_scores(frames: DataFrame, refs: DataFrame, reduce: str = "max", vec: str = "vec", into: str = "score") -> DataFrame:
    """frames with the largest or mean cosine with refs(vec), as matrix products in Arrow batches.

    Up to BLOCK references are broadcast as one matrix. Of more, the largest cosine is
    found through a clustered index of the references, to nine places; a mean cosine is the
    one with the mean of the unit references, however many these are. No pair becomes
    a row. A null vector has a null score; null references count for none.
    """
    if reduce not in ("max", "mean"):
        raise ValueError(f"unknown reduction {reduce}")
    refs = refs.where(F.col(vec).isNotNull())
    total = refs.count()
    if not total:
        raise ValueError("no reference vectors")
    if total > BLOCK and reduce == "max":
        return _by_index(frames, refs, vec, into)
    if total > BLOCK:
        mean = frames.sparkSession.sparkContext.broadcast(_mean_vector(refs, vec) / total)
        return arrow_scorer(lambda x: _unit_rows(x) @ mean.value)(frames, vec, into)
    own = refs.select(vec).toPandas()[vec]  # at most BLOCK vectors
    held = frames.sparkSession.sparkContext.broadcast(_unit_rows(np.stack(own.to_numpy()).astype(float)))
    out = arrow_scorer(lambda x: _reduced(_unit_rows(x), held.value, reduce))(frames, vec, into)
    return out if reduce == "max" else out.withColumn(into, F.col(into) / total)


def standardize(series: DataFrame, mode: str = "none", eps: float = 1e-8) -> DataFrame:
    """none, or scene-z: population z-score within each key, zeros where the spread is nil."""
    if mode == "none":
        return series
    if mode != "scene-z":
        raise ValueError(f"unknown normalization {mode}")
    of_key = series.groupBy(F.col("key").alias("of_key")).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    z = F.when(F.col("std") < eps, 0.0).otherwise((F.col("score") - F.col("mean")) / F.col("std"))
    return series.join(of_key, F.col("key").eqNullSafe(F.col("of_key"))).withColumn("score", z).drop("of_key", "mean", "std")


def smooth(series: DataFrame, window: int, size: int | None = None) -> DataFrame:
    """Centered moving average over reflected edges; the window is cut to the series' length.

    Mirrored edge rows are added, averaged over rows [-p, w - 1 - p], then dropped. In a series shorter than the
    window, the rows around each, fewer than two windows, are cut to the shorter one. Series are cut into slices of
    `size` rows; rows within a window of a slice's edge go to the slice beside it, too.
    """
    if window <= 1:
        return series
    size = max(size or slices.SLICE, window)
    lengths = series.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n"))
    n = F.col("n")
    own = series.join(lengths, F.col("key").eqNullSafe(F.col("of"))).drop("of").withColumn("w", F.least(F.lit(window), n))
    p = F.floor(F.col("w") / 2)
    front = F.when((F.col("idx") >= 1) & (F.col("idx") <= p), -F.col("idx"))
    back = F.when((F.col("idx") >= n - 1 - p) & (F.col("idx") < n - 1), 2 * (n - 1) - F.col("idx"))
    rows = own.withColumn("at", F.explode(F.array_compact(F.array(F.col("idx").cast("long"), front.cast("long"), back.cast("long")))))
    ahead = window // 2
    slice_of = lambda at: F.floor(at / size)
    rows = rows.withColumn("slice", F.explode(F.sequence(slice_of(F.col("at") - (window - 1 - ahead)), slice_of(F.col("at") + ahead))))
    order = Window.partitionBy("key", "slice").orderBy("at")
    around = order.rowsBetween(-ahead, window - 1 - ahead)
    short = F.col("w") < window
    near = F.collect_list(F.when(short, F.struct("score"))).over(around)
    first = F.least(F.lit(ahead), F.col("at") + p) - p + 1
    cut = F.slice(near, first.cast("int"), F.col("w").cast("int"))
    mean = F.when(short, F.aggregate(cut, F.lit(0.0), lambda a, x: a + x["score"]) / F.col("w")).otherwise(F.avg("score").over(around))
    kept = rows.withColumn("smoothed", mean).where((F.col("at") == F.col("idx")) & (F.col("slice") == slice_of(F.col("at"))))
    return kept.withColumn("score", F.col("smoothed")).drop("n", "w", "at", "slice", "smoothed")
