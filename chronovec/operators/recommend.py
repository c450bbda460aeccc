"""Moments like those that were liked: likes to vectors, vectors or a model to scores, scores to a ranked list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovec.sources.shared import written

from .joins import nearest
from .playlist import ranked
from .scorers import Scorer, as_scorer
from .segments import score_series


def liked_vectors(likes: DataFrame, frames: DataFrame) -> DataFrame:
    """(key, frame_idx, vec) of the frame nearest to each of likes(key, time); a frame liked twice counts once.

    Likes of all categories go in together; those in scenes without frames drop out.
    """
    found = nearest(likes.select("key", F.col("time").cast("double").alias("time")).distinct(), frames).select("key", "frame_idx").distinct()
    return frames.withColumn("frame_idx", F.col("frame_idx").cast("long")).join(found, ["key", "frame_idx"], "left_semi").select("key", "frame_idx", "vec")


def score_scenes(
    frames: DataFrame, scorer: Scorer | DataFrame, high: float, low: float, reduce: str = "max", normalize: str = "none", window: int = 1, **rules
) -> DataFrame:
    """Segments of frames(key, frame_idx, time, vec): scored, normalized, smoothed, cut.

    The scorer is one of scorers.py, or reference vectors (vec) to be like.
    """
    series = as_scorer(scorer, reduce)(frames, "vec", "score").select("key", F.col("frame_idx").alias("idx"), "time", "score")
    return score_series(series, high, low, normalize, window, **rules)


def recommend(
    frames: DataFrame, likes: DataFrame, high: float, low: float, limit: int = 50, exclude_seeds: bool = True, normalize: str = "none",
    window: int = 1, scorer: Scorer | None = None, **rules,
) -> DataFrame:
    """rank, key, start, end, score, mean of the best moments for likes(key, time); none without a liked frame.

    Frames are scored by similarity to those liked, or by a scorer of their own, which needs no likes. Scenes that hold
    a like are left out, unless exclude_seeds is False. Times are rounded to thousandths.
    """
    if scorer is None:
        # written once, as its rows are asked for, counted and fetched
        scorer = written(liked_vectors(likes, frames), "liked")
    if isinstance(scorer, DataFrame) and not scorer.take(1):
        found = frames.select("key", F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("mean")).limit(0)
    else:
        pool = frames.join(likes.select("key").distinct(), "key", "left_anti") if exclude_seeds else frames
        found = score_scenes(pool, scorer, high, low, normalize=normalize, window=window, **rules)
    best = ranked(found, limit)
    return best.select("rank", "key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "score", "mean")
