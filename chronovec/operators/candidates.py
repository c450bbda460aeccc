"""Frames to label next: best and random frames of each scene, sampling grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronovec.sources.shared import written

from .scorers import Scorer
from .slices import Slices

WARM = 12
#: Decimal places to which scores are compared where a budget is cut.
PLACES = 6


def plan_grid(duration: Column, interval: float, offset: float = 0.0) -> Column:
    """Times offset + k * interval below duration, to milliseconds; empty where either isn't positive."""
    n = F.ceil((duration - offset) / interval).cast("int")
    grid = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.round(k * interval + offset, 3))
    return F.when((duration > 0) & (F.lit(interval) > 0) & (n > 0), grid).otherwise(F.array().cast("array<double>"))


def increasing(rows: DataFrame, by: str = "key", order: str = "frame_idx", pts: str = "pts", size: int | None = None) -> DataFrame:
    """Rows whose time exceeds all times before it; null times stay. Series of more than `size` rows are cut into slices."""
    own = Slices(rows, by, [order], size)
    own.carry("reach_in", F.max(pts), F.max)
    before = F.greatest(F.max(pts).over(own.along(preceding=True)), "reach_in")
    found = own.rows.withColumn("before", before)
    return found.where(F.col(pts).isNull() | F.col("before").isNull() | (F.col(pts) > F.col("before"))).select(rows.columns)


def draw(seed: int) -> Column:
    """A portable pseudo-random order of (key, frame_idx)."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("key"), F.col("frame_idx").cast("string")))


def gather(
    scored: DataFrame, labeled: DataFrame, top: int = 3, chance: int = 1, seed: int = 0, limit: int | None = None, scorer: Scorer | None = None
) -> DataFrame:
    """key, frame_idx, time, score, pool: the best frames of each scene and some drawn from the others.

    With a scorer, the rows are frames(key, frame_idx, time, vec) yet to be scored. Labeled frames use up places among the best, and are then left out. Over the
    limit, the drawn ones keep their share of the budget, and the best are compared after rounding to PLACES, equal ones by key and frame_idx:
    the last bits of a cosine are noise. The result comes in an order drawn from the seed.
    """
    if scorer is not None:
        scored = scorer(scored, "vec", "score")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "frame_idx")
    ids = labeled.select("key", "time_cs").distinct().withColumn("known", F.lit(True))
    rows = scored.withColumn("time_cs", F.rint(F.col("time") * 100).cast("long")).join(ids, ["key", "time_cs"], "left")
    rows = rows.withColumn("rank", F.row_number().over(best)).where("known IS NULL")
    tops = rows.where(F.col("rank") <= top).withColumn("pool", F.lit("top"))
    others = rows.where(F.col("rank") > top).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(draw(seed))))
    drawn = others.where(F.col("nth") <= chance).withColumn("pool", F.lit("random")).drop("nth")
    if limit:
        # written once, as they are counted first
        both = written(tops.unionByName(drawn), "candidates")
        tops, drawn = (both.where(F.col("pool") == pool) for pool in ("top", "random"))
        n_top, n_drawn = tops.count(), drawn.count()
        if n_top + n_drawn > limit:
            # fixed value: how a budget is shared
            keep = min(n_drawn, max(1, round(limit * chance / max(1, top + chance))))
            tops = tops.orderBy(F.desc(F.round("score", PLACES)), "key", "frame_idx").limit(limit - keep)
            drawn = drawn.orderBy(draw(seed)).limit(keep)
    return tops.unionByName(drawn).select("key", "frame_idx", "time", "score", "pool").orderBy(draw(seed + 1))


def suggest(scored: DataFrame, labeled: DataFrame, likes: int, count: int = 60, seed: int = 0) -> DataFrame:
    """Two of the best and a drawn frame of each scene once likes are enough, else three drawn frames."""
    if likes >= WARM:
        return gather(scored, labeled, 2, 1, seed, count)
    return gather(scored.withColumn("score", F.lit(0.0)), labeled, 0, 3, seed, count)
