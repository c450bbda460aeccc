"""Ranked moments and the schedule that plays them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

RELOAD_PAD = 0.5


def ranked(moments: DataFrame, limit: int = 50) -> DataFrame:
    """The best moments with their rank; scores are compared after rounding to four places."""
    best = moments.withColumn("score", F.round("peak", 4)).orderBy(F.desc("score"), "key", "start").limit(limit)
    # at most `limit` rows are ranked
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key", "start")))


def schedule(playlist: DataFrame, min_clip: float = 2.0, by: str = "playlist") -> DataFrame:
    """action, hold and at of each moment(rank, path, start, end): seek within a file, load another."""
    order = Window.partitionBy(by).orderBy("rank")
    before = F.lag("path").over(order)
    same = F.coalesce((F.col("path") == before) & (F.col("path") != ""), F.lit(False))
    changed = F.row_number().over(order) == 1
    hold = F.greatest(F.col("end") - F.col("start"), F.lit(min_clip)) + F.when(changed | ~F.col("path").eqNullSafe(before), RELOAD_PAD).otherwise(0.0)
    rows = playlist.withColumn("action", F.when(same, "seek").otherwise("load")).withColumn("hold", hold)
    return rows.withColumn("at", F.coalesce(F.sum("hold").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def total_duration(playlist: DataFrame, by: str = "playlist") -> DataFrame:
    return playlist.groupBy(by).agg(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).alias("duration"))
