"""Time segments of score series: hysteresis, islands, ordered merging, split and pad."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import smooth, standardize
from .slices import Slices, composed, latest


def runs(series: DataFrame, high: float, low: float | None = None, size: int | None = None) -> DataFrame:
    """key, start, end, peak, mean of the stretches that enter at >= high and leave at < low.

    NaN and null scores change nothing, as a comparison with them is false. Series of more than `size` rows are cut into
    slices: what a slice does to the state is its last decision, if there is any.
    """
    low = high if low is None else low
    if low > high:
        raise ValueError("low must not be above high")
    score = F.col("score")
    enters, leaves = ~F.isnan(score) & (score >= high), ~F.isnan(score) & (score < low)
    own = Slices(series.select("key", "idx", "time", "score"), "key", ["time", "idx"], size)
    own.rows = own.rows.withColumn("decided", F.when(enters, 1).when(leaves, 0))
    own.carry("state_in", F.max_by("decided", F.when(F.col("decided").isNotNull(), F.struct("time", "idx"))), latest)
    state = F.coalesce(F.last("decided", ignorenulls=True).over(own.along()), F.col("state_in"), F.lit(0))
    own.rows = own.rows.withColumn("on", state)
    before = F.coalesce(F.lag("on").over(own.along()), F.col("state_in"), F.lit(0))
    own.rows = own.rows.withColumn("fresh", ((F.col("on") == 1) & (before == 0)).cast("int"))
    own.carry("runs_in", F.sum("fresh"), F.sum)
    return (
        own.rows.withColumn("run", F.sum("fresh").over(own.along()) + F.coalesce("runs_in", F.lit(0)))
        .where("on = 1")
        .groupBy("key", "run")
        .agg(F.min("time").alias("start"), F.max("time").alias("end"), F.max("score").alias("peak"), F.avg("score").alias("mean"))
        .drop("run")
    )


def merge(segments: DataFrame, gap: float, size: int | None = None) -> DataFrame:
    """Joins neighbours at most gap apart; the mean is folded in order, weighted by durations so far.

    A segment changes the mean so far by an affine map: its own mean counts by its duration, the mean so far by the time
    since the first start, gaps included. The maps of a slice are composed, and then those of the slices.
    """
    own = Slices(segments.select("key", "start", "end", "peak", "mean"), "key", ["start", "end", "peak", "mean"], size)
    own.carry("reach_in", F.max("end"), F.max)
    own.rows = own.rows.withColumn("before", F.greatest(F.max("end").over(own.along(preceding=True)), "reach_in"))
    own.rows = own.rows.withColumn("apart", F.coalesce(F.col("start") - F.col("before") > gap, F.lit(False)))
    own.rows = own.rows.withColumn("opens", F.col("apart") | F.col("before").isNull())
    own.carry("islands_in", F.sum(F.col("apart").cast("int")), F.sum)
    place = F.struct("start", "end", "peak", "mean")
    own.carry("start_in", F.max_by("start", F.when(F.col("opens"), place)), latest)
    first = F.coalesce(F.last(F.when(F.col("opens"), F.col("start")), ignorenulls=True).over(own.along()), F.col("start_in"))
    left, right = F.col("before") - F.col("first"), F.col("end") - F.col("start")
    share = F.when(F.col("opens"), 0.0).when(left + right > 0, left / (left + right)).otherwise(0.5)
    rows = (
        own.rows.withColumn("island", F.sum(F.col("apart").cast("int")).over(own.along()) + F.coalesce("islands_in", F.lit(0)))
        .withColumn("first", first)
        .withColumn("share", share)
        .withColumn("term", F.when(F.col("opens"), F.col("mean")).otherwise(F.col("mean") * (1 - F.col("share"))))
        .select("part", "key", "island", "start", "end", "peak", "mean", "share", "term")
    )
    rows = rows.withColumns({"at": F.col("start"), "until": F.col("end"), "height": F.col("peak")})
    islands = composed(rows, ["part", "key", "island"], ["at", "until", "height", "mean"], "share", "term")
    if own.cut:
        islands = composed(islands, ["key", "island"], ["part"], "share", "term")
    return islands.select("key", "start", "end", "peak", F.col("term").alias("mean"))


def split(segments: DataFrame, longest: float | None) -> DataFrame:
    """Cuts segments into pieces of at most `longest`, with the statistics of the whole."""
    if not longest:
        return segments
    pieces = F.greatest(F.ceil((F.col("end") - F.col("start")) / longest), F.lit(1)).cast("int")
    return (
        segments.withColumn("i", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .withColumn("from", F.col("start") + F.col("i") * longest)
        .select("key", F.col("from").alias("start"), F.least(F.col("from") + longest, "end").alias("end"), "peak", "mean")
    )


def pad(segments: DataFrame, bounds: DataFrame, by: float) -> DataFrame:
    """Widens segments within bounds(key, lo, hi) and merges those that touch."""
    if not by:
        return segments
    wide = segments.join(bounds, "key").select(
        "key", F.greatest("lo", F.col("start") - by).alias("start"), F.least("hi", F.col("end") + by).alias("end"), "peak", "mean"
    )
    return merge(wide, 0.0)


def extract(
    series: DataFrame, high: float, low: float | None = None, min_duration: float = 3.0, merge_gap: float = 2.0,
    max_duration: float | None = None, padding: float = 0.0, strict_cap: bool = False,
) -> DataFrame:
    """Hysteresis, merge, minimum, split and pad. strict_cap splits once more after padding has merged pieces."""
    kept = merge(runs(series, high, low), merge_gap).where(F.col("end") - F.col("start") >= min_duration)
    out = split(kept, max_duration)
    if padding:
        out = pad(out, series.groupBy("key").agg(F.min("time").alias("lo"), F.max("time").alias("hi")), padding)
        if strict_cap:
            out = split(out, max_duration)
    return out


def score_series(series: DataFrame, high: float, low: float, normalize: str = "none", window: int = 1, **rules) -> DataFrame:
    """Normalize, smooth and segment."""
    return extract(smooth(standardize(series, normalize), window), high, low, **rules)
