"""Nearest-in-time and interval joins under an equality on the scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


#: Seconds of a scene that are one sorted stream, and labels of one on average.
SPAN, LABELS = 3600.0, 100_000


def nearest(labels: DataFrame, frames: DataFrame, span: float = SPAN, size: int | None = None) -> DataFrame:
    """labels(key, time, ...) with frame_idx and frame_time of the nearest frame; the earlier on ties.

    Labels and frames are one sorted stream for each slice of `span` seconds of a key: every label looks at
    the last frame before it and the first after it, so nothing is paired. Both are running values, forwards and
    backwards in time. The nearest frames of other slices come into a slice as rows, from a summary with a row a slice. Of a
    slice with more than `size` labels, several streams are made, with the labels dealt out and the frames in each.
    Labels without frames in their scene drop out, labels and frames without a key or time, too.
    """
    frame_type = "struct<frame_idx:long,time:double>"
    at = F.floor(F.col("time") / span)
    rest = [c for c in labels.columns if c not in ("key", "time")]
    left = labels.where("key IS NOT NULL AND time IS NOT NULL").select(
        "key", "time", at.alias("slice"), F.lit(1).alias("kind"), F.struct(*rest).alias("label_row"), F.lit(None).cast(frame_type).alias("frame")
    )
    no_label = F.lit(None).cast(left.schema["label_row"].dataType).alias("label_row")
    held = frames.where("key IS NOT NULL AND time IS NOT NULL").select("key", F.col("time").cast("double").alias("time"), F.col("frame_idx").cast("long").alias("frame_idx"))
    held = held.select("key", "time", at.alias("slice"), F.lit(0).alias("kind"), no_label, F.struct("frame_idx", "time").alias("frame"))

    by_time = lambda sign: F.struct(F.col("frame.time"), (sign * F.col("frame.frame_idx")).alias("nth"))
    ends = held.groupBy("key", "slice").agg(F.min_by("frame", by_time(1)).alias("first"), F.max_by("frame", by_time(-1)).alias("last"))
    asked = left.groupBy("key", "slice").agg(F.count("*").alias("asked"))
    earlier = lambda order: Window.partitionBy("key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    around = F.array_compact(F.array(F.last("last", True).over(earlier(F.asc("slice"))), F.last("first", True).over(earlier(F.desc("slice")))))
    carried = ends.join(asked, ["key", "slice"], "full_outer").withColumn("around", around).where("asked IS NOT NULL").select("key", "slice", F.explode("around").alias("frame"))
    carried = carried.select("key", F.col("frame.time").alias("time"), "slice", F.lit(0).alias("kind"), no_label, "frame")

    # a row for each slice with more than `size` labels, so one for each `size` labels at most
    size = size or LABELS
    crowded = F.broadcast(asked.where(F.col("asked") > size).select("key", "slice", F.ceil(F.col("asked") / size).cast("int").alias("streams")))
    streams = F.coalesce("streams", F.lit(1))
    hashed = F.xxhash64("time", *(F.col("label_row").getField(c) for c, kind in labels.dtypes if c in rest and "map<" not in kind))
    left = left.join(crowded, ["key", "slice"], "left").withColumn("stream", F.pmod(hashed, streams).cast("int"))
    right = held.unionByName(carried).join(crowded, ["key", "slice"], "left").withColumn("stream", F.explode(F.sequence(F.lit(0), streams - 1)))

    rows = left.unionByName(right).drop("streams")
    # frames before labels of the same time, and of equal frames the one with the least number last, either way
    running = lambda order: Window.partitionBy("key", "slice", "stream").orderBy(order, "kind", F.desc("frame.frame_idx")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("prev", F.last("frame", True).over(running(F.asc("time")))).withColumn("next", F.last("frame", True).over(running(F.desc("time")))).where("kind = 1")
    before, after = F.col("time") - F.col("prev.time"), F.col("next.time") - F.col("time")
    use = F.when(F.col("next").isNull() | (F.col("prev").isNotNull() & (before <= after)), F.col("prev")).otherwise(F.col("next"))
    return (
        found.withColumn("use", use)
        .where("use IS NOT NULL")
        .select("key", "time", "label_row.*", F.col("use.frame_idx").alias("frame_idx"), F.col("use.time").alias("frame_time"))
    )


def without_overlap(segments: DataFrame, markers: DataFrame) -> DataFrame:
    """segments(key, tag, start, end) that touch no marker(key, tag, seconds, end_seconds) of the same scene and tag.

    In order of time, a segment touches a marker exactly if the latest end of all markers that start by the
    segment's end is not before its start: a running maximum, no pairs. Segments without a start or end touch none.
    """
    rest = [c for c in segments.columns if c not in ("key", "tag")]
    own = segments.select("key", "tag", F.struct(*rest).alias("segment"), F.col("end").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("m_end"))
    m = markers.where("key IS NOT NULL AND tag IS NOT NULL AND seconds IS NOT NULL").select(
        "key", "tag", F.lit(None).cast(own.schema["segment"].dataType).alias("segment"), F.col("seconds").alias("at"), F.lit(0).alias("kind"),
        F.coalesce("end_seconds", "seconds").cast("double").alias("m_end"),
    )
    before = Window.partitionBy("key", "tag").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = own.unionByName(m).withColumn("reach", F.max("m_end").over(before)).where("kind = 1")
    touches = F.coalesce(F.col("segment.start") <= F.col("reach"), F.lit(False))
    return rows.where(~touches | F.col("at").isNull()).select("key", "tag", "segment.*").select(segments.columns)


def new_markers(segments: DataFrame, markers: DataFrame) -> DataFrame:
    """Markers to write for segments(key, tag, start, end, peak) that touch none of the same tag; the title holds tag and peak."""
    title = F.concat_ws(" ", F.col("tag").cast("string"), F.format_string("%.3f", F.col("peak")))
    return without_overlap(segments, markers).select("key", "tag", title.alias("title"), F.col("start").alias("seconds"), F.col("end").alias("end_seconds"))
