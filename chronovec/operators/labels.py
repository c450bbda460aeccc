"""Label store algebra: labels(key, time, label, profile, scene_id, ts) with identity (key, time_cs, profile)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovec.functions.names import base_profile, in_family

IDENTITY = ["key", "time_cs", "profile"]


def centiseconds(time: Column) -> Column:
    """Times agree when equal to a hundredth; computed once, as an integer."""
    return F.rint(time * 100).cast("long")


def upsert(labels: DataFrame, by: str = "seq") -> DataFrame:
    """The last row in order of `by` for each identity; a grouped maximum, combined before the shuffle."""
    rest = [c for c in labels.columns if c not in IDENTITY]
    last = labels.groupBy(*IDENTITY).agg(F.max_by(F.struct(*rest), F.struct(by, *[c for c in rest if c != by])).alias("last"))
    return last.select(*IDENTITY, "last.*").select(labels.columns)


def remove(labels: DataFrame, profile: str, newer_than: float | None = None) -> DataFrame:
    """Without a profile's labels, or only those at or after a time; unknown times are 0."""
    gone = F.col("profile") == profile
    if newer_than is not None:
        gone = gone & (F.coalesce("ts", F.lit(0.0)) >= newer_than)
    return labels.where(~F.coalesce(gone, F.lit(False)))


def unlike(labels: DataFrame, identities: DataFrame) -> DataFrame:
    return labels.join(identities.select(*IDENTITY).distinct(), IDENTITY, "left_anti")


def reset(labels: DataFrame, base: str) -> DataFrame:
    """Without a base profile and all its categories."""
    return labels.where(~F.coalesce(in_family(F.col("profile"), base), F.lit(False)))


def counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("profile").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))


def summary(labels: DataFrame, base: str) -> DataFrame:
    """Likes of each profile of a family, and the family's total, largest first."""
    own = labels.where(in_family(F.col("profile"), base) & (F.col("label") == 1))
    return own.rollup("profile").agg(F.count("*").alias("likes")).withColumn("profile", F.coalesce("profile", F.lit("*"))).orderBy(F.desc("likes"), "profile")


def bases(labels: DataFrame, *more: str) -> DataFrame:
    """Distinct base profiles, with those that are active or default."""
    own = labels.select(base_profile(F.col("profile")).alias("base"))
    if more:
        own = own.union(labels.sparkSession.createDataFrame([(m,) for m in more], "base string"))
    return own.distinct()


def mark_times(marks: DataFrame) -> DataFrame:
    """One row for each distinct time of in, point and out."""
    times = F.array_sort(F.array_distinct(F.array_compact(F.array("in_time", "time", "out_time"))))
    return marks.withColumn("mark", F.explode(times))


def liked_ids(labels: DataFrame, base: str) -> DataFrame:
    return labels.where(in_family(F.col("profile"), base) & (F.col("label") == 1)).select("key", "time_cs").distinct()


def newest(labels: DataFrame, profile: str, limit: int = 50) -> DataFrame:
    """The latest likes of a profile; unknown times come last."""
    return labels.where((F.col("profile") == profile) & (F.col("label") == 1)).orderBy(F.desc_nulls_last("ts"), "key", "time_cs").limit(limit)
