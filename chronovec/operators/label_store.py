"""Stores of labels, failures and stored formats: their identities and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovec.functions.names import in_family
from chronovec.sources.versions import VersionedStore

from .labels import centiseconds, counts, mark_times

LABELS = "key string, time_cs long, profile string, time double, label int, scene_id string, ts double"
FAILURES = "key string, scene_id string, path string, error string, mode string, hwaccel string, pipeline string, model string, ts double"
OVERRIDES = "path string, format string, fov double, pitch double, flat boolean, ts double"


class LabelStore(VersionedStore):
    """Labels by key, hundredth of a second and profile."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet"):
        super().__init__(spark, path, LABELS, ["key", "time_cs", "profile"], kind)

    def add(self, labels: DataFrame, now: float | Column | None = None, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """Adds labels(key, time, label, profile, ...); rated again counts as recent. now: seconds since 1970, else the column ts."""
        own = labels.withColumn("time_cs", centiseconds(F.col("time")))
        if now is not None:
            own = own.withColumn("ts", now if isinstance(now, Column) else F.lit(float(now)))
        return self.put(own, order, batch)

    def undo(self, profile: str, newer_than: float | None = None) -> int:
        """Deletes a profile's labels, or those rated at or after a time (unknown times are 0), and returns how many."""
        recent = F.lit(True) if newer_than is None else F.coalesce("ts", F.lit(0.0)) >= newer_than
        return self.remove((F.col("profile") == profile) & recent)

    def reset(self, base: str) -> int:
        """Deletes a base profile with its categories."""
        return self.remove(in_family(F.col("profile"), base))

    def counts(self, profile: str | None = None) -> DataFrame:
        found = counts(self.load())
        return found if profile is None else found.where(F.col("profile") == profile)


class FailureLog(VersionedStore):
    """Failed scenes by key."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "json"):
        super().__init__(spark, path, FAILURES, ["key"], kind)

    def record(self, failed: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        return self.put(failed.withColumn("error", F.substring("error", 1, 500)), order, batch)

    def resolve(self, done: DataFrame) -> int:
        """Takes scenes that went through off the log."""
        return self.remove(done)

    def clear(self) -> int:
        return self.remove(F.lit(True))


class OverrideStore(VersionedStore):
    """Formats set by hand, by path."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "json"):
        super().__init__(spark, path, OVERRIDES, ["path"], kind)


def marks_into(store: LabelStore, profile: str, name: str):
    """For foreachBatch over marks(key, scene_id, in_time, time, out_time, marked_at): likes at all times of a mark.

    The store knows the last batch of the stream `name`, so a batch that is run again after a crash changes nothing.
    Marks without a key, of sources that play nothing, drop out.
    """

    def write(marks: DataFrame, number: int) -> None:
        times = mark_times(marks.where("key IS NOT NULL"))
        likes = times.select("key", F.col("mark").alias("time"), F.lit(1).alias("label"), F.lit(profile).alias("profile"), "scene_id", F.col("marked_at").cast("double").alias("ts"))
        store.add(likes, order="ts", batch=(name, number))

    return write
