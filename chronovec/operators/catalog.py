"""Library against cache: freshness, reconciliation, work lists and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovec.functions.names import path_key


def fresh(scenes: DataFrame, cached: DataFrame) -> DataFrame:
    """scenes(key, signature) that the cache(key, interval) holds under the same setting."""
    c = cached.select(F.col("key").alias("c_key"), F.col("interval").alias("c_interval"))
    return scenes.join(c, (F.col("key") == F.col("c_key")) & (F.abs(F.col("c_interval") - F.col("signature")) < 1e-6), "left_semi")


def worklist(scenes: DataFrame, cached: DataFrame) -> DataFrame:
    """scenes that have yet to be embedded."""
    c = cached.select(F.col("key").alias("c_key"), F.col("interval").alias("c_interval"))
    return scenes.join(c, (F.col("key") == F.col("c_key")) & (F.abs(F.col("c_interval") - F.col("signature")) < 1e-6), "left_anti")


def reconcile(cached: DataFrame, library: DataFrame, prune: bool = False) -> DataFrame:
    """cache(key, path, scene_id) with status moved, orphaned, pruned or unchanged, and the new path and id."""
    lib = library.select("key", F.col("path").alias("lib_path"), F.col("scene_id").alias("lib_id"), F.lit(True).alias("listed"))
    new_path = F.coalesce(F.nullif(F.col("lib_path"), F.lit("")), F.col("path"))
    moved = (new_path.isNotNull() & ~new_path.eqNullSafe(F.col("path"))) | ~F.col("lib_id").cast("string").eqNullSafe(F.col("scene_id").cast("string"))
    status = F.when(F.col("listed").isNull(), F.lit("pruned" if prune else "orphaned")).when(moved, F.lit("moved")).otherwise(F.lit("unchanged"))
    return cached.join(lib, "key", "left").select(
        "key", status.alias("status"), F.when(F.col("listed").isNull(), F.col("path")).otherwise(new_path).alias("path"), F.coalesce("lib_id", "scene_id").alias("scene_id")
    )


def sync_counts(reconciled: DataFrame) -> DataFrame:
    """One row: entries in the cache, how many were moved, orphaned and pruned; a pruned entry was an orphan, too."""
    status = F.col("status")
    return reconciled.agg(
        F.count("*").alias("cached"), F.count_if(status == "moved").alias("moved"),
        F.count_if(status.isin("orphaned", "pruned")).alias("orphaned"), F.count_if(status == "pruned").alias("pruned"),
    )


def cache_keys(frames: DataFrame, model: str) -> DataFrame:
    """Keys of the scenes held for a model, in order; no vector is read."""
    return frames.where(F.col("model") == model).select("key").distinct().orderBy("key")


def cache_models(frames: DataFrame) -> DataFrame:
    return frames.select("model").distinct()


def peek_counts(frames: DataFrame) -> DataFrame:
    """Number of frames of each model and scene; no vector is read."""
    return frames.groupBy("model", "key").agg(F.count("*").alias("frames"))


def status_counts(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("status").agg(F.count("*").alias("n"))


def run_stats(done: DataFrame) -> DataFrame:
    """Scenes and frames of a run over done(status, frames), by status; a scene without frames adds none."""
    return done.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"))


def quality_status(files: DataFrame, cached: DataFrame, failures: DataFrame, overrides: DataFrame) -> DataFrame:
    """files(path) with embedded, failed, error and override."""
    return (
        files.withColumn("key", path_key(F.col("path")))
        .join(cached.select("key", F.lit(True).alias("embedded")).distinct(), "key", "left")
        .join(failures.select("path", "error", F.lit(True).alias("failed")), "path", "left")
        .join(overrides.select("path", F.col("format").alias("override")), "path", "left")
        .select("path", "key", F.coalesce("embedded", F.lit(False)).alias("embedded"), F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("error", F.lit("")).alias("error"), "override")
    )


def put(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: rows replace those of the same key."""
    return store.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def record_failures(log: DataFrame, failed: DataFrame) -> DataFrame:
    return put(log, failed.withColumn("error", F.substring("error", 1, 500)), "key")


def resolve(log: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    return log.join(done.select(key).distinct(), key, "left_anti")


def progress(jobs: DataFrame) -> DataFrame:
    """jobs(job, done, total, elapsed) with seconds left at the rate so far; unknown before the first step or without a total."""
    left = F.round(F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done")), 1)
    return jobs.withColumn("eta", F.when((F.col("done") > 0) & (F.col("total") > 0), left))
