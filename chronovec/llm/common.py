"""Shared helpers: tables in the shared folder, joins on hot keys, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is joined by broadcast. Sizes add
#: up to the number of rows, so there are at most HOT_SHARE such keys.
HOT_SHARE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_sized(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row a key; keys too hot for one task go by broadcast.

    ``groups`` is a materialized table with the number of rows of each key in
    ``size``; ``total`` is their sum, so at most HOT_SHARE keys are broadcast.
    """
    least = max(total // HOT_SHARE, 1) + 1
    hot, rest = groups.where(F.col(size) >= least), groups.where(F.col(size) < least)
    if not hot.take(1):
        return rows.join(groups, keys)
    by_hot = rows.join(F.broadcast(hot), keys)
    by_rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return by_hot.unionByName(by_rest)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex in edges(a, b); root is the smallest id reachable.

    Alternates large-star and small-star steps until the edges stop changing:
    each step is a grouped minimum (combined before the shuffle), written so that
    the equi join with it reads two plain exchanges, which adaptive execution splits
    at a hub. Stars need about four steps, long chains a logarithmic number.
    Repeated edges and loops do no harm; no edges give an empty result.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lowest")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = (
            large.join(least, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small = materialize(small, "edges")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges), drop(large), drop(low), drop(least)
        edges = small
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def smallest_hashes(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest hashes of a key: a bounded sample that doesn't depend on partitions.

    A first filter on the hash leaves about 2 * n rows, so that no task sends n of its own.
    """
    total = df.count()
    share = F.shiftrightunsigned(F.xxhash64(key), 11).cast("double") / float(1 << 53)
    near = df.where(share < (2.0 * n + 100) / total) if total > 2 * n else df
    return near.orderBy(share, key).limit(n)
