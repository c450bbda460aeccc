"""Readers and writers: frame archives, label, failure, override and playlist stores."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovec.functions.names import path_key
from chronovec.operators.labels import centiseconds, upsert
from chronovec.sources.shared import written
from chronovec.sources.versions import VersionedStore

FRAMES = "key string, frame_idx int, time float, vec array<float>, meta string"
LABELS = "key string, time double, label int, profile string, scene_id string, ts double"
FAILURES = "key string, scene_id string, path string, error string, mode string, hwaccel string, pipeline string, model string, ts double"
PLAYLIST = "profile string, moments array<struct<path:string,key:string,start:double,end:double,score:double>>"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Frames of .npz archives (times, vecs, meta), one archive a scene; unreadable ones are skipped."""

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as data:
                        times, vecs, meta = data["times"].astype(np.float32), data["vecs"].astype(np.float32), str(data["meta"])
                except (ValueError, KeyError, OSError):
                    continue
                key = name.rsplit("/", 1)[-1].removesuffix(".npz")
                yield pd.DataFrame({"key": key, "frame_idx": np.arange(len(times), dtype=np.int32), "time": times, "vec": list(vecs), "meta": meta})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content").mapInPandas(run, FRAMES)


#: Folders of a model's frames; a scene is in the one its key is hashed to.
BUCKETS = 256


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_frames(frames: DataFrame, path: str) -> None:
    """Saves the scenes that frames(model, key, time, vec, ...) holds; other scenes of the same models stay as they are.

    A model's scenes are in BUCKETS folders, sorted by key, so that many scenes make no many small files; a save writes
    the buckets of its scenes anew, with what else they hold. A time without a vector, a vector without a time, or
    vectors of several lengths in a scene raise ValueError before anything is written.
    """
    length = F.size("vec")
    odd = frames.groupBy("model", "key").agg(
        F.count_if(F.col("time").isNull() | F.col("vec").isNull()).alias("open"), F.min(length).alias("least"), F.max(length).alias("most")
    )
    wrong = odd.where("open > 0 OR least <> most").select("key").first()
    if wrong:
        raise ValueError(f"times and vectors of {wrong['key']} don't agree")
    spark = frames.sparkSession
    rows = frames.withColumn("bucket", _bucket(F.col("key")))
    at, system = _files(spark, path)
    if system.exists(at):
        before = spark.read.schema(rows.schema).parquet(path)
        touched, own = rows.select("model", "bucket").distinct(), rows.select("model", "key").distinct()
        rows = rows.unionByName(before.join(touched, ["model", "bucket"], "left_semi").join(own, ["model", "key"], "left_anti").select(rows.columns))
        rows = written(rows, "frames")  # what is read is about to be replaced
    rows = rows.repartition("model", "bucket").sortWithinPartitions("model", "bucket", "key")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "bucket").parquet(path)


def read_frames(spark: SparkSession, path: str, schema: str = "frame_idx int, time float, vec array<float>, meta string", keys: list[str] | None = None) -> DataFrame:
    """Saved frames; a filter on model reads that model's folders only, keys only the buckets of these scenes."""
    rows = spark.read.schema(f"key string, {schema}, model string, bucket int").parquet(path)
    if keys is not None:
        named = spark.createDataFrame([(k,) for k in keys], "key string").select(_bucket(F.col("key")).alias("b")).distinct()
        rows = rows.where(F.col("bucket").isin([r["b"] for r in named.collect()]) & F.col("key").isin(keys))
    return rows.drop("bucket")


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path, on whichever storage it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def video_files(spark: SparkSession, paths: str | list[str], extensions: str = "mp4,mkv,webm,mov,avi,m4v,wmv,ts") -> DataFrame:
    """path, key and title of files with a video's extension, in any case, below folders; a file named itself needs none."""
    folders, named = [], []
    for path in [paths] if isinstance(paths, str) else paths:
        at, system = _files(spark, path)
        (folders if system.getFileStatus(at).isDirectory() else named).append(path)
    found = spark.createDataFrame([(system.makeQualified(at).toString(),) for at, system in (_files(spark, p) for p in named)], "path string")
    if folders:
        below = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).select("path")
        found = found.union(below.where(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(extensions.split(","))))
    return found.distinct().withColumn("key", path_key(F.col("path"))).withColumn("title", F.regexp_extract("path", r"([^/\\]+)\.[^./\\]+$", 1))


def references_dir(spark: SparkSession, base: str, tag: str) -> str:
    """The folder of a profile's reference stills: that of its tag where there is one, else the base itself."""
    own = f"{base.rstrip('/')}/{re.sub(r'[^\w-]', '_', tag)}"
    at, system = _files(spark, own)
    return own if tag and system.exists(at) and system.getFileStatus(at).isDirectory() else base


def reference_files(spark: SparkSession, path: str, extensions: str = "jpg,jpeg,png,webp,bmp") -> DataFrame:
    """path and content of the images right in a folder; those of folders below belong to other profiles and aren't opened."""
    at, system = _files(spark, path)
    named = re.compile(rf"\.({extensions.replace(',', '|')})$", re.I)
    own = [f.getPath().toString() for f in system.listStatus(at) if f.isFile() and named.search(f.getPath().getName())]
    if not own:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(own).select("path", "content")


def load_references(spark: SparkSession, path: str, embed: Callable[[Column], Column]) -> DataFrame:
    """path and vec of a folder's reference stills; a folder without any raises ValueError."""
    found = reference_files(spark, path)
    if not found.select("path").take(1):
        raise ValueError(f"no reference images in {path}")
    return found.select("path", embed(F.col("content")).alias("vec"))


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON list; a file that can't be parsed is empty."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.coalesce(*(F.col(c).cast("string") for c in rows.columns)).isNotNull())


def _label_versions(spark: SparkSession, path: str) -> VersionedStore:
    return VersionedStore(spark, path, LABELS, ["key", "time", "profile"], "json")


def write_labels(labels: DataFrame, path: str) -> None:
    """Saves labels as JSON lines: a new version beside the old one, which readers see until the new one is whole."""
    rows = labels.select(*(c.split()[0] for c in LABELS.split(", ")))
    _label_versions(labels.sparkSession, path).save(lambda _, number: rows.withColumn("seq", F.lit(number).cast("long")))


def read_labels(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Labels of a store, or of files of JSON lines or a JSON list; of rows with the same identity the last one counts.

    Rows come in order of their files' names, and in files in order of their places; files are read in any order, so
    the order is carried as a column.
    """
    store = _label_versions(spark, path)
    if store.versions():
        rows = store.load().withColumn("order", F.struct("seq", F.monotonically_increasing_id().alias("nth")))
    else:
        files = spark.read.schema(LABELS).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path)
        place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("nth"))
        rows = files.select("*", place.alias("order"))
    rows = rows.where("key IS NOT NULL").withColumn("ts", F.coalesce("ts", F.lit(0.0)))
    last = upsert(rows.withColumn("time_cs", centiseconds(F.col("time"))), by="order")
    return last.select(*(c.split()[0] for c in LABELS.split(", ")))


def read_playlist(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """profile and ranked moments of playlists: records on a line each, or one record a file; a missing score is 0."""
    rows = spark.read.schema(PLAYLIST).option("multiLine", not lines).json(path)
    return rows.select("profile", F.posexplode("moments").alias("rank", "m")).select("profile", "rank", "m.*").withColumn("score", F.coalesce("score", F.lit(0.0)))


def write_playlist(playlist: DataFrame, path: str) -> None:
    """One JSON record for each profile: its count and moments in order of rank. A playlist has a bounded length."""
    moment = F.struct("rank", "path", "key", "start", "end", "score", F.greatest(F.col("end") - F.col("start"), F.lit(0.0)).alias("duration"))
    out = playlist.groupBy("profile").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(moment)).alias("moments"))
    out.write.mode("overwrite").json(path)


def decode_packets(text: str) -> list[dict]:
    """Objects of a stream of JSON texts without framing, up to what is none: a broken tail or anything else but white space."""
    decoder, out, at = json.JSONDecoder(), [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if text[at] != "{":
            break
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        out.append(value)
    return out
