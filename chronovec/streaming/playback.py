"""Live playback: packets to states, latest state of each source, marks to labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from chronovec.functions.binary import take_frames
from chronovec.functions.names import path_key
from chronovec.operators.labels import mark_times

PACKET = "path string, resource string, currentTime double, duration double, playbackSpeed double, playerState int"


def playback_state(packet: Column) -> Column:
    """State of a JSON packet; missing or zero speed is 1, a missing player state is playing."""
    p = F.from_json(packet, PACKET)
    speed = F.coalesce(F.when(p["playbackSpeed"] != 0, p["playbackSpeed"]), F.lit(1.0))
    return F.struct(
        F.coalesce(F.nullif(p["path"], F.lit("")), F.nullif(p["resource"], F.lit(""))).alias("path"),
        F.coalesce(p["currentTime"], F.lit(0.0)).alias("current_time"),
        (F.coalesce(p["playerState"], F.lit(0)) == 0).alias("playing"),
        p["duration"].alias("duration"),
        speed.alias("playback_speed"),
    )


def latest_state(states: DataFrame, by: str, order: str) -> DataFrame:
    """The last state of each source, batch or stream."""
    rest = [c for c in states.columns if c != by]
    return states.groupBy(by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(by, "last.*")


def batches_of(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose tables lie in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
    whole = lambda n: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and whole(n))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result, a Parquet table beside the checkpoint.

    Every batch is a folder by its number: one that runs again after a crash writes the same folder, and a later run
    with the same checkpoint returns what earlier ones wrote as well. A complete result replaces those before.
    """
    folder = f"{checkpoint.rstrip('/')}-table"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    known = batches_of(spark, folder)
    paths = [f"{folder}/{n}" for n in (known[-1:] if mode == "complete" else known)]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def marks_to_labels(marks: DataFrame, states: DataFrame, profile: str) -> DataFrame:
    """Positive labels at the marks' times for what each source plays; marks of idle sources drop out."""
    playing = marks.join(states.where("path IS NOT NULL"), "source")
    return mark_times(playing).select(
        path_key(F.col("path")).alias("key"), F.col("mark").alias("time"), F.lit(1).alias("label"), F.lit(profile).alias("profile"),
        F.lit(None).cast("string").alias("scene_id"), F.col("marked_at").alias("ts"),
    )


def connections(packets: DataFrame, silence: str = "3 seconds") -> DataFrame:
    """(source, started, ended, packets) of each time a source was connected; batch or stream.

    A silence longer than `silence` ends a connection; packets(source, ts) with a null source or time
    are left out. Streams need a watermark on ts.
    """
    held = F.session_window("ts", silence)
    own = packets.where("source IS NOT NULL AND ts IS NOT NULL").groupBy("source", held.alias("held")).agg(F.count("*").alias("packets"))
    return own.select("source", F.col("held.start").alias("started"), F.col("held.end").alias("ended"), "packets")


def messages(chunks: DataFrame, little: bool = False) -> DataFrame:
    """(source, seq, nth, message) of a stream of chunks(source, seq, data) of framed messages; a ping's message is null.

    A frame may begin in one chunk and end in a later one: the open rest is the source's state. seq is the chunk that
    completes a message, nth its place there. Chunks arrive in order of seq, within a batch they are sorted.
    """

    def run(key, batches, state):
        rest = state.get[0] if state.exists else b""
        for row in pd.concat(batches).sort_values("seq", kind="stable").itertuples():
            found, rest = take_frames(rest + (row.data or b""), little)
            yield pd.DataFrame({"source": key[0], "seq": row.seq, "nth": range(len(found)), "message": pd.Series(found, dtype=object)})
        state.update((rest,))

    source, seq = chunks.schema["source"].dataType.simpleString(), chunks.schema["seq"].dataType.simpleString()
    schema = f"source {source}, seq {seq}, nth int, message string"
    return chunks.select("source", "seq", "data").groupBy("source").applyInPandasWithState(run, schema, "rest binary", "append", GroupStateTimeout.NoTimeout)


def demo_feed(spark: SparkSession, path: str, duration: float = 600.0, per_second: int = 2) -> DataFrame:
    """A stream of states as if path played over and over, without a player."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select(
        F.lit("demo").alias("source"), F.col("timestamp").alias("ts"), F.lit(path).alias("path"),
        F.round(F.pmod(F.col("value") / per_second, F.lit(duration)), 2).alias("current_time"), F.lit(True).alias("playing"), F.lit(duration).alias("duration"),
    )
