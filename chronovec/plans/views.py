"""Tables of the operators' roles, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors a scene, eight seconds apart."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), F.floor(F.col("vec_id") / 50).cast("string")).alias("key"),
        (F.col("vec_id") % 50).alias("frame_idx"),
        ((F.col("vec_id") % 50) * 8.0).cast("double").alias("time"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
        F.col("label").alias("category"),
    )


FRAMES_SQL = """frames AS (SELECT 's' || CAST(vec_id // 50 AS VARCHAR) AS key, vec_id % 50 AS frame_idx, CAST((vec_id % 50) * 8 AS DOUBLE) AS time,
  CAST(embedding AS DOUBLE[]) AS vec, label AS category FROM embeddings)"""
#: Cosine of two unit-normalised vectors with 1e-8 added to each norm.
COSINE_SQL = "list_dot_product(f.vec, r.vec) / ((sqrt(list_dot_product(f.vec, f.vec)) + 1e-8) * (sqrt(list_dot_product(r.vec, r.vec)) + 1e-8))"


def _seconds(ts: str):
    """Seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    whole = F.unix_date(F.to_date(ts)).cast("double") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole + F.date_part(F.lit("SECOND"), F.col(ts)).cast("double")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event values over hours."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("idx"), (_seconds("ts") / 3600).alias("time"), F.col("value").alias("score")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """series with idx from 0 within each key."""
    from pyspark.sql import Window

    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("time", "idx")) - 1)


SERIES_SQL = """series AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  epoch(ts) / 3600 AS time, value AS score FROM events)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are likes and errors dislikes, of a user's day; profiles by user."""
    events = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    return events.select(
        F.col("user_id").cast("string").alias("key"),
        F.unix_date(F.to_date("ts")).cast("long").alias("time_cs"),
        F.concat(F.lit("base"), F.element_at(F.array(*(F.lit(x) for x in ("", ":c1", ":c2", ":c3"))), (F.col("user_id") % 4 + 1).cast("int"))).alias("profile"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("double").alias("ts"),
    )


LABELS_SQL = """labels_log AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS time_cs,
  'base' || ['', ':c1', ':c2', ':c3'][user_id % 4 + 1] AS profile, CAST(event_type = 'purchase' AS INTEGER) AS label, event_id AS seq, CAST(event_id AS DOUBLE) AS ts
  FROM events WHERE event_type IN ('purchase', 'error')),
store AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY key, time_cs, profile ORDER BY seq DESC) AS nth FROM labels_log) WHERE nth = 1)"""
