"""Operator 6: sharding by rendezvous hashing of stable record keys.

Each shard draws a score for each key from an md5 of key and shard number; the
highest score, weighted as -weight / ln(u), wins. A shard added later can only
win rows for itself, so few records move. All of it is built-in expressions.

Slots are gapless from 0 within each shard: rows are numbered within small
sub-buckets, and offsets come from the sub-buckets' counts, a table of
shards * SUB_BUCKETS rows, so no task orders a whole shard. Rows alike in key and
text are one row with a count until they have their slots, so that a row repeated
at any number is no large group. Null texts have no bytes; a null key is a key of
its own; rows that repeat a key share its shard and get slots of their own. Whole
texts of any length are read; columns besides doc_id and text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table

SHARDS = 24
SUB_BUCKETS = 64


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins the key."""

    def score(shard: int, weight: float) -> Column:
        # 52 bits, never 0 or 1
        drawn = F.md5(F.concat_ws(":", key.cast("string"), F.lit(shard)))
        u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.lit(-float(weight)) / F.log(u)

    ranked = [F.struct(score(i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*ranked) if len(ranked) > 1 else ranked[0])["shard"]


def shard_rows(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard: one row for each row of docs(doc_id, text, ...)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    wins, more = rendezvous(F.col("doc_id"), weights), rendezvous(F.col("doc_id"), grown or weights)
    rows = rows.withColumn("shard", wins).withColumn("grown_shard", more)
    own = F.md5(F.concat_ws(":", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size"))
    rows = rows.withColumn("sub", F.conv(F.substring(own, 1, 4), 16, 10).cast("int") % SUB_BUCKETS)
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "sub")
        .agg(F.sum("copies").alias("n"))
        .select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    # at most len(weights) * SUB_BUCKETS rows are broadcast
    rows = rows.join(F.broadcast(offsets), ["shard", "sub"]).withColumn("at", F.col("offset") + F.col("at"))
    blocks = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("copies") - 1, F.lit(1 << 16).cast("long")))
    rows = rows.withColumn("from", blocks)
    slots = F.explode(F.sequence("from", F.least(F.col("from") + ((1 << 16) - 1), F.col("at") + F.col("copies") - 1)))
    return rows.withColumn("slot", slots).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shard_rows(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1)).withColumn("law", F.lit("key"))


def _wins(shards: int) -> str:
    draws = f"list_transform(range({shards}), lambda i: CAST('0x' || md5(doc_id || ':' || i)[1:13] AS BIGINT))"
    return f"CAST(list_position({draws}, list_max({draws})) - 1 AS INTEGER)"


#: With equal weights the largest draw wins. The checksum is folded byte by byte over a table made by its polynomial.
SQL = f"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sums AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS text_crc32 FROM documents, steps),
placed AS (SELECT *, {_wins(SHARDS)} AS shard, {_wins(SHARDS + 1)} AS grown_shard,
  CAST('0x' || md5('slot:' || doc_id || ':' || text_crc32 || ':' || size)[1:4] AS BIGINT) % {SUB_BUCKETS} AS sub FROM sums)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY sub, doc_id, text_crc32, size) - 1 AS slot FROM placed
"""
