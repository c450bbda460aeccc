"""Operator 5 [native]: exact deduplication on an extendible-hash index in shared files.

Texts are equal when identical after each run of ASCII white space became one
space. The index is built in bulk with DataFrame operations only:

1. A pass writes doc_id and 64-bit hash of each row, and the rows of each hash.
2. The directory: distinct hashes are counted in cells of leading bits, and every
   bucket with more than CAPACITY hashes is split by its next bit, which doubles
   the directory where its depth is reached (`directory_of`). The cells' depth
   follows from the number of hashes; capacity grows with it, so that the directory
   has at most 2^DIRECTORY_BITS slots and is broadcast.
3. A second pass takes whole texts through the directory: the leading bits of its
   hash give a row's bucket, the bucket its owner. Owner tasks each take a range of
   buckets and group its rows by bucket, hash and bytes: texts of one hash form a
   chain, in which bytes are compared, so that only identical texts are one entry. A
   task holds each text once, however many rows repeat it. Hashes with more rows than
   an owner has on average, at most as many hashes as owners, would overload theirs;
   their rows are combined before they are shuffled, by bucket, hash and bytes as well.
4. Postings: rows of step 1 go through the directory to the owners too, without texts,
   and meet the entry of their hash; those of overloading hashes look it up among the
   few entries. Only where a chain holds several texts are these read again.
5. The index is written by bucket, one row for each posting of an entry, and read
   back as the result.

Null texts count as empty. Null doc_ids are kept last; of rows that repeat one
doc_id and text, one is kept. An empty table gives an empty result. Texts of any
length are compared whole. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import drop, join_sized, materialize, table

#: Distinct hashes in a bucket before it is split; more where the directory would get too large.
CAPACITY = 4096
#: Slots of the directory, as a power of 2: about 16 MB where it is broadcast.
DIRECTORY_BITS = 20
#: Bits of the cells beyond those that evenly spread hashes need.
SPARE_BITS = 4


def normalized(text: Column) -> Column:
    """One space for each run of ASCII white space; single spaces need no replacing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _leading(h: str, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def directory_of(hashes: DataFrame, capacity: int, bits: int) -> DataFrame:
    """(slot, bucket, depth) for each pattern of `bits` leading bits of hashes(h); a bucket is named after its first slot.

    A bucket of local depth d holds the hashes that share d leading bits. Starting from one, all with more than
    `capacity` hashes are split, so a slot's depth is the first at which its bucket is small enough.
    """
    cells = hashes.groupBy(_leading("h", bits).alias("cell")).agg(F.count("*").alias("n"))
    depths = F.sequence(F.lit(0), F.lit(bits))

    def prefix(of: str) -> Column:
        return F.expr(f"shiftright({of}, {bits} - d)").alias("prefix")

    full = cells.select("cell", "n", F.explode(depths).alias("d")).groupBy("d", prefix("cell")).agg(F.sum("n").alias("n"))
    full = full.where((F.col("n") > capacity) & (F.col("d") < bits)).select("d", "prefix", F.lit(1).alias("full"))
    slots = hashes.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("slot"), F.explode(depths).alias("d"))
    split = slots.select("slot", "d", prefix("slot")).join(full, ["d", "prefix"], "left")
    depth = split.groupBy("slot").agg(F.min(F.when(F.col("full").isNull(), F.col("d"))).alias("depth"))
    return depth.select("slot", F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)").alias("bucket"), "depth")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs(doc_id, text, ...).

    hash_bits below 64 force collisions (tests).
    """
    spark = docs.sparkSession
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("norm"))
    hashed = F.xxhash64("norm") if hash_bits == 64 else F.shiftleft(F.xxhash64("norm"), 64 - hash_bits)
    keyed = norm.withColumn("h", hashed)

    keys = materialize(keyed.groupBy("doc_id", "h").agg(F.count("*").alias("copies")), "dedup-keys")
    counts = materialize(keys.groupBy("h").agg(F.sum("copies").alias("rows")), "hash-counts")
    number, total = counts.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    capacity = max(capacity, -(-number >> (DIRECTORY_BITS - SPARE_BITS - 1)))
    bits = (-(-number // capacity)).bit_length() + SPARE_BITS
    directory = materialize(directory_of(counts, capacity, bits), "directory")
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at most `owners` hashes, as their rows add up to `total` at most
    hot = counts.where(F.col("rows") > total / owners).select("h")

    def routed(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("slot", _leading("h", bits)).join(F.broadcast(directory), "slot")  # 2^DIRECTORY_BITS slots at most
        return at.withColumn("owner", F.floor(F.col("bucket") * owners / (1 << bits)).cast("int")).drop("slot", "depth")

    def owned(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(hot), "h", "left_anti").repartitionById(owners, F.col("owner"))

    entries = _entries(owned(routed(keyed)))
    some_hot = bool(hot.take(1))
    if some_hot:
        entries = entries.unionByName(_entries(routed(keyed).join(F.broadcast(hot), "h")))
    entries = materialize(entries, "entries")
    alone = entries.where("chain = 1")
    index = owned(routed(keys)).join(owned(alone), ["owner", "bucket", "h"])  # dealt alike: an owner's rows meet in its task
    if some_hot:
        index = index.unionByName(keys.join(F.broadcast(alone.join(F.broadcast(hot), "h")), "h"))
    if entries.where("chain > 1").take(1):
        index = index.unionByName(_shared(keyed, entries.where("chain > 1"), total))
    index = materialize(_numbered(index).sortWithinPartitions("bucket", "h"), "dedup-index")
    drop(keys), drop(counts), drop(directory), drop(entries)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return index.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _entries(rows: DataFrame) -> DataFrame:
    """An entry for each text of rows(owner, bucket, h, norm, doc_id); chain is the number of entries of its hash."""
    chain = Window.partitionBy("owner", "bucket", "h")
    found = rows.groupBy("owner", "bucket", "h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return found.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm").withColumn("chain", F.count("*").over(chain))


def _shared(keyed: DataFrame, entries: DataFrame, total: int) -> DataFrame:
    """The postings of entries whose hash several texts share; rows of keyed(doc_id, norm, h) are told apart by their texts.

    Such hashes are next to none of 64-bit ones.
    """
    told = keyed.join(F.broadcast(entries.select("h").distinct()), "h").select("h", "doc_id", F.sha2("norm", 256).alias("text_sha256"))
    told = told.groupBy("h", "doc_id", "text_sha256").agg(F.count("*").alias("copies"))
    return join_sized(told, entries, ["h", "text_sha256"], "group_size", total)


def _numbered(postings: DataFrame) -> DataFrame:
    """A row for each of a posting's copies, numbered from 1: of rows that repeat a doc_id, one is kept."""
    blocks = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"), F.lit(1 << 16).cast("long")))
    inner = F.explode(F.sequence("from", F.least(F.col("from") + ((1 << 16) - 1), "copies")))
    return postings.drop("chain").withColumn("from", blocks).withColumn("nth", inner).drop("copies", "from")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
