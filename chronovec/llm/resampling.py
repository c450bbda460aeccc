"""Operator 11: importance resampling of documents towards a target distribution.

Features are runs of up to `ngram` consecutive words, hashed into `buckets` by the
CRC-32 of their UTF-8 bytes. A batch's texts are joined with a separator that no
word holds, one regular expression finds all words of the batch, and a sorted search of their places in
the documents' offsets tells whose they are; runs that reach into the next document
are masked before buckets are counted.

A bucket's gain is the log ratio of its smoothed shares in the target and in the raw
documents, in whole thousandths. A document's weight is the mean gain of its features,
its score the weight plus Gumbel noise drawn from its id, so that the highest scores
are a sample without replacement by importance.

Counts are summed in a task before they are shuffled: at most `buckets` rows a task.
The gains, `buckets` numbers, are broadcast. Scores are whole numbers of a bounded
range, so their histogram is small and gives the lowest score drawn; only documents
from there on are ranked, dealt by ranges of score and id, with equal rows counted
first, so that no score and no id is one task.

Null texts have no words. Repeated rows count each and get ranks of their own; a null
doc_id draws as an empty id and comes last among equal scores. Whole texts of any
length are read, in memory in proportion; columns besides doc_id and text are ignored.
An empty target makes raw counts alone decide; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import wordhash
from .common import materialize, table

NGRAM, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
_BETWEEN = re.compile(rb"([^0-9a-z\x80-\xff]+)")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows made at once where a row is repeated.
_BLOCK = 1 << 16


def features(texts: list[bytes], ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of a batch, and the number of words of each document."""
    parts = _BETWEEN.split(b"\0".join(texts).translate(_LOWER))  # words and what lies between them, in turn
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    words, ends = parts[0::2], ends[0::2]
    filled = np.fromiter(map(bool, words), bool, len(words))  # the first and the last may be empty
    if not filled.all():
        words, ends = [w for w in words if w], ends[filled]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(offsets, ends - 1, side="right") - 1
    sums = np.fromiter(map(crc32, words), np.int64, len(words))
    owners, found = [owner], [sums % buckets]
    for n in range(2, ngram + 1):
        size = max(len(words) - n + 1, 0)
        inside = owner[:size] == owner[n - 1 :]
        sums = np.fromiter((crc32(b" " + w, s) for w, s in zip(words[n - 1 :], sums.tolist())), np.int64, size)
        owners.append(owner[:size][inside]), found.append(sums[inside] % buckets)
    return np.concatenate(owners), np.concatenate(found), np.bincount(owner, minlength=len(texts))


def _pieces(batch):
    texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    for a, b in wordhash.pieces(texts):
        yield a, b, texts[a:b]


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of texts(text) in each bucket that has any."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, part in _pieces(batch):
                total += np.bincount(features(part, ngram, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gains of all buckets, in thousandths, from counts(bucket, n) of raw and target texts."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for held, counts in ((s, raw), (t, target)):
        for r in counts.collect():  # `buckets` rows at most
            held[r["bucket"]] = r["n"]
    of_raw, of_target = float(s.sum() + buckets), float(t.sum() + buckets)
    ratios = [(x + 1.0) * of_raw / ((y + 1.0) * of_target) for x, y in zip(t.tolist(), s.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id, in thousandths, floored."""
    drawn = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def scores(docs: DataFrame, gains: np.ndarray, ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        for batch in batches:
            own, words, sizes, sums = held.value, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b, part in _pieces(batch):
                owner, bucket, n = features(part, ngram, len(own))
                words.append(n), sizes.append(np.bincount(owner, minlength=b - a))
                sums.append(np.bincount(owner, weights=own[bucket], minlength=b - a).astype(np.int64))  # whole numbers below 2^53
            n, total = np.concatenate(sizes), np.concatenate(sums)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = batch.column("doc_id").cast(pa.int64())
            noise = np.fromiter((gumbel(i, seed) for i in ids.to_pylist()), np.int64, len(ids))
            columns = [ids, *(pa.array(x, pa.int64()) for x in (np.concatenate(words), n, weight, weight + noise))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored, materialized, with rank from 1 for the highest scores: `percent` of the rows with enough words; else null."""
    rows = scored.withColumn("eligible", F.col("n_words") >= least_words)
    # whole scores of a bounded range: thousandths of log ratios and of the noise
    heights = sorted((tuple(r) for r in rows.where("eligible").groupBy("score").count().collect()), reverse=True)
    wanted = sum(n for _, n in heights) * percent // 100
    least, above = None, 0
    for score, n in heights:
        if above >= wanted:
            break
        least, above = score, above + n
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = F.col("eligible") & (F.col("score") >= least)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    equal = rows.where(near).groupBy(*columns).agg(F.count("*").alias("copies"))
    ranges = materialize(equal.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked-ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = ranges.groupBy("part").agg(F.sum("copies").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = F.sum("copies").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("offset") + F.coalesce("inside", F.lit(0)) + 1
    # as many rows as ranges are broadcast
    ranked = ranges.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("first", first)
    ranked = ranked.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_BLOCK).cast("long"))))
    ranked = ranked.withColumn("nth", F.explode(F.sequence("from", F.least(F.col("from") + (_BLOCK - 1), F.col("copies") - 1))))
    ranked = ranked.withColumn("at", F.col("first") + F.col("nth")).select(*columns, F.when(F.col("at") <= wanted, F.col("at")).alias("rank"))
    return ranked.unionByName(rows.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs(doc_id, text), drawn towards target(text)."""
    gains = bucket_gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets), buckets)
    return draw(materialize(scores(docs, gains, ngram, seed), "scores"), percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


#: The checksum of each distinct word is folded byte by byte over a table made by its polynomial.
SQL = f"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
split AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
here AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM split) GROUP BY word),
there AS (SELECT word, count(*) AS n FROM (SELECT unnest({_words_sql('text')}) AS word FROM benchmark) GROUP BY word),
sums AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT word FROM here UNION SELECT word FROM there), steps),
s AS (SELECT bucket, sum(n) AS n FROM here JOIN sums USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM there JOIN sums USING (word) GROUP BY bucket),
gains AS (SELECT b.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM (SELECT doc_id, unnest(w) AS word FROM split) JOIN sums USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
  + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{SEED}:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS nth FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {LEAST_WORDS} AND nth <= (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) * {PERCENT} // 100 THEN nth END AS rank FROM ranked
"""
