"""Operator 9: benchmark decontamination by winnowing.

A window is WINDOW consecutive words of an item. Of each run of WINDOW - K + 1 k-grams
of K words, the smallest hash is kept, once for each place where it stands: the
fingerprints of a text, about one in three of its k-grams. A document and an item that
share WINDOW words keep the same k-gram of them, so joining the fingerprints of both
misses no shared window. A fingerprint has the words around it with it, as far as a
window that contains it can reach; where two meet, the hit is extended to the left and
right as long as the words are equal, and counts from WINDOW words on. Words are
compared by 64-bit hashes. Items shorter than a window are one window of their own
length, whose fingerprint is the whole item.

A bit table of the items' fingerprints, of a bounded size, is broadcast as a first
filter for the tasks that scan the documents; a benchmark of more than BLOCK_WINDOWS
fingerprints lets more places through, no hit is lost. The places left are joined with
the items' fingerprints, equal ones of several items once, and item ids last:
fingerprints with the same items form a group, documents with the same groups share
one list.

Null texts have no words; items without words match nothing. Repeated rows and
repeated item ids give one result each row; equal item ids count once. Whole texts of
any length are read; an empty table of documents gives an empty result, an empty
benchmark no hit; other columns are ignored, but for `without_hits`, which keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import join_sized, materialize, table

WINDOW, K = 10, 5
#: Fingerprints of the items that the first filter is laid out for. Few have FILTER_BITS each, so that few documents without
#: a hit are looked at again; the filter has 2^MOST_BITS bits, 32 MB, at most.
BLOCK_WINDOWS, FILTER_BITS, MOST_BITS = 1_000_000, 2048, 28
#: Fingerprints of items that are broadcast, where a place is too common to be one task; beyond, the join is left to adaptive splitting.
MOST_BROADCAST = 100_000


def winnowed(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of the smallest k-gram, the leftmost one, of each window; hashes of all k-grams); texts not minded."""
    kgrams = wordhash.grams(hashes, k)
    size = max(len(hashes) - window + 1, 0)
    best, at = kgrams[:size].copy(), np.arange(size)
    for j in range(1, window - k + 1):
        other = kgrams[j : j + size]
        less = other < best
        best[less], at[less] = other[less], np.flatnonzero(less) + j
    return at, kgrams


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fingerprints(hashes: np.ndarray, counts: np.ndarray, n: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the fingerprints of texts, for windows of n words: winnowed ones, or all where n is less."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if n < window:
        prints = wordhash.grams(hashes, n)
        at = np.flatnonzero(owner[: len(prints)] == owner[n - 1 :]) if len(prints) else np.zeros(0, np.int64)
        return at, prints[at]
    at, prints = winnowed(hashes, window, k)
    at = at[owner[: len(at)] == owner[window - 1 :]] if len(at) else at
    at = at[np.diff(at, prepend=-1) != 0]
    return at, prints[at]


def _around(at: np.ndarray, ns: np.ndarray, hashes: np.ndarray, counts: np.ndarray, window: int, k: int):
    """(words before, words) about each place, as far as a window that holds its fingerprint can reach in its text."""
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, at, side="right")
    whole = ns == window
    low = np.where(whole, np.maximum(at - (window - k), ends[doc] - counts[doc]), at)
    high = np.where(whole, np.minimum(at + window, ends[doc]), at + ns)
    size = high - low
    offsets = np.concatenate(([0], np.cumsum(size)))
    flat = np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], size)
    words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[flat].view(np.int64)))
    return doc, at - (ends - counts)[doc], at - low, words


def _item_prints(window: int, k: int):
    """(item_id, n, fp, before, words): the fingerprints of each item, for windows of n words."""

    def run(batches):
        for batch in batches:
            every = batch.column("item_id").to_pylist()
            texts = _texts(batch.column("text"))
            for a, b in wordhash.pieces(texts):
                hashes, counts = wordhash.words(texts[a:b], wordhash.ALPHANUMERIC)
                found = [fingerprints(hashes, counts, window, window, k)]
                ns = [np.full(len(found[0][0]), window)]
                starts = np.cumsum(counts) - counts
                for n in np.unique(counts[(counts > 0) & (counts < window)]):
                    at = starts[counts == n]
                    found.append((at, wordhash.grams(hashes, int(n))[at])), ns.append(np.full(len(at), n))
                at, fp = (np.concatenate(x) for x in zip(*found))
                n = np.concatenate(ns)
                doc, _, before, words = _around(at, n, hashes, counts, window, k)
                ids = pa.array([every[a + d] for d in doc], pa.string())
                columns = [ids, pa.array(n, pa.int32()), pa.array(fp.view(np.int64)), pa.array(before, pa.int32()), words]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "n", "fp", "before", "words"])

    return run


def _pages(batches):
    """(page, bits): pages of the bit table, from the slots set in them."""
    pages: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot in batch.column("slot").to_numpy():
            own = pages.setdefault(int(slot) >> 15, np.zeros(4096, np.uint8))
            own[(slot >> 3) & 4095] |= 1 << (int(slot) & 7)
    yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([x.tobytes() for x in pages.values()], pa.binary())], ["page", "bits"])


def _first_filter(prints: DataFrame, block_windows: int):
    """Broadcast (lengths of windows, bit table of fingerprints)."""
    number = prints.count()
    bits = 1 << max(15, min(MOST_BITS, (FILTER_BITS * max(1, min(number, block_windows)) - 1).bit_length()))
    lengths = sorted(r["n"] for r in prints.select("n").distinct().collect())  # WINDOW at most
    slots = prints.select(F.col("fp").bitwiseAND(F.lit(bits - 1)).alias("slot")).distinct()
    bit_table = np.zeros(bits >> 3, np.uint8)
    # at most bits / 8 bytes in all
    for r in slots.repartition(F.shiftright("slot", 15)).mapInArrow(_pages, "page long, bits binary").collect():
        bit_table[r["page"] << 12 : (r["page"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return prints.sparkSession.sparkContext.broadcast((lengths, bit_table))


def _may_hold(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    slot = x & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _spots(first_filter, texts: list[bytes], window: int, k: int):
    """Numbers of words, and for each text the fingerprints (pos, n, fp, before, words) that pass the first filter."""
    lengths, bits = first_filter.value
    sizes, number, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for a, b in wordhash.pieces(texts):
        hashes, counts = wordhash.words(texts[a:b], wordhash.ALPHANUMERIC)
        found, ns = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))], [np.zeros(0, np.int64)]
        for n in lengths:
            at, fp = fingerprints(hashes, counts, n, window, k)
            some = _may_hold(bits, fp)
            found.append((at[some], fp[some])), ns.append(np.full(int(some.sum()), n))
        at, fp = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        at, fp, n = at[order], fp[order], np.concatenate(ns)[order]
        doc, pos, before, words = _around(at, n, hashes, counts, window, k)
        parts.append(pa.StructArray.from_arrays([pa.array(pos, pa.int64()), pa.array(n, pa.int32()), pa.array(fp.view(np.int64)), pa.array(before, pa.int32()), words], ["pos", "n", "fp", "before", "words"]))
        sizes.append(counts), number.append(np.bincount(doc, minlength=b - a))
    kind = pa.struct([("pos", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("before", pa.int32()), ("words", pa.list_(pa.int64()))])
    places = pa.concat_arrays([pa.array([], kind), *(x.cast(kind) for x in parts)])
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(number)))).astype(np.int32)
    return pa.array(np.concatenate(sizes), pa.int64()), pa.ListArray.from_arrays(offsets, places)


_PLACES = "array<struct<pos: long, n: int, fp: long, before: int, words: array<long>>>"


def _scan(first_filter, window: int, k: int):
    """(key, n_words, spots) of each row."""

    def run(batches):
        for batch in batches:
            sizes, spots = _spots(first_filter, _texts(batch.column("text")), window, k)
            yield pa.RecordBatch.from_arrays([batch.column("key"), sizes, spots], ["key", "n_words", "spots"])

    return run


def _item_tables(items: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(item_id, n, fp, about), and (n, fp, before, words, about, names, x1, x2) of distinct fingerprints with the words around: number and hashes of the items."""
    held = materialize(
        items.select(F.col("item_id").cast("string").alias("item_id"), "text")
        .mapInArrow(_item_prints(window, k), "item_id string, n int, fp long, before int, words array<long>")
        .where("item_id IS NOT NULL")
        .withColumn("about", F.sha2(F.concat_ws(",", "n", "before", F.col("words").cast("array<string>")), 256))
        .distinct(),
        "item-prints",
    )
    prints = held.groupBy("n", "fp", "about").agg(
        F.first("before").alias("before"), F.first("words").alias("words"),
        F.count("*").alias("names"), F.bit_xor(F.xxhash64("item_id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "item_id")).alias("x2"),
    )
    return held.select("item_id", "n", "fp", "about"), materialize(prints, "prints")


def _equal(a, b):
    """How many words two lists have in common from their beginning on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def _hits(rows: DataFrame, prints: DataFrame, window: int, k: int) -> DataFrame:
    """(row, start, end, names, x1, x2): what rows(row, spots) share with items, extended about each fingerprint."""
    spots = rows.select("row", F.explode("spots").alias("s")).select("row", "s.*")
    real = spots.groupBy("n", "fp").agg(F.count("*").alias("of")).join(prints.withColumnsRenamed({"before": "i_before", "words": "i_words"}), ["n", "fp"])
    real = materialize(real, "hit-prints")
    counted = real.agg(F.sum("of"), F.count("*")).first()
    if counted[1] <= MOST_BROADCAST:
        met = join_sized(spots, real, ["n", "fp"], "of", counted[0] or 0)
    else:
        met = spots.join(real, ["n", "fp"])
    # the fingerprint itself, what follows it and what precedes it
    own = F.when(F.col("n") == window, k).otherwise(F.col("n"))
    after = lambda words, before: F.slice(words, before + 1, F.lit(2 * window))
    ahead = lambda words, before: F.reverse(F.slice(words, F.lit(1), before))
    met = met.withColumn("right", _equal(after(F.col("words"), F.col("before")), after(F.col("i_words"), F.col("i_before"))))
    met = met.withColumn("left", _equal(ahead(F.col("words"), F.col("before")), ahead(F.col("i_words"), F.col("i_before"))))
    met = met.where((F.col("right") >= own) & (F.col("left") + F.col("right") >= F.col("n")))
    return met.select("row", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"), "names", "x1", "x2")


def hit_runs(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """(key, n_words, starts, ends, items, items_sha256) for each row of docs(key long, text)."""
    held, prints = _item_tables(items, window, k)
    scan = _scan(_first_filter(prints, block_windows), window, k)
    # rows are numbered once: keys may be null or repeat
    scanned = materialize(
        docs.select("key", "text").mapInArrow(scan, f"key long, n_words long, spots {_PLACES}").withColumn("row", F.monotonically_increasing_id()), "scanned"
    )
    group = ["names", "x1", "x2"]
    # lists are bounded by the row's own words
    own = _hits(scanned.select("row", "spots"), prints, window, k).groupBy("row").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"), F.array_sort(F.collect_set(F.struct(*group))).alias("groups")
    )
    own = materialize(own.withColumn("list", F.sha2(F.to_json("groups"), 256)), "hit-rows")
    lists = own.groupBy("list").agg(F.first("groups").alias("groups"), F.count("*").alias("of"))
    one = materialize(prints.groupBy(*group).agg(F.min(F.struct("n", "fp", "about")).alias("w")).select(*group, "w.*"), "item-groups")
    total = one.agg(F.sum("names")).first()[0] or 0
    members = join_sized(held, one, ["n", "fp", "about"], "names", total).select(*group, "item_id")
    lists = lists.select("list", "of", F.explode("groups").alias("g")).select("list", "of", "g.*").join(members, group)
    lists = lists.groupBy("list", "of").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    lists = materialize(lists.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)), "item-lists")
    named = join_sized(own.drop("groups"), lists, ["list"], "of", own.count())
    none = F.array().cast("array<long>")
    return scanned.select("row", "key", "n_words").join(named, "row", "left").select(
        "key", "n_words", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    )


def without_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of docs whose text holds no window of an item, all columns kept."""
    _, prints = _item_tables(items, window, k)
    first_filter = _first_filter(prints, block_windows)
    schema = T.StructType([T.StructField("doc", docs.schema), *T.StructType.fromDDL(f"spots {_PLACES}").fields])

    def run(batches):
        for batch in batches:
            doc = batch.column("doc")
            yield pa.RecordBatch.from_arrays([doc, _spots(first_filter, _texts(doc.field("text")), window, k)[1]], ["doc", "spots"])

    scanned = docs.select(F.struct(*docs.columns).alias("doc")).mapInArrow(run, schema)
    suspects = materialize(scanned.where(F.size("spots") > 0).withColumn("row", F.monotonically_increasing_id()), "suspects")
    hit = _hits(suspects.select("row", "spots"), prints, window, k).select("row").distinct()
    clean = suspects.join(hit, "row", "left_anti")
    return scanned.where(F.size("spots") == 0).select("doc.*").unionByName(clean.select("doc.*"))


def _n_hit():
    """Number of words covered by runs that may overlap: ordered fold over (start, end)."""
    runs = F.array_sort(F.arrays_zip("starts", "ends"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(
        runs,
        zero,
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), r["ends"] - F.greatest(acc["to"], r["starts"]))).alias("n"),
            F.greatest(acc["to"], r["ends"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items: one row for each row of docs.

    docs(doc_id, text, ...), items(item_id, text, ...); other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), "text")
    runs = hit_runs(texts, items, window, k, block_windows)
    return runs.select(
        F.col("key").alias("doc_id"),
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items_sha256",
        (F.size("items") > 0).alias("contaminated"),
        "items",
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
  unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
    lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d JOIN lengths ON len(w) >= n),
hits AS (SELECT doc_id, a.n, i, item_id FROM spots a JOIN wins v ON v.n = a.n AND array_to_string(w[i:i + a.n - 1], ' ') = v.g),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
