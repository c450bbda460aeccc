"""Operator 4: quality by hierarchical empirical Bayes over sites.

A logistic classifier on the whole text's words and figures of its form gives each
document's own evidence: words are hashed into BUCKETS, each with a log ratio of the
classes' documents that have it, learned on one half of the sample for the other, so
that the classifier sees ratios of texts that were not counted. Expected good documents are summed for each host and each path of a
host in grouped aggregations over all documents. A host's rate is shrunk toward
the global rate, a path's rate toward its host's, with prior strengths estimated
from the spread between sites (method of moments), so sparse sites say little. A
document's own share is taken out of its sites' sums before they are used as its
prior; the posterior adds the classifier's log odds to the path's.

The classifier is fitted on a bounded sample of labelled rows, at most SAMPLE of
each class (smallest hashes of their ids). Null texts are empty texts, texts of any
length are read whole; null hosts and paths are sites of their own. Each row has a
result of its own and counts in its site, repeated rows too; extra columns are left
out; an empty table gives an empty result. Without a label of each class all
documents get the rate 0.5.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_sized, materialize, smallest_hashes, table
from .wordhash import ALPHANUMERIC, pieces, words

SAMPLE = 4000
THRESHOLD = 0.5
#: Weight of the site's log odds beside the document's.
SITE_WEIGHT = 1.0
#: Hash buckets of words; a bucket that fewer than LEAST_DOCS of the sample have says nothing.
BUCKETS = 1 << 16
LEAST_DOCS = 3
#: Documents of either class added to a bucket's counts, at the rate of both.
PRIOR_DOCS = 5.0
_SIGNS = re.compile(r"[^\w\s.,;:'\"()?!-]")


def features(text: str) -> list[float]:
    words = text.split()
    n = max(len(words), 1)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    signs = len(_SIGNS.findall(text)) / max(len(text), 1)
    short = sum(len(x) < 40 for x in lines) / max(len(lines), 1)
    return [
        np.log1p(len(words)),
        len(set(words)) / n,
        again,
        min(again * 20, 1.0),
        signs,
        min(signs * 20, 1.0),
        sum(map(len, words)) / n / 10,
        sum(c.isdigit() for c in text) / max(len(text), 1),
        len(set(lines)) / max(len(lines), 1),
        short,
        text.count("|") / n,
        (text.count(".") + text.count(",")) / n,
        min(len(words) / 100, 1.0),
    ]


def _buckets(texts: list[bytes]):
    """(number of a text, bucket) of each text's distinct words, for some texts at a time."""
    for first, end in pieces(texts):
        hashes, n = words(texts[first:end], ALPHANUMERIC)
        own = np.unique((np.repeat(np.arange(end - first), n) << 16) | (hashes >> np.uint64(48)).astype(np.int64))
        yield first + (own >> 16), own & (BUCKETS - 1)


def _word_features(texts: list[bytes], ratios: np.ndarray) -> np.ndarray:
    """Of a text's distinct words: mean log ratio, sum over the root of their number, shares that speak clearly for or against."""
    out = np.zeros((len(texts), 4))
    for text, bucket in _buckets(texts):
        own = ratios[bucket]
        n = np.maximum(np.bincount(text, minlength=len(texts)), 1)
        total = np.bincount(text, own, len(texts))
        out += np.column_stack([total / n, total / np.sqrt(n), np.bincount(text, own > 1, len(texts)) / n, np.bincount(text, own < -1, len(texts)) / n])
    return out


def _ratios(docs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log ratio of a bucket's rate among good and bad documents; docs: class, bucket; size: documents of each class."""
    rate = docs.sum(0) / max(size.sum(), 1)
    share = (docs + PRIOR_DOCS * rate) / (size[:, None] + PRIOR_DOCS)
    known = docs.sum(0) >= LEAST_DOCS
    return np.where(known, np.log(np.where(known, share[1], 1)) - np.log(np.where(known, share[0], 1)), 0.0)


class Classifier:
    """Logistic regression on standardised features and their squares; ratios are those of the words' buckets."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ratios: np.ndarray, ridge: float = 1.0):
        self.ratios = ratios
        x = np.concatenate([x, x * x], axis=1)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        beta, penalty = np.zeros(z.shape[1]), ridge * np.r_[1e-6, np.ones(z.shape[1] - 1)]
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z.T * (w * p * (1 - p) + 1e-9)) @ z + np.diag(penalty), z.T @ (w * (p - y)) + penalty * beta)
            beta -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-7:
                break
        self.beta = beta

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        x = _matrix(texts, self.ratios)
        x = np.concatenate([x, x * x], axis=1)
        return np.clip(np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.beta, -12, 12)


def _matrix(texts, ratios: np.ndarray) -> np.ndarray:
    texts = [t or "" for t in texts]
    return np.column_stack([np.array([features(t) for t in texts], float), _word_features([t.encode() for t in texts], ratios)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """A classifier from labels(doc_id, quality) of docs(doc_id, text).

    An id that several rows share gives one text, that of the smallest hash, so that no id, however often it stands, makes
    the sample larger than its ids.
    """
    named = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    picked = [smallest_hashes(named.where(F.col("y") == c), "doc_id", sample) for c in (0, 1)]
    # at most 2 * sample ids are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).cast("int")  # copies are in one half
    rows = materialize(rows.select("text", F.col("y").cast("int").alias("y"), half.alias("half")), "quality-sample")
    size = np.zeros((2, 2))
    for r in rows.groupBy("half", "y").count().collect():
        size[r["half"], r["y"]] = r["count"]
    if not size.sum(0).all():
        return None

    def count(batches):
        for batch in batches:
            texts, group = [(t.as_py() or "").encode() for t in batch.column("text")], 2 * np.asarray(batch.column("half")) + np.asarray(batch.column("y"))
            for text, bucket in _buckets(texts):
                own, n = np.unique(group[text] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(n.astype(np.int64))], ["own", "docs"])

    # at most four counts a bucket
    found = rows.mapInArrow(count, "own long, docs long").groupBy("own").agg(F.sum("docs").alias("docs")).toPandas()
    docs_of = np.zeros(4 * BUCKETS)
    docs_of[found["own"].to_numpy(int)] = found["docs"]
    docs_of = docs_of.reshape(2, 2, BUCKETS)
    crossed = [_ratios(docs_of[1 - h], size[1 - h]) for h in (0, 1)]

    def run(frames):
        for frame in frames:
            for h in (0, 1):
                own = frame[frame["half"] == h]
                if len(own):
                    yield pd.DataFrame({"y": own["y"].astype("int32"), "x": list(_matrix(own["text"], crossed[h]))})

    data = rows.mapInPandas(run, "y int, x array<double>").toPandas()
    drop(rows)
    return Classifier(np.stack(data["x"].to_numpy()), data["y"].to_numpy(float), _ratios(docs_of.sum(0), size.sum(0)))


def _strength(sites: DataFrame, rate: str) -> float:
    """Prior strength of a level by the method of moments: small spread between sites, strong prior."""
    own = F.col("good") / F.col("n")
    within = F.col(rate) * (1 - F.col(rate))
    row = sites.where("n > 1").agg(
        F.sum(F.col("n") * F.pow(own - F.col(rate), 2)).alias("between"), F.sum(within).alias("noise"),
        F.sum(F.col("n")).alias("n"), F.sum(F.col("n") * within).alias("all"),
    ).first()
    if not row or not row["n"]:
        return 100.0
    spread = max((row["between"] - row["noise"]) / row["n"], 1e-6)
    return float(min(max((row["all"] / row["n"]) / spread - 1, 1.0), 1e5))


def posteriors(docs: DataFrame, classifier: Classifier | None, site_weight: float = SITE_WEIGHT) -> DataFrame:
    """docs(doc_id, text, host, path) with evidence, host_rate, path_rate and score."""

    def run(batches):
        for batch in batches:
            odds = np.zeros(batch.num_rows)
            if classifier is not None and batch.num_rows:
                odds = classifier.log_odds(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "host", "path")), pa.array(odds)], ["doc_id", "host", "path", "odds"])

    site = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in ("host", "path")]
    rows = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *site).mapInArrow(run, "doc_id long, host string, path string, odds double"),
        "evidence",
    ).withColumn("evidence", 1 / (1 + F.exp(-F.col("odds"))))
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    total = whole["n"] or 0
    mean = min(max((whole["good"] or 0.0) / max(total, 1), 1e-4), 1 - 1e-4) if total else 0.5
    k_host = _strength(hosts.withColumn("rate", F.lit(mean)), "rate")
    hosts = hosts.withColumn("rate", (F.col("good") + k_host * mean) / (F.col("n") + k_host))
    levels = paths.join(hosts.select("host", F.col("rate")), "host")
    k_path = _strength(levels, "rate")
    hosts = materialize(hosts.select("host", F.col("n").alias("n_host"), F.col("good").alias("good_host")), "hosts")
    joined = join_sized(rows, hosts, ["host"], "n_host", total)
    joined = join_sized(joined, paths.withColumnsRenamed({"n": "n_path", "good": "good_path"}), ["host", "path"], "n_path", total)
    own = F.col("evidence")
    host_rate = (F.col("good_host") - own + k_host * mean) / (F.col("n_host") - 1 + k_host)
    path_rate = (F.col("good_path") - own + k_path * F.col("host_rate")) / (F.col("n_path") - 1 + k_path)

    def logit(c):
        c = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(c / (1 - c))

    return (
        joined.withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("score", 1 / (1 + F.exp(-(F.col("odds") + site_weight * (logit(F.col("path_rate")) - logit(F.lit(mean)))))))
        .select("doc_id", "evidence", "host_rate", "path_rate", "score")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; host is the source, path its language section; one row in four is held out from learning."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path")
    )
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    classifier = fit(docs, table(spark, sf_dir, "labels").where(~held))
    return posteriors(docs, classifier).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= THRESHOLD).alias("kept"),
    )
