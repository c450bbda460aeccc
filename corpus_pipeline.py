"""Corpus pipeline: toxicity, exact and near deduplication, decontamination, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which the caller writes and reads again as the next stage's
docs. All but the last return the columns of documents; extra columns of docs, under
any name, are left out. Null texts count as empty in every stage, texts are read
whole, an empty table gives an empty result, and rows with a null id are judged by
their text as others are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovec.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from chronovec.llm.common import drop, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go; without labels of both classes all stay. Repeated rows are judged alike."""
    lexicon = toxicity.learn(docs, toxicity.fold_labels(spark, sf_dir))
    return toxicity.score(docs.select(COLUMNS), lexicon).where("predicted = 0").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays; of repeated rows, one."""
    groups = materialize(exact_dedup.exact_groups(docs), "exact-groups")
    keep = groups.where("kept").select(F.col("doc_id").alias("keep"), "text_sha256")
    rows = docs.select(COLUMNS).withColumn("text_sha256", F.sha2(exact_dedup.normalized(F.col("text")), 256))
    same = rows["doc_id"].eqNullSafe(keep["keep"]) & (rows["text_sha256"] == keep["text_sha256"])
    rows = rows.join(keep, same, "left_semi")
    if groups.where("NOT kept AND doc_id <=> keep_id").take(1):
        rows = rows.dropDuplicates(["doc_id", "text_sha256"])
    return rows.select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the smallest doc_id stays; rows without an id stay."""
    docs = docs.select(COLUMNS)
    found = near_dedup.near_duplicates(docs, width=5, percent=80)
    keep = found.where("kept").select(F.col("doc_id").alias("keep")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("keep")), "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; with an empty benchmark, or no words, all stay. Repeated rows are judged alike."""
    return decontaminate.without_hits(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; an empty text has none."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", tokens),
]

#: SQL can express neither the learned lexicon nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again; a stage's table goes when the next one has been written."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if held is not None:
            drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
