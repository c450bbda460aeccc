"""Operator 2: toxicity by a weighted lexicon.

Texts are folded (lower case, compatible forms and homoglyphs to Latin letters, marks
over letters in a row dropped, single letters parted by one mark joined, digits and signs of words with a letter
to the letters they stand for, but for marks such as ! at the end; at a word's ends both
readings are matched), then one Aho-Corasick pass finds the lexicon's entries: whole words or
beginnings of words. Where a sign stands for one of several letters, the pass goes over
classes of letters, and a hit counts if each sign can be read as the entry's letter.
Entries inside an exception phrase don't count. The sum of weights, normalised by length, gives the
score through a logistic curve.

The lexicon and the curve are learned from a bounded sample of labelled rows: at
most SAMPLE of each class, those with the smallest hash of their id. Whole words of any
length and word beginnings of SHORTEST to LONGEST letters are counted in Spark; an entry is kept
if the number of documents that have it, or have it twice, separates the classes (a
G-test), and of beginnings that contain each other the one that explains most is
kept. There is no limit to the number of entries or the length of words. Folding and
matching read whole texts; scoring is one pass without a shuffle. Phrases in which a
word is harmless are a parameter, by language; a text's language is no input, so all
of them are matched.

Null or empty texts score the curve's value at no match. Labels that are null or
whose document is missing aren't used; of several labels of a doc_id the largest
counts. Each row has a score of its own, repeated rows too; texts of any length are
read whole; an empty table gives an empty result. Other columns pass through; those
named as a result, in any case, are replaced. Without a label of each class the
lexicon is empty and all documents get one score under the threshold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialize, smallest_hashes, table

SAMPLE = 6000
THRESHOLD = 0.3
#: Least gain of an entry in the G-test, in nats.
GAIN = 7.0
SHORTEST, LONGEST = 3, 64
#: Entries that a task counts before it passes them on.
HELD = 50_000
#: Phrases in which a listed word is harmless, by language.
EXCEPTIONS = {"en": ("trash can", "trash bin", "clown fish", "class clown", "pond scum", "sore loser", "not stupid", "idiot proof")}

# Look-alike letters of other scripts.
_LOOKS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "l",
    "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
}
_LOOK_TABLE = str.maketrans(_LOOKS)
_LOOK_FIND = re.compile("[" + "".join(_LOOKS) + "]").search
# Digits and signs written for letters.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
_SIGN_TABLE = str.maketrans(_SIGNS)
#: Signs that may be read as any of several letters; letters that a sign confuses are one class in the automaton.
_READINGS = {"1": "il", "!": "il", "|": "il"}
# Blocks of marks over and under letters.
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
# Letters with marks, with one plain letter at most between two of them; a single accent may be the word's own.
_ACCENTED = re.compile(rf"(?:[^\W\d_]{_MARKS.pattern}(?:[^\W\d_](?!{_MARKS.pattern}))?){{2,}}")
# Three or more single letters or digits with the same mark between them.
_PARTED = re.compile(r"(?<![^\W_])[^\W_]([.\-_*·])[^\W_](?:\1[^\W_])+(?![^\W_])")
# A run of letters, digits and signs that holds one of _SIGNS.
_SIGNED = re.compile(r"(?<![^\W_])(?<![@$!|])[^\W_0134578]*[0134578@$!|](?:[^\W_]|[@$!|])*")
_LETTER = re.compile(r"[^\W\d_]").search
_WORD = re.compile(r"[^\W\d_]+")


def _fold_signs(found: re.Match) -> str:
    token = found[0]
    if not _LETTER(token):
        return token
    body = token.rstrip("!|")  # sentence marks and rules
    return body.translate(_SIGN_TABLE) + token[len(body) :]


def _join_letters(found: re.Match) -> str:
    return found[0].replace(found[1], "") if _LETTER(found[0]) else found[0]


def readings(text: str) -> tuple[str, str]:
    """The folded text, and as long the one in which digits and signs are left."""
    if not text.isascii():
        text = _ACCENTED.sub(lambda found: _MARKS.sub("", found[0]), unicodedata.normalize("NFKD", text))
        text = unicodedata.normalize("NFC", text).lower()
        if _LOOK_FIND(text):
            text = text.translate(_LOOK_TABLE)
    else:
        text = text.lower()
    text = _PARTED.sub(_join_letters, text)
    return _SIGNED.sub(_fold_signs, text), text


def fold(text: str) -> str:
    return readings(text)[0]


def _bare(plain: str, at: int, step: int) -> bool:
    """Whether plain holds digits and signs only from `at` to the token's end in that direction."""
    while 0 <= at < len(plain) and (plain[at] in _SIGNS or plain[at].isdigit()):
        at += step
    return not (0 <= at < len(plain) and plain[at].isalpha())


def _classes(text: str) -> str:
    """Letters that a sign confuses become one."""
    return text.replace("l", "i")


def _reads(folded: str, plain: str | None, at: int, text: str) -> bool:
    """Whether text can be read at a place: letter by letter as folded, or as another reading of the sign in plain."""
    if folded.startswith(text, at):
        return True
    return plain is not None and all(
        folded[at + i] == c or c in _READINGS.get(plain[at + i], "") and folded[at + i] != plain[at + i] for i, c in enumerate(text)
    )


class Lexicon:
    """Entries (text, whole word or not, weight) and the curve's parameters."""

    def __init__(self, entries: Iterable[tuple[str, bool, float]], exceptions=EXCEPTIONS, bias=-4.0, slopes=(1.0, 1.0)):
        self.entries, self.exceptions = list(entries), tuple(fold(x) for own in exceptions.values() for x in own)
        self.bias, self.slopes = bias, slopes
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def _build(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for text, whole, weight in self.entries:
            found.setdefault(_classes(text), []).append((text, whole, weight))
        for phrase in self.exceptions:
            found.setdefault(_classes(phrase), []).append((phrase, True, None))
        for text, kinds in found.items():
            automaton.add_word(text, (len(text), kinds))
        automaton.make_automaton()
        self._automaton = automaton
        return automaton

    def weight(self, folded: str, plain: str | None = None) -> float:
        """Sum of weights; digits and signs at a word's ends count as letters or, where `plain` has them, as its limits.

        A sign of `plain` matches each letter it can be read as.
        """
        if not self.entries:
            return 0.0
        automaton = self._automaton or self._build()
        hits, spared, n = [], [], len(folded)
        for end, (size, kinds) in automaton.iter(_classes(folded)):
            start = end - size + 1
            if start and folded[start - 1].isalpha() and (plain is None or not _bare(plain, start - 1, -1)):
                continue
            closed = end + 1 == n or not folded[end + 1].isalpha() or (plain is not None and _bare(plain, end + 1, 1))
            for text, whole, weight in kinds:
                if whole and not closed or not _reads(folded, plain, start, text):
                    continue
                (spared if weight is None else hits).append((start, end, weight))
        return sum(w for s, e, w in hits if not any(a <= s and e <= b for a, b, _ in spared))

    def features(self, text: str) -> tuple[float, float]:
        """(total weight on a log scale, weight for each hundred words on a log scale)."""
        folded, plain = readings(text)
        total = self.weight(folded, plain)
        if not total:
            return 0.0, 0.0
        words = max(20, folded.count(" ") + folded.count("\n") + 1)
        return math.log1p(total), math.log1p(100 * total / words)

    def score(self, text: str) -> float:
        a, b = self.features(text)
        return 1 / (1 + math.exp(-(self.bias + self.slopes[0] * a + self.slopes[1] * b)))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of at most `sample` labelled documents of each class."""
    named = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [smallest_hashes(named.where(F.col("toxic") == c), "doc_id", sample) for c in (0, 1)]
    # at most 2 * sample ids are broadcast
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")


_COUNTS = ("bad", "good", "bad2", "good2", "times")


def _beginnings(batches):
    """Counts of word beginnings and whole words, combined over the documents of a batch.

    bad and good: toxic and other documents with the entry, bad2 and good2: those that have it twice, times: how
    often toxic ones have it.
    """
    counts: dict[str, list[int]] = {}

    def combined():
        rows = list(counts.values())
        out = [pa.array(list(counts), pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, ["entry", *_COUNTS])

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            own: dict[str, int] = {}
            for word, n in Counter(_WORD.findall(fold(text.as_py() or ""))).items():
                for size in range(SHORTEST, min(len(word), LONGEST) + 1):
                    own[word[:size]] = own.get(word[:size], 0) + n
                own[word + "$"] = own.get(word + "$", 0) + n
            for entry, n in own.items():
                known = counts.setdefault(entry, [0, 0, 0, 0, 0])
                known[0 if toxic else 1] += 1
                if n > 1:
                    known[2 if toxic else 3] += 1
                known[4] += n * toxic
            if len(counts) >= HELD:
                yield combined()
    yield combined()


def _separation(bad: str, good: str, of_bad: int, of_good: int) -> tuple[Column, Column]:
    """(gain in the G-test, log odds) of the documents counted in two columns."""
    b, g = F.col(bad), F.col(good)
    share = (b + g) / float(of_bad + of_good)
    part = lambda n, of: F.when(n > 0, n * F.log(n / (share * of))).otherwise(0.0)
    return part(b, of_bad) + part(g, of_good), F.log((b + 0.5) / (of_bad + 1.0)) - F.log((g + 0.5) / (of_good + 1.0))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions=EXCEPTIONS) -> Lexicon:
    """Lexicon and curve from labels(doc_id, toxic) of docs(doc_id, text)."""
    rows = materialize(training_rows(docs, labels, sample), "toxicity-sample")  # documents are read once for it
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Lexicon([], exceptions)
    schema = "entry string, " + ", ".join(f"{c} long" for c in _COUNTS)
    counts = rows.mapInArrow(_beginnings, schema).groupBy("entry").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    (once, odds), (twice, odds2) = _separation("bad", "good", bad, good), _separation("bad2", "good2", bad, good)
    again = (F.col("bad2") >= 3) & (twice > once)
    # what the test lets through is bounded by the sample
    best = (
        counts.where("bad >= 3")
        .withColumn("odds", F.when(again, odds2).otherwise(odds))
        .withColumn("gain", F.when(again, twice).otherwise(once))
        .where((F.col("odds") > 2) & (F.col("gain") > GAIN))
        .orderBy(F.desc("gain"), "entry")
        .collect()
    )
    lexicon = Lexicon(_choose(best), exceptions)
    # the curve: logistic regression on two features, on the same bounded sample
    def features(batches):
        for batch in batches:
            own = [lexicon.features(t.as_py() or "") for t in batch.column("text")]
            columns = [batch.column("toxic").cast(pa.int32()), *(pa.array([x[i] for x in own], pa.float64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["y", "a", "b"])

    data = rows.mapInArrow(features, "y int, a double, b double").groupBy("y", "a", "b").count().toPandas()
    weights = data["count"] * np.where(data["y"] == 1, 1.0, max(1.0, bad * 9 / good))  # as one in ten were toxic
    lexicon.bias, lexicon.slopes = _logistic(data[["a", "b"]].to_numpy(float), data["y"].to_numpy(float), weights.to_numpy(float))
    drop(rows)
    return lexicon


def _choose(rows) -> list[tuple[str, bool, float]]:
    """Entries that don't contain each other, those that explain most first."""
    by = {r["entry"]: r for r in rows}
    names = sorted(by)
    chosen: list[tuple[str, bool, float]] = []
    taken, inside = set(), set()  # chosen texts, and all their beginnings
    for r in rows:
        entry = r["entry"].removesuffix("$")
        if entry in inside or any(entry[:n] in taken for n in range(1, len(entry) + 1)):
            continue
        # the longest form that occurs nearly as often says most
        at, alike = bisect_left(names, entry), []
        while at < len(names) and names[at].startswith(entry):
            if by[names[at]]["times"] >= 0.97 * r["times"]:
                alike.append(by[names[at]])
            at += 1
        top = max(alike, key=lambda x: (len(x["entry"]), x["times"]))
        entry, whole = top["entry"].removesuffix("$"), top["entry"].endswith("$")
        chosen.append((entry, whole, top["odds"]))
        taken.add(entry)
        inside.update(entry[:n] for n in range(1, len(entry) + 1))
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0):
    """Weighted logistic regression by Newton steps; slopes stay at 0 or above."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta * (0, 1, 1)
        hess = (x.T * (w * p * (1 - p) + 1e-9)) @ x + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), (max(float(beta[1]), 0.0), max(float(beta[2]), 0.0))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those of `keep`) with score and predicted; whole texts read, equal names replaced."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    schema = T.StructType(
        [*docs.select(names).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )

    def run(batches):
        for batch in batches:
            own = [lexicon.score(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(own, pa.float64()), pa.array([int(s >= threshold) for s in own], pa.int32())],
                [*names, "score", "predicted"],
            )

    return docs.select(*names, *([] if "text" in names else ["text"])).mapInArrow(run, schema)


def held_out():
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = learn(docs, fold_labels(spark, sf_dir))
    return score(docs, lexicon, keep=["doc_id"]).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted"
    )
