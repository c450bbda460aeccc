"""Operator 12: alignment of the tokens of two tokenizers by merge-path partitioning.

A text's tokens are known by the byte offsets where they end. Both sorted lists of
ends, of all texts of a batch one behind the other, are merged: the merge is a path
through the grid of A and B ends, and a binary search on each of its diagonals at
equal distances finds where the path crosses it. Between two crossings lies a piece of
equal work that depends on no other; all pieces advance together, a step of each at
once. A step takes the next end and emits the overlap of the A and the B token that
are open there; where both end, a group closes. Groups that cross a piece's boundary
are stitched: a piece's groups are numbered behind those of the pieces before it.

A group's links are all its pairs of an A and a B token. How many documents hold an
id pair linked is counted in tasks first, then by pair. Pairs are looked up among the
commonest, of which at most COMMON are broadcast, 13 bytes each; the pairs left are
rarer than these, each in few documents, and are joined with their counts. A pair is
one number: its A id shifted left by 15 bits, with its B id.

Null and empty texts, and those whose tokens' bytes don't give the text back, have no
tokens. Repeated rows count each as a document; null doc_ids stay null. Whole texts of
any length are aligned, in memory in proportion to text and distinct pairs. Columns
besides doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, wordhash
from .common import materialize, table

#: Steps of a piece of the merge.
PIECE = 128
#: Pairs that are broadcast with their counts.
COMMON = 1 << 20
#: Bits of a B id in a pair.
B_BITS = 15
#: Links made at once, and distinct pairs that a counting task holds.
_LINKS, _HELD = 1 << 21, 1 << 22
#: Runs from this length on are split by the encoder of operator 1, in linear time.
_LONG_RUN = re.compile(r"\s{2000}|\S{2000}")


class Tokenizers:
    """Tokenizer A, byte-level, on a space and the text, and B, of pieces, which adds that space itself."""

    def __init__(self, a_path: str, a_ranks: str, b_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(a_ranks, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain = bpe.ByteBPE(a_path)
        self.plain.split_special = None  # special tokens in a text are plain text
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        ids = lambda t, end: [f"{i}{end}".encode() for i in range(len(t))]
        # what stands behind an A and a B id in a written alignment: another of its kind, or the last
        self.written = [*ids(self.a_bytes, ","), *ids(self.a_bytes, "|"), *ids(self.b_bytes, ","), *ids(self.b_bytes, ";")]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = []
        for text in texts:
            own = " " + text
            a.append(self.plain.encode(own) if _LONG_RUN.search(own) else self.fast(own))
        return a, self.b.encode(texts, num_threads=1)


_LOADED: dict[tuple, Tokenizers] = {}


def load(*paths: str) -> Tokenizers:
    """The tokenizers of these files, once for each worker."""
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers(*paths)
    return _LOADED[paths]


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return tuple(public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of a come among the first d of the merge of a and b, for each d; equal ends of a come first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        from_a = np.zeros(len(low), bool)
        at = np.flatnonzero(open_)
        from_a[at] = a[middle[at]] <= b[diagonals[at] - middle[at] - 1]
        low, high = np.where(open_ & from_a, middle + 1, low), np.where(open_ & ~from_a, middle, high)
    return low


def merge_groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of the tokens that end at a and at b, and the overlaps (A token, B token) as a table of two columns.

    a and b increase strictly and have the same last end.
    """
    total = len(a) + len(b)
    starts = np.arange(0, total, piece)
    i = crossings(a, b, starts)
    j = starts - i
    size = len(starts)
    far = np.int64(1) << np.int64(62)
    a, b = np.append(a, far), np.append(b, far)
    of_a, of_b = np.zeros(len(a) - 1, np.int64), np.zeros(len(b) - 1, np.int64)
    closed, overlaps = np.zeros(size, np.int64), []
    taken: list[tuple] = []  # (tokens of a, groups in their piece, pieces), and the same of b
    pieces = np.arange(size)
    for step in range(min(piece, total)):
        if step == total - starts[-1]:  # the last piece may be shorter
            pieces = pieces[:-1]
            i, j, closed_now = i[:-1], j[:-1], closed[:-1]
            if not len(pieces):
                break
        else:
            closed_now = closed[: len(pieces)]
        from_a = a[i] <= b[j]
        both = ~from_a & (i > 0) & (b[j] == a[i - 1])
        taken.append((i[from_a], closed_now[from_a], pieces[from_a], j[~from_a], closed_now[~from_a], pieces[~from_a]))
        overlaps.append(np.stack([i, j], 1)[~both])
        closed[: len(pieces)] += both
        i, j = i + from_a, j + ~from_a
    before = np.cumsum(closed) - closed
    for at_a, own_a, in_a, at_b, own_b, in_b in taken:
        of_a[at_a] = own_a + before[in_a]
        of_b[at_b] = own_b + before[in_b]
    return of_a, of_b, np.concatenate(overlaps) if overlaps else np.zeros((0, 2), np.int64)


def _pairs(a_ids, b_ids, doc, a_from, a_size, b_from, b_size):
    """(document and pair as one number, times): the links of groups, equal ones added up."""

    def added(keys, times):
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(times, first) if len(first) else times

    links = a_size * b_size
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(links <= _LINKS)
    blocks = np.cumsum(links[small]) // _LINKS
    for block in np.split(small, np.flatnonzero(np.diff(blocks)) + 1):
        n = links[block]
        owner = np.repeat(np.arange(len(block)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, second = at // b_size[block][owner], at % b_size[block][owner]
        pair = (a_ids[a_from[block][owner] + first] << B_BITS) | b_ids[b_from[block][owner] + second]
        own, count = np.unique((doc[block][owner] << 31) | pair, return_counts=True)
        keys.append(own), times.append(count)
    for g in np.flatnonzero(links > _LINKS):  # one text without a common end for long: distinct ids first
        x, nx = np.unique(a_ids[a_from[g] : a_from[g] + a_size[g]], return_counts=True)
        y, ny = np.unique(b_ids[b_from[g] : b_from[g] + b_size[g]], return_counts=True)
        keys.append(((doc[g] << 31) | (x[:, None] << B_BITS) | y).ravel()), times.append((nx[:, None] * ny).ravel())
    return added(keys, times)


def _empty(size: int) -> dict[str, np.ndarray]:
    return {c: np.zeros(size, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}


def align_texts(own: Tokenizers, texts: list[str]) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and written groups of texts, and their pairs: numbers of pairs by text, pairs, times."""
    sizes, written = _empty(len(texts)), [b""] * len(texts)
    a_all, b_all = own.encode(texts)
    held = []
    for k, (text, a, b) in enumerate(zip(texts, a_all, b_all)):
        raw = b" " + text.encode()
        if text and b"".join(map(own.a_bytes.__getitem__, a)) == raw and b"".join(map(own.b_bytes.__getitem__, b)) == raw:
            held.append(k)
    if not held:
        return sizes, written, np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_n, b_n = (np.array([len(x[k]) for k in held]) for x in (a_all, b_all))
    a_ids, b_ids = (np.concatenate([np.array(x[k], np.int64) for k in held]) for x in (a_all, b_all))
    of_a, of_b, _ = merge_groups(np.cumsum(own.a_sizes[a_ids]), np.cumsum(own.b_sizes[b_ids]))

    # groups never reach over a text's end, as both tokenizers end there
    a_size, b_size = np.bincount(of_a), np.bincount(of_b)
    a_to, b_to = np.cumsum(a_size), np.cumsum(b_size)
    a_from, b_from = a_to - a_size, b_to - b_size
    doc = np.repeat(np.array(held), a_n)[a_from]
    sizes["n_a"][held], sizes["n_b"][held] = a_n, b_n
    sizes["n_groups"] += np.bincount(doc, minlength=len(texts))
    np.add.at(sizes["n_links"], doc, a_size * b_size)

    # written: A tokens of a group stand behind the B tokens of the groups before it, its B tokens behind its A tokens
    codes = np.zeros(len(a_ids) + len(b_ids), np.int64)
    width, other = len(own.a_bytes), len(own.b_bytes)
    ends_a, ends_b = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    ends_a[a_to - 1] = ends_b[b_to - 1] = True
    codes[np.arange(len(a_ids)) + b_from[of_a]] = a_ids + width * ends_a
    codes[np.arange(len(b_ids)) + a_to[of_b]] = b_ids + 2 * width + other * ends_b
    for k, part in zip(held, np.split(codes, np.cumsum(a_n + b_n)[:-1])):
        written[k] = b"".join(map(own.written.__getitem__, part.tolist()))[:-1]

    keys, times = _pairs(a_ids, b_ids, doc, a_from, a_size, b_from, b_size)
    return sizes, written, np.bincount(keys >> 31, minlength=len(texts)), keys & ((1 << 31) - 1), times


def _lists(numbers: list[np.ndarray], values: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(numbers or [np.zeros(0, np.int64)]))])
    flat = np.concatenate(values or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _texts(batch):
    texts = [t or "" for t in batch.column("text").to_pylist()]
    for a, b in wordhash.pieces([t.encode() for t in texts], 1 << 19):
        yield texts[a:b]


def aligned(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs linked with how often, of docs(doc_id, text)."""
    at = paths or default_paths()
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches):
        own = load(*at)
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                sizes, digests, numbers, keys, times = {n: [np.zeros(0, np.int64)] for n in names}, [], [], [], []
                for texts in _texts(batch):
                    counts, written, n, key, time = align_texts(own, texts)
                    for name in names:
                        sizes[name].append(counts[name])
                    digests += [hashlib.sha256(w).hexdigest() if w else "" for w in written]
                    numbers.append(n), keys.append(key), times.append(time)
                columns = [batch.column("doc_id").cast(pa.int64()), *(pa.array(np.concatenate(sizes[n]), pa.int64()) for n in names), pa.array(digests, pa.string())]
                lists = [_lists(numbers, keys, pa.int32()), _lists(numbers, times, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *lists], ["doc_id", *names, "groups_sha256", "pairs", "times"])
        own.plain.forget()

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def alignments(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, groups of docs(doc_id, text); a group has the places of its first tokens and its numbers of tokens.

    Texts without tokens have empty lists.
    """
    at = paths or default_paths()

    def run(batches):
        own = load(*at)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                (a,), (b,) = own.encode([text or ""])
                raw = b" " + (text or "").encode()
                row = {"a_ids": [], "b_ids": [], "groups": []}
                if text and b"".join(own.a_bytes[i] for i in a) == raw == b"".join(own.b_bytes[i] for i in b):
                    of_a, of_b, _ = merge_groups(*(np.cumsum(s[np.array(x)]) for s, x in ((own.a_sizes, a), (own.b_sizes, b))))
                    n_a, n_b = np.bincount(of_a), np.bincount(of_b)
                    parts = zip((np.cumsum(n_a) - n_a).tolist(), n_a.tolist(), (np.cumsum(n_b) - n_b).tolist(), n_b.tolist())
                    row = {"a_ids": a, "b_ids": b, "groups": [dict(zip(("a_from", "a_size", "b_from", "b_size"), p)) for p in parts]}
                out.append(row)
            group = pa.struct([(n, pa.int32()) for n in ("a_from", "a_size", "b_from", "b_size")])
            kinds = {"a_ids": pa.list_(pa.int32()), "b_ids": pa.list_(pa.int32()), "groups": pa.list_(group)}
            columns = [pa.array([r[n] for r in out], kind) for n, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *kinds])
        own.plain.forget()

    schema = "doc_id long, a_ids array<int>, b_ids array<int>, groups array<struct<a_from:int,a_size:int,b_from:int,b_size:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of held(pairs) a pair is, and whether no pair of its A id is in more."""

    def run(batches):
        keys, counts, fresh = np.zeros(0, np.int32), np.zeros(0, np.int64), []

        def added():
            own, n = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (keys[:0], counts[:0])
            every, place = np.unique(np.concatenate([keys, own]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, place, np.concatenate([counts, n]))
            return every, total

        size = 0
        for batch in batches:
            fresh.append(batch.column("pairs").flatten().to_numpy(zero_copy_only=False).astype(np.int32))
            size += len(fresh[-1])
            if size > _HELD:
                keys, counts = added()
                fresh, size = [], 0
                if len(keys) > _HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = added()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    counted = held.select("pairs").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "pair-counts")
    a_id = F.shiftright("pair", B_BITS)
    # one row for each A id
    most = counted.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    return materialize(counted.withColumn("a_id", a_id).join(F.broadcast(most), "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _level(counts: DataFrame, common: int) -> int:
    """The least count, a power of 2, that at most `common` pairs have or exceed; one row a power is collected."""
    levels = {r["level"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect()}
    level = max(levels, default=-1) + 1
    while level and common >= levels.get(level - 1, 0):
        level -= 1
        common -= levels.get(level, 0)
    return 1 << level


def weigh(held: DataFrame, counts: DataFrame, common: int = COMMON) -> DataFrame:
    """held with n_best and count_sum, from pair_counts; `common` bounds the counts that are broadcast."""
    spark = held.sparkSession
    least = _level(counts, common)
    known = counts.where(F.col("n") >= least).orderBy("pair").toArrow()  # at most `common` rows
    own = tuple(known.column(c).to_numpy() for c in ("pair", "n", "best"))
    shared = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(x) for x in own))

    def run(batches):
        keys, counted, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            sizes = np.asarray(pairs.value_lengths(), np.int64)
            pair, time = (x.flatten().to_numpy(zero_copy_only=False) for x in (pairs, times))
            place = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
            place = np.where(known, place, 0)
            n = np.where(known, counted[place] if len(keys) else 0, 0) * time.astype(np.int64)
            top = np.where(known & (best[place] if len(keys) else False), time, 0).astype(np.int64)
            ends = np.cumsum(sizes)
            sums = [np.diff(np.append(0, np.append(0, np.cumsum(x))[ends])) for x in (top, n)]
            owner = np.repeat(np.arange(len(sizes)), sizes)[~known]
            left = [np.bincount(owner, minlength=len(sizes))]
            columns = [batch.column("_row"), *map(pa.array, sums), _lists(left, [pair[~known]], pa.int32()), _lists(left, [time[~known]], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "n_best", "count_sum", "pairs", "times"])

    seen = held.select("_row", "pairs", "times").mapInArrow(run, "_row long, n_best long, count_sum long, pairs array<int>, times array<int>")
    sums = seen.select("_row", "n_best", "count_sum")
    if least > 1:
        seen = materialize(seen, "pairs-seen")
        left = seen.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        # no pair left is in `least` rows or more
        rare = left.join(counts.where(F.col("n") < least), "pair").groupBy("_row")
        rare = rare.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        sums = seen.select("_row", "n_best", "count_sum").unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return held.drop("pairs", "times").join(sums, "_row").drop("_row")


def token_alignment(docs: DataFrame, paths: tuple[str, str, str] | None = None, common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs(doc_id, text)."""
    held = materialize(aligned(docs, paths).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    found = weigh(held, pair_counts(held), common)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))
