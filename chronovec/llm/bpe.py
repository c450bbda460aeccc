"""Operator 1: BPE encoding and decoding with exact merges in linear time.

Encoding of a pre-token: an Aho-Corasick automaton finds every token in it. From
the left, the longest token is taken that is compatible with the one before it;
a token pair is compatible when merging the pair's bytes would end with just
these two tokens, read from the tables of merges and of how tokens split. Where
nothing fits, the last token is taken back and a shorter one tried; ends once
given up are remembered, so work stays linear in the text.

Decoding looks the bytes of all tokens up in one byte table by offsets.

The vocabulary file is read from ``path`` on each executor. Special tokens in a
text become their own ids, as the vocabulary file says. Null and empty texts have
no ids, null ids an empty text. Each row has a result of its own, repeated rows too;
an empty table gives an empty one. Texts of any length are encoded whole, in time and
memory in proportion. Other columns pass through; one named as a result, in any
case, is replaced.

A worker keeps the vocabulary for the tasks that follow; what it remembers of pre-tokens
and token pairs, as many as CACHE and PAIRS say, it gives up at the end of a task.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table

#: Pre-tokens (64 characters at most) kept with their ids in a worker, twice as many where old ones are still in
#: use, and token pairs kept with their compatibility.
CACHE, PAIRS = 60_000, 300_000
#: Code points below this are classified once, for a pattern of the standard library; other texts take the given one.
PLAIN = 0x250


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _plain_find(regex):
    """findall of the pattern of pre-tokens with its classes written out for code points below PLAIN."""
    letter, number, space = ("".join(re.escape(chr(c)) for c in range(PLAIN) if regex.match(p, chr(c))) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    ).findall


class ByteBPE:
    """Encoder and decoder of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # order: single bytes first, then merged tokens by rank
        made = {a + b: i for i, (a, b) in enumerate(merges)}
        tokens = sorted((t for t in vocab if len(t) == 1 or t in made), key=lambda t: made.get(t, -1))
        order = {t: i for i, t in enumerate(tokens)}
        self.ids = [vocab[t] for t in tokens]
        self.lengths = [len(t) for t in tokens]
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            at = order[a + b]
            self.left[at], self.right[at] = order[a], order[b]
            self.merged[order[a], order[b]] = at
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, tuple] = {}  # (order, length, entry of the longest token that it begins with)
        for t in sorted(order, key=len):
            shorter = next((entries[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in entries), None)
            entries[t] = (order[t], len(t), shorter)
            self.automaton.add_word(bytes(byte_of[c] for c in t).decode("latin-1"), entries[t])
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.plain, self.beyond = _plain_find(regex), re.compile(f"[^\0-{chr(PLAIN - 1)}]").search
        self.cache: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}  # the cache that was full last

        size = max([*vocab.values(), *self.special.values()]) + 1
        texts = [b""] * size
        for t, i in vocab.items():
            texts[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            texts[i] = t.encode()
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.decimal = [str(i) for i in range(size)]

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b ends with a, b."""
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        first, second, limit = a, b, len(self.ids)
        fits = None
        while fits is None:
            over = self.merged.get((a, b))
            if over is not None and over < limit:
                fits = False
            elif a > b:  # undo the later merge; only earlier ones can have come before it
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    fits = True if b + 1 == limit else None
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    fits = True if a == limit else None
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[first, second] = fits
        return fits

    def _merge(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token whose characters are its bytes."""
        size, known, fits = len(word), self.compatible.get, self._fits
        longest: list[tuple | None] = [None] * (size + 1)
        for end, token in self.automaton.iter(word):  # by end, so the longest token of a start comes last
            longest[end + 1 - token[1]] = token
        dead = bytearray(size + 1)
        taken: list[tuple] = []
        at, last, token = 0, -1, longest[0]
        while at < size:
            while token is not None:
                own, length, shorter = token
                if not dead[at + length]:
                    if last < 0:
                        break
                    pair = known((last, own))
                    if fits(last, own) if pair is None else pair:
                        break
                token = shorter
            else:  # no token fits here: the one before gives way to a shorter one
                dead[at] = 1
                _, length, token = taken.pop()
                last = taken[-1][0] if taken else -1
                at -= length
                continue
            taken.append(token)
            last = own
            at += length
            token = longest[at]
        ids = self.ids
        return tuple([ids[own] for own, _, _ in taken])

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.before.get(word) or self._merge(word.encode().decode("latin-1"))
        if len(word) <= 64:
            if len(self.cache) >= CACHE:
                self.before, self.cache = self.cache, {}
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        parts = self.split_special.split(text) if self.split_special else [text]
        word = self._word
        out: list[int] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part])
            elif part:
                find, get = self.find if self.beyond(part) else self.plain, self.cache.get
                out += chain.from_iterable([get(w) or word(w) for w in find(part)])
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        own = np.fromiter(ids, np.int64, len(ids))
        sizes = self.sizes[own]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.offsets[own] - ends + sizes, sizes)].tobytes()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


    def forget(self) -> None:
        """Gives up what was remembered while encoding."""
        self.cache, self.before = {}, {}
        self.compatible.clear()


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary at path, once for each worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _with_column(df: DataFrame, into: str, kind: T.DataType, values) -> DataFrame:
    """df with a column made in Arrow batches; columns of that name in any case are replaced."""
    names = [n for n in df.columns if n.lower() != into.lower()]

    def run(batches):
        for batch in batches:
            kept = [c for c, n in zip(batch.columns, batch.schema.names) if n.lower() != into.lower()]
            yield pa.RecordBatch.from_arrays([*kept, values(batch)], [*names, into])
        for own in _LOADED.values():
            own.forget()

    fields = [f for f in df.schema if f.name.lower() != into.lower()]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(into, kind)]))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "token_ids") -> DataFrame:
    """docs with the ids of its text column in a new array column."""
    at = path or default_path()

    def ids(batch):
        own = load(at)
        return pa.array([own.encode(t.as_py() or "") for t in batch.column(text)], pa.list_(pa.int32()))

    return _with_column(docs, into, T.ArrayType(T.IntegerType()), ids)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """encoded with the text of its ids column in a new string column; null ids give an empty text."""
    at = path or default_path()

    def texts(batch):
        own = load(at)
        return pa.array([own.decode(x.as_py() or []) for x in batch.column(ids)], pa.string())

    return _with_column(encoded, into, T.StringType(), texts)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs(doc_id, text): encoded, then decoded from the ids."""
    at = path or default_path()

    def run(batches):
        bpe = load(at)
        decimal = bpe.decimal.__getitem__
        for batch in batches:
            sizes, digests, decoded = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                sizes.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                raw = bpe.decode_bytes(ids)
                decoded.append(hashlib.sha256(raw.decode("utf-8", errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
