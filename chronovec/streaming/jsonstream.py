"""JSON objects of a byte stream without framing, cut anywhere."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

_OPEN, _CLOSE, _QUOTE, _ESCAPE = b"{["[0], b"}]", b'"'[0], b"\\"[0]


def split_objects(rest: bytes, data: bytes) -> tuple[list[bytes], bytes]:
    """Whole top-level objects and lists of a stream, and the open rest behind them.

    Only brackets outside strings count, so cuts inside strings, escapes and characters of several bytes do no harm: all
    signs of the grammar are single bytes that stand in no longer character. Bytes between objects are skipped.
    """
    buffer = rest + data
    found: list[bytes] = []
    depth, inside, escaped, start, end = 0, False, False, 0, 0
    for at, c in enumerate(buffer):
        if inside:
            if escaped:
                escaped = False
            elif c == _ESCAPE:
                escaped = True
            elif c == _QUOTE:
                inside = False
        elif depth and c == _QUOTE:
            inside = True
        elif c in b"{[":
            if not depth:
                start = at
            depth += 1
        elif depth and c in _CLOSE:
            depth -= 1
            if not depth:
                found.append(buffer[start : at + 1])
                end = at + 1
    return found, buffer[start:] if depth else b""


def _text(raw: bytes) -> str | None:
    """An object's text, or null where it is no JSON object."""
    text = raw.decode("utf-8", errors="replace")
    try:
        return text if isinstance(json.loads(text), dict) else None
    except ValueError:
        return None


def json_objects(chunks: DataFrame) -> DataFrame:
    """(source, seq, nth, message): the JSON objects of a stream of chunks(source, seq, data), batch or stream.

    An object may begin in one chunk and end in a later one: the open rest is the source's state. seq is the chunk that
    completes an object, nth its place there. Lists and broken objects between are left out. Chunks arrive in order of seq,
    within a batch they are sorted; null chunks count as empty.
    """

    def take(key, rows: pd.DataFrame, rest: bytes) -> tuple[pd.DataFrame, bytes]:
        out = []
        for row in rows.sort_values("seq", kind="stable").itertuples():
            raw, rest = split_objects(rest, row.data or b"")
            texts = [t for t in map(_text, raw) if t is not None]
            out += [(key[0], row.seq, n, t) for n, t in enumerate(texts)]
        return pd.DataFrame(out, columns=["source", "seq", "nth", "message"]), rest

    source, seq = chunks.schema["source"].dataType.simpleString(), chunks.schema["seq"].dataType.simpleString()
    schema = f"source {source}, seq {seq}, nth int, message string"
    own = chunks.select("source", "seq", "data").groupBy("source")
    if not chunks.isStreaming:
        return own.applyInPandas(lambda key, rows: take(key, rows, b"")[0], schema)

    def run(key, batches, state):
        found, rest = take(key, pd.concat(batches), state.get[0] if state.exists else b"")
        state.update((rest,))
        yield found

    return own.applyInPandasWithState(run, schema, "rest binary", "append", GroupStateTimeout.NoTimeout)
