"""Operator 10: main text of HTML pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks, the runs of text between block-level
tags, each with its path of tags and class names. A block's vector joins the mean
of random vectors of the path's hashed parts, the mean of random vectors of its
hashed words, and a few numbers (length, links, signs, place). A bidirectional
LSTM in numpy reads the whole sequence of a page, so each label depends on all
blocks; the blocks labelled as main text are joined in page order.

The labeller is trained here, on a bounded sample of pages (SAMPLE_PAGES with the
smallest hash of their id that hold article or main, of MOST_HTML characters and
TRAIN_BLOCKS blocks at most), whose labels come from semantic markup: blocks inside
article or main that lie in no navigation, header, footer, aside, form or advert
count as main text. So that words, lengths, links and neighbours are learned and not
the names of tags, each page is seen in several ways: as it is, without any path, and
with its tags renamed and its class names changed or left out, alike over the page.
Pages are labelled in batches of similar length. Where no sampled page has such
markup nothing can be learned; the labeller then is None, and a block counts as main
text if at most half of it is links and it has at least FALLBACK_WORDS words.

Null or empty html gives an empty text. Character references are decoded, scripts,
styles and comments skipped; truncated markup ends the page, and a tag whose quote is
never closed ends at its first >. A page is read in time in proportion to its length,
whatever is left open in it: ends that are missing are looked for once, and a path's
vector is its parent's with the parts of one more tag. Each row has a result of its own, repeated rows too; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import smallest_hashes, table

SAMPLE_PAGES, TRAIN_BLOCKS, MOST_HTML = 240, 400, 160_000
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 24, 12, 6, 16
#: Words of a block of main text where there is no labeller.
FALLBACK_WORDS = 8

_RAW = re.compile(r"<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>", re.I)  # its contents are no text
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe textarea title".split()}
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
_BODY = re.compile(r"""((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>""")  # what follows the name in a tag with whole quotes
_LOOSE = re.compile(r"[^<>]*+>")  # in one whose quotes don't match
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_NEUTRAL = ("div", "div", "div", "section", "main", "article", "td", "center", "span")
_BOILER_TAGS = frozenset("nav header footer aside form button select menu dialog".split())
_BOILER_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav\w*|breadcrumbs?|sidebar|side|footer|foot|header|head|masthead|cookies?|consent|notice|popup|modal|comments?|reply|respond|disqus|related|share|social|newsletter|subscribe|form|login|widget)(?:$|[-_\s])",
    re.I,
)


class _Quotes:
    """Ends of tags that have < inside a quote: from each > or quote that stands in no quote, the next > in none."""

    def __init__(self, page: str):
        marks = [(m.start(), m[0]) for m in re.finditer("[>\"']", page)]
        self.at = [i for i, _ in marks]
        self.end = [-1] * (len(marks) + 1)
        same = {'"': -1, "'": -1}  # the next quote of a kind
        for k in range(len(marks) - 1, -1, -1):
            at, c = marks[k]
            if c == ">":
                self.end[k] = at
            else:
                self.end[k] = self.end[same[c] + 1] if same[c] >= 0 else -1
                same[c] = k

    def after(self, at: int) -> int:
        return self.end[bisect_left(self.at, at)]


def tags(page: str):
    """(start, end, closing, name, attributes) of each piece of markup; comments, declarations and contents that are no text have no name."""
    last, final, size = page.rfind(">"), page.rfind("<"), len(page)
    quotes = None
    at = page.find("<")
    while at >= 0:
        end, closing, name, rest = -1, "", "", ""
        sign = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = size if end < 0 else end + 3
        elif sign in ("!", "?"):
            end = page.find(">", at) + 1 if at < last else -1
        elif named := _NAME.match(page, at):
            if at < last:  # else no tag can end any more
                if raw := _RAW.match(page, at):
                    found = _RAW_END[raw[1].lower()].search(page, raw.end())
                    end = found.end() if found else size
                else:
                    closing, name = named[1], named[2].lower()
                    if body := _BODY.match(page, named.end()):
                        end, rest = body.end(), body[1]
                    elif body := _LOOSE.match(page, named.end()):
                        end = body.end()
                    else:
                        quotes = quotes or _Quotes(page)
                        stop = quotes.after(named.end())
                        if stop >= 0:
                            end, rest = stop + 1, page[named.end() : stop]
                        else:
                            name = ""
        if end < 0 and at == final and at > last and (sign == "/" or sign.isascii() and sign.isalpha()):
            end = size  # markup that breaks off
        if end >= 0:
            yield at, end, closing, name, rest
        at = page.find("<", end if end >= 0 else at + 1)


class Path:
    """A block's open block-level tags and their class names: a parent and the parts of the innermost tag."""

    __slots__ = ("parent", "parts", "last", "count", "sums")

    def __init__(self, parent: "Path | None", parts: tuple[str, ...]):
        self.parent, self.parts = parent, parts
        self.last = parts[-1] if parts else parent.last if parent else ""
        self.count, self.sums = 0, None

    def __iter__(self):
        """All parts, from the outermost."""
        chain, own = [], self
        while own is not None:
            chain.append(own.parts)
            own = own.parent
        return (part for parts in reversed(chain) for part in parts)


_KNOWN: dict[tuple, Path] = {}


def _path(parent: Path | None, parts: tuple[str, ...]) -> Path:
    known = _KNOWN.get((parent, parts))
    if known is None:
        if len(_KNOWN) > 50_000:
            _KNOWN.clear()
        known = _KNOWN[parent, parts] = Path(parent, parts)
    return known


def blocks(page: str) -> list[tuple[Path | None, str, int, int]]:
    """(path, text, characters in links, is main text by its markup: 1, 0 or -1 unknown) of each leaf block."""
    out: list = []
    stack: list[tuple[str, int]] = []  # tag, what the markup says of its text
    walls: list[int] = []  # where block-level tags are in the stack
    paths: list[Path] = []  # theirs
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    at = 0

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            out.append((paths[-1] if paths else None, text, linked, stack[-1][1] if stack else -1))
        parts.clear()
        linked = 0

    def cut(n: int):
        for tag, _ in stack[n:]:
            opened[tag] -= 1
        del stack[n:]
        while walls and walls[-1] >= n:
            walls.pop(), paths.pop()

    for start, end, closing, tag, rest in tags(page):
        if start > at:
            text = page[at:start]
            parts.append(text)
            if opened.get("a"):
                linked += len(text)
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in _INLINE:
            flush()
        if closing:
            if opened.get(tag):
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in _CLOSES_P and walls and stack[walls[-1]][0] == "p":  # an open paragraph ends, with what is open in it
            cut(walls[-1])
        if tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            cut(len(stack) - 1)
        if tag not in _VOID and not rest.endswith("/"):
            names = [f".{x}" for c in _CLASS.findall(rest) for x in "".join(c).lower().split()] if rest else []
            main = stack[-1][1] if stack else -1
            if tag in _BOILER_TAGS or names and _BOILER_NAMES.search(" ".join(names).replace(".", " ")):
                main = 0
            elif main and tag in ("article", "main"):
                main = 1
            if tag not in _INLINE:
                walls.append(len(stack))
                paths.append(_path(paths[-1] if paths else None, (tag, *names)))
            stack.append((tag, main))
            opened[tag] = opened.get(tag, 0) + 1
    parts.append(page[at:])
    flush()
    return out


def _renamed(page: list, rng: np.random.Generator) -> list:
    """A page's blocks with tags renamed and class names changed or left out, alike over the page."""
    names: dict[str, str] = {}

    def other(part: str) -> str:
        if part not in names:
            if part.startswith("."):
                names[part] = f".{rng.integers(1 << 20):x}" if rng.random() < 0.5 else ""
            else:
                names[part] = str(rng.choice(_NEUTRAL)) if rng.random() < 0.7 else part
        return names[part]

    made: dict[Path | None, Path | None] = {None: None}

    def renamed(path: Path | None) -> Path | None:
        chain = []
        while path not in made:
            chain.append(path)
            path = path.parent
        for own in reversed(chain):
            made[own] = Path(made[own.parent], tuple(filter(None, map(other, own.parts))))
        return made[chain[0] if chain else path]

    return [(renamed(path), *rest) for path, *rest in page]


def _table(rows: int, dim: int, seed: int) -> np.ndarray:
    return (np.random.default_rng(seed).standard_normal((rows, dim)) / np.sqrt(dim) * 2).astype(np.float32)


_PATHS, _WORDS = _table(4096, PATH_DIM, 1), _table(4096, WORD_DIM, 2)


def _path_vector(path: Path | None) -> np.ndarray:
    """Mean of the vectors of a path's parts and of pairs of neighbours; sums are kept with each path."""
    chain, own = [], path
    while own is not None and own.sums is None:
        chain.append(own)
        own = own.parent
    for own in reversed(chain):
        before = own.parent
        sums, count, last = (before.sums, before.count, before.last) if before is not None else (0.0, 0, "")
        for part in own.parts:
            found = [part, f"{last}>{part}"] if count else [part]
            sums = sums + _PATHS[[zlib.crc32(p.encode()) & 4095 for p in found]].sum(0, dtype=np.float64)
            count, last = count + len(found), part
        own.sums, own.count = sums, count
    if path is None or not path.count:
        return _PATHS[zlib.crc32(b"") & 4095]
    return path.sums / np.sqrt(path.count)


def vectors(page_blocks: list[list]) -> list[np.ndarray]:
    """The input sequence of each page."""
    flat = [b for page in page_blocks for b in page]
    if not flat:
        return [np.zeros((0, PATH_DIM + WORD_DIM + NUMBERS), np.float32) for _ in page_blocks]
    texts = [b[1].encode() for b in flat]
    words = np.zeros((len(flat), WORD_DIM), np.float32)
    counts = np.zeros(len(flat), np.int64)
    for a, b in wordhash.pieces(texts):
        hashes, own = wordhash.words(texts[a:b], wordhash.BY_SPACE)
        sums = np.concatenate((np.zeros((1, WORD_DIM)), np.cumsum(_WORDS[(hashes & np.uint64(4095)).astype(np.int64)], axis=0, dtype=np.float64)))
        ends = np.cumsum(own)
        words[a:b] = (sums[ends] - sums[ends - own]) / np.maximum(own, 1)[:, None]
        counts[a:b] = own
    size = np.array([len(b[1]) for b in flat], np.float32)
    numbers = np.zeros((len(flat), NUMBERS), np.float32)
    numbers[:, 0] = np.log1p(counts) / 3
    numbers[:, 1] = np.array([min(b[2], len(b[1])) for b in flat]) / size
    numbers[:, 2] = np.array([b[1].count(".") + b[1].count(",") for b in flat]) / np.maximum(counts, 1)
    numbers[:, 3] = size / np.maximum(counts, 1) / 10
    paths = np.stack([_path_vector(b[0]) for b in flat])
    every = np.concatenate([paths, words, numbers], axis=1).astype(np.float32)
    out, at = [], 0
    for page in page_blocks:
        own = every[at : at + len(page)]
        if len(page):
            own[:, -2] = np.arange(len(page)) / len(page)
            own[:, -1] = np.arange(len(page), 0, -1) / len(page)
        out.append(own)
        at += len(page)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with a logistic output, in numpy."""

    def __init__(self, seed: int = 3):
        rng, d, h = np.random.default_rng(seed), PATH_DIM + WORD_DIM + NUMBERS, HIDDEN
        self.w = {}
        for side in "fb":
            self.w[f"x{side}"] = (rng.standard_normal((d, 4 * h)) / np.sqrt(d)).astype(np.float32)
            self.w[f"h{side}"] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # remember at first
            self.w[f"c{side}"] = bias
        self.w["o"] = (rng.standard_normal(2 * h + d) / np.sqrt(2 * h + d)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _run(self, x, mask, side, keep):
        """States (T, B, H) of one direction; keep: what the gradient needs."""
        w, h = self.w, HIDDEN
        steps, size = x.shape[:2]
        inputs = x @ w[f"x{side}"] + w[f"c{side}"]
        state, cell = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
        out = np.zeros((steps, size, h), np.float32)
        kept = []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + state @ w[f"h{side}"]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = f * cell + i * g
            tanh = np.tanh(new)
            if keep:
                kept.append((t, state, cell, i, f, o, g, tanh, m))
            cell, state = np.where(m, new, cell), np.where(m, o * tanh, state)
            out[t] = state
        return out, kept

    def forward(self, x, mask, keep=False):
        (a, ka), (b, kb) = self._run(x, mask, "f", keep), self._run(x, mask, "b", keep)
        every = np.concatenate([a, b, x], axis=2)
        return _sigmoid(every @ self.w["o"] + self.w["ob"]), every, ka, kb

    def gradient(self, x, mask, y):
        p, every, ka, kb = self.forward(x, mask, True)
        d = ((p - y) * mask / max(mask.sum(), 1)).astype(np.float32)
        grad = {"o": np.einsum("tb,tbk->k", d, every), "ob": d.sum(keepdims=True)[0]}
        h = HIDDEN
        for side, kept, at in (("f", ka, 0), ("b", kb, h)):
            into = d[:, :, None] * self.w["o"][at : at + h]
            dz_all = np.zeros((*x.shape[:2], 4 * h), np.float32)
            dh, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            gh = np.zeros_like(self.w[f"h{side}"])
            for t, state, cell, i, f, o, g, tanh, m in reversed(kept):
                dh = dh + into[t]
                own = np.where(m, dh, 0)
                dnew = np.where(m, dc, 0) + own * o * (1 - tanh**2)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * cell * f * (1 - f), own * tanh * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                gh += state.T @ dz
                dc = np.where(m, dnew * f, dc)
                dh = np.where(m, dz @ self.w[f"h{side}"].T, dh)
            grad[f"h{side}"] = gh
            grad[f"x{side}"] = np.einsum("tbd,tbk->dk", x, dz_all)
            grad[f"c{side}"] = dz_all.sum((0, 1))
        return grad

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 400, batch: int = 24, rate: float = 0.02, seed: int = 5):
        """Adam on batches of pages; labels -1 don't count."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, rounds + 1):
            pick = rng.integers(0, len(sequences), batch)
            x, mask = padded([sequences[i] for i in pick])
            y, known = padded([labels[i][:, None].astype(np.float32) for i in pick])
            y = y[:, :, 0]
            x = x.copy()
            x[:, :, :PATH_DIM] *= (rng.random(x.shape[:2]) > 0.15)[:, :, None]
            grad = self.gradient(x, mask, np.maximum(y, 0)) if (y[known] >= 0).all() else self.gradient(x, mask & (y >= 0), np.maximum(y, 0))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.w[k] = (self.w[k] - rate * min(1.0, 2 - 2 * step / rounds) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def label(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for each block, pages of like length together."""
        out: list = [np.zeros(0, np.float32)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        while order:
            most = max(1, 40_000 // len(sequences[order[-1]]))  # blocks at once
            part, order = order[-most:], order[:-most]
            p = self.forward(*padded([sequences[i] for i in part]))[0]
            for j, i in enumerate(part):
                out[i] = p[: len(sequences[i]), j]
        return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, sequences))
    x = np.zeros((steps, len(sequences), sequences[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(sequences)), bool)
    for j, s in enumerate(sequences):
        x[: len(s), j], mask[: len(s), j] = s, True
    return x, mask


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, most_blocks: int = TRAIN_BLOCKS, seed: int = 11) -> Labeller | None:
    """A labeller fitted on at most `sample` pages of at most `most_blocks` blocks; None where no page has the markup."""
    marked = F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") < MOST_HTML)
    picked = smallest_hashes(pages.where(marked).select("page_id", "html"), "page_id", sample).toPandas()
    own = [b for b in map(blocks, picked["html"]) if 0 < len(b) <= most_blocks]
    own = [b for b in own if any(x[3] == 1 for x in b)]
    if not own:
        return None
    rng, bare = np.random.default_rng(seed), [[(None, *b[1:]) for b in page] for page in own]
    seen = [*own, *bare, *([_renamed(p, rng) for p in own * 2])]
    sequences = vectors(seen)
    for x in sequences[len(own) : 2 * len(own)]:
        x[:, :PATH_DIM] = 0
    labels = [np.array([max(x[3], 0) for x in b]) for b in own]  # markup is known: what lies outside is not main text
    labeller = Labeller()
    labeller.fit(sequences, labels * 4)
    return labeller


def _by_size(block: tuple) -> bool:
    return block[2] * 2 <= len(block[1]) and len(block[1].split()) >= FALLBACK_WORDS


def extract(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages(page_id, url, html, ...)."""

    def wanted(every: list[list]) -> list[list[bool]]:
        if labeller is None:
            return [[_by_size(b) for b in page] for page in every]
        return [list(p >= 0.5) for p in labeller.label(vectors(every))]

    def run(batches):
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, 256):
                every = [blocks(h or "") for h in batch.column("html").slice(at, 256).to_pylist()]
                texts += ["\n\n".join(b[1] for b, q in zip(page, own) if q) for page, own in zip(every, wanted(every))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
