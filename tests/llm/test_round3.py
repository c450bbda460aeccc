"""Resampling, token alignment and line rules against brute force, on small tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from chronovec.llm import alignment, decontaminate, html_text, line_rules, quality, resampling

DOCS = "doc_id long, text string, Rank string, n_words string"


def table(spark, rows):
    """Documents with columns named like results."""
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# resampling


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(120)] + ["É", "ß", "日本", "Word", "x" * 40]
    rows = [(i, rng.choice([" ", "\n", ", ", "\0"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 19, 20, 60])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "long " * 30000), (n + 4, "x" * 100000)]


def brute_resampling(rows, target, ngram, buckets, seed, percent, least):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(split(text))))
    for text in target:
        t.update(map(bucket, grams(split(text))))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        words = split(text)
        g = [gain[bucket(x)] for x in grams(words)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("ngram,percent", [(1, 10), (2, 55), (3, 100)])
def test_resampling_matches_brute_force(spark, ngram, percent):
    rows = texts(1, 150) + [(None, "a b c " * 10), (None, "a b c " * 10), (7, "z " * 40), (7, "z " * 40), (7, "z " * 40)]
    target = ["w1 w2 w3 Word", None, "", "日本 w5 " * 20]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(table(spark, rows), wanted, ngram, 97, 5, percent, 20)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resampling(rows, target, ngram, 97, 5, percent, 20)


def test_resampling_of_one_document_many_times_and_of_nothing(spark):
    rows = [(3, "same words " * 15)] * 400 + [(4, "other words " * 15)] * 5
    none = spark.createDataFrame([], "text string")
    got = resampling.resample(table(spark, rows), none, percent=50)
    assert Counter(tuple(r) for r in got.collect()) == brute_resampling(rows, [], 1, 10_000, 2024, 50, 20)
    assert resampling.resample(table(spark, []), none).count() == 0
    assert resampling.resample(table(spark, [(1, "few words")]), none).first()["rank"] is None


def test_features_stay_inside_their_document():
    owner, bucket, words = resampling.features([b"a b", b"", b"c", b"d e f"], 3, 1 << 30)
    found = sorted(zip(owner.tolist(), bucket.tolist()))
    grams = {0: [b"a", b"b", b"a b"], 2: [b"c"], 3: [b"d", b"e", b"f", b"d e", b"e f", b"d e f"]}
    assert found == sorted((k, crc32(g) % (1 << 30)) for k, own in grams.items() for g in own)
    assert words.tolist() == [2, 0, 1, 3]


# alignment


def test_merge_path_equals_a_plain_merge_for_any_piece_size():
    rng = random.Random(3)
    for trial in range(60):
        last = rng.randrange(1, 80)
        a, b = (sorted({*rng.sample(range(1, last + 1), rng.randrange(last)), last}) for _ in range(2))
        both = sorted(set(a) & set(b))
        group = lambda e: sum(x < e for x in both)
        overlaps = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(a[i], b[j])]
        for piece in (1, 2, 3, 7, 64, 1000):
            of_a, of_b, found = alignment.merge_groups(np.array(a), np.array(b), piece)
            assert of_a.tolist() == [group(e) for e in a] and of_b.tolist() == [group(e) for e in b]
            assert sorted(map(tuple, found.tolist())) == overlaps


def test_crossings_split_the_merge_into_equal_pieces():
    a, b = np.array([2, 4, 6, 8]), np.array([1, 4, 5, 8])
    merged = sorted([(e, 0) for e in a] + [(e, 1) for e in b])
    got = alignment.crossings(a, b, np.arange(9))
    assert got.tolist() == [sum(k == 0 for _, k in merged[:d]) for d in range(9)]


def brute_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    A.encode_special_tokens = True
    A.no_truncation(), A.no_padding()
    B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    found = []
    for i, text in rows:
        text = text or ""
        a = A.encode(" " + text, add_special_tokens=False).ids
        b = B.encode(text)
        a_bytes = [bytes(byte_of[c] for c in A.id_to_token(x)) for x in a]
        b_bytes = [piece(B.id_to_piece(x)) for x in b]
        raw = (" " + text).encode()
        if not text or b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            found.append((i, [], [], []))
            continue
        ends = [[sum(map(len, x[: k + 1])) for k in range(len(x))] for x in (a_bytes, b_bytes)]
        groups, at_a, at_b = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            to_a, to_b = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((a[at_a:to_a], b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        found.append((i, a, b, groups))
    counts = Counter(p for _, _, _, groups in found for p in {(x, y) for g, h in groups for x in g for y in h})
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, a, b, groups in found:
        links = [(x, y) for g, h in groups for x in g for y in h]
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return Counter(out)


def alignment_rows():
    rng = random.Random(8)
    words = ["the", "Tokenisation", "naïve", "日本語", "🙂", "don't", "1234", "  ", "\n", "\t\t", "Überraschung", "x_y", "<s>", "</s>", "<|endoftext|>", "<0x41>", "ﬁ", "①", "é"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 8, 40])))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "▁"), (104, "a ▁ b"), (105, "a" * 4500), (106, " " * 2600 + "x"), (107, "\u0000")]
    rows += [(None, "no id"), (None, "no id"), (108, "twice"), (108, "twice"), (109, "日" * 300), (110, "the cat " * 3000)]
    return rows


def test_alignment_matches_brute_force(spark):
    rows = alignment_rows()
    want = brute_alignment(rows)
    assert sum(n for r, n in want.items() if r[1] == 0) >= 4  # null, empty, and texts with the sign for a space
    for common in (alignment.COMMON, 40, 0):  # pairs beyond `common` are joined
        got = alignment.token_alignment(table(spark, rows), common=common)
        assert Counter(tuple(r) for r in got.collect()) == want


def test_links_of_large_groups_are_added_up_by_distinct_ids():
    a_ids, b_ids = np.array([1, 2, 1, 2, 3]), np.array([5, 5, 6])
    args = (a_ids, b_ids, np.array([4]), np.array([0]), np.array([5]), np.array([0]), np.array([3]))
    want = Counter((4 << 31) | (int(x) << alignment.B_BITS) | int(y) for x in a_ids for y in b_ids)
    for most in (1, 100):
        before, alignment._LINKS = alignment._LINKS, most
        try:
            keys, times = alignment._pairs(*args)
        finally:
            alignment._LINKS = before
        assert dict(zip(keys.tolist(), times.tolist())) == want


def test_alignments_give_back_tokens_and_groups(spark):
    rows = [(1, "Tokenisation differs"), (2, None), (3, "▁")]
    got = {r.doc_id: r for r in alignment.alignments(table(spark, rows)).collect()}
    own = alignment.load(*alignment.default_paths())
    for g in got[1].groups:
        a = b"".join(own.a_bytes[i] for i in got[1].a_ids[g.a_from : g.a_from + g.a_size])
        assert a == b"".join(own.b_bytes[i] for i in got[1].b_ids[g.b_from : g.b_from + g.b_size])
    assert sum(g.a_size for g in got[1].groups) == len(got[1].a_ids)
    assert got[2].groups == got[3].groups == []


def test_alignment_of_nothing(spark):
    assert alignment.token_alignment(table(spark, [])).count() == 0
    assert alignment.token_alignment(table(spark, [(1, None)])).first()["groups_sha256"] == ""


# line rules


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(runs)
    spots = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(spots) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(spots), failed


def test_base_columns_match_brute_force(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "Ä", "日本", "#x", "|", "end.", "\x0b", "\x1c"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\r\n"]) for _ in range(rng.choice([0, 1, 2, 3, 60, 200])))) for k in range(80)]
    rows += [(90, None), (90, None), (None, ""), (91, " \n \n"), (92, "one two three " * 20000), (93, "x" * 100000), (94, "a\na\n a\nA\na")]
    got = line_rules.clean_lines(table(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((i, *brute_base(t)) for i, t in rows)
    assert got[0].Rank == "x" and line_rules.clean_lines(table(spark, [])).count() == 0


GOOD = "It was a plain sentence about the weather that nobody had asked for."
BAD = [
    "no sentence mark at the end of this line", "WOW!! THIS!! IS!! NOT!! TEXT!!", "some%%% words### with&&& marks*** all$$$ over.", "Home | News | Sport | Contact.", "Read more.",
    "This site uses cookies to serve you better.", "function() { return x; }.", "ALL OF THIS LINE IS WRITTEN IN CAPITALS, MY FRIEND.",
]


def test_each_rule_removes_its_lines_and_leaves_others(spark):
    fine = [GOOD, "Is that so?", 'He said: "Go home."', "Das ist ein kurzer Satz, nicht wahr!", "これは文です。", "A | B is a notation for parallel composition in the calculus of processes.", "We met at home."]
    rows = [(k, x) for k, x in enumerate(fine + BAD)]
    got = {r.doc_id: r.n_removed_lines for r in line_rules.clean_lines(table(spark, rows)).collect()}
    assert [got[k] for k in range(len(rows))] == [0] * len(fine) + [1] * len(BAD)


def test_a_paragraph_that_breaks_off_stays(spark):
    words = " ".join(["word"] * 18)
    rows = [(0, f"Whole sentence. {words} and"), (1, f"Whole sentence {words} and"), (2, "Whole sentence. Short and"), (3, f"Whole sentence!! {words} and ### $$$ %%% &&& *** ||| <<< >>> ###")]
    got = {r.doc_id: r.n_removed_lines for r in line_rules.clean_lines(table(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_documents_that_lose_too_much_are_rejected(spark):
    rng = random.Random(6)
    numbered = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(9)) + "." for _ in range(12)]
    menu = "Home | News | Sport | Contact."
    rows = [(1, "\n".join(numbered)), (2, "\n".join([menu, *numbered])), (3, "\n".join([*numbered, *(" ".join(f"open{rng.randrange(10**6)}" for _ in range(9)) for _ in range(9))])), (4, "\n".join([*numbered[:8], *numbered[:8]]))]
    got = {r.doc_id: r for r in line_rules.clean_lines(table(spark, rows)).collect()}
    assert got[1].kept and got[1].cleaned == rows[0][1] and got[1].lost_chars == 0
    assert got[2].kept and got[2].cleaned == rows[0][1] and got[2].n_removed_lines == 1
    assert not got[3].kept and not got[3].base_failed
    assert got[4].n_dup_lines == got[4].n_removed_lines == 8 and got[4].cleaned == "\n".join(numbered[:8]) and not got[4].kept


# pages in time in proportion to their length

#: The same markup by one expression, which looks for the end of each tag anew.
NAIVE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9-]*)[^<>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[/a-zA-Z][^<>]*\Z",
    re.S | re.I,
)


def test_markup_equals_the_naive_expression():
    rng = random.Random(1)
    bits = ["<", "<p", "<a ", ">", '"', "'", "</p>", "<!--", "-->", "<script>", "</script >", "x", "=", " title=", "<svg ", "<!", "<?", "/", "<div class='a'>", "text", "\n", "<1"]
    for _ in range(8000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        want = [(m.start(), m.end(), m[2] or m[5] or m[7] or "", (m[3] or m[6] or m[8] or "").lower(), m[4] or m[9] or "") for m in NAIVE.finditer(page)]
        assert list(html_text.tags(page)) == want, page


def test_hostile_pages_take_time_in_proportion():
    for part in ("<script ", "<p title='x", "<a ", "<p title=\"x' ", "<div>", "<!", "<p '\">"):
        for page in (part * 40_000, part * 40_000 + ">"):
            start = time.time()
            html_text.blocks(page)
            assert time.time() - start < 5  # about 0.3 seconds; the expression above takes minutes


def test_path_vectors_grow_by_a_tag():
    (deep,) = html_text.blocks("<nav class='Top bar'>" + "<div>" * 60 + "x")
    parts = ["nav", ".top", ".bar", *["div"] * 60]
    assert list(deep[0]) == parts and deep[3] == 0
    every = [*parts, *(f"{a}>{b}" for a, b in zip(parts, parts[1:]))]
    want = sum(html_text._PATHS[zlib.crc32(p.encode()) & 4095].astype(float) for p in every) / np.sqrt(len(every))
    assert html_text._path_vector(deep[0]) == pytest.approx(want, abs=1e-5)
    assert [b[2] for b in html_text.blocks("<p><a><b><i><u><s><em>link</em></s></u></i></b></a> text</p>")] == [4]


# winnowing


def test_fingerprints_thin_out_and_every_shared_span_has_one():
    rng = np.random.default_rng(3)
    shared = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    for trial in range(30):
        a, b = (rng.integers(1, 1 << 62, rng.integers(60, 400)).astype(np.uint64) for _ in range(2))
        i, j, n = rng.integers(len(a)), rng.integers(len(b)), int(rng.integers(10, 40))
        texts = [np.concatenate([x[:at], shared[:n], x[at:]]) for x, at in ((a, i), (b, j))]
        found = [dict(zip(*decontaminate.fingerprints(t, np.array([len(t)]), 10, 10, 5))) for t in texts]
        for start in range(n - 9):  # each shared window keeps the same k-gram in both
            own = [{int(p - at - start): fp for p, fp in f.items() if at + start <= p <= at + start + 5} for f, at in zip(found, (i, j))]
            assert own[0].items() & own[1].items()
        assert len(found[0]) < 0.45 * len(texts[0])  # places that are looked up, about 2 in 7 of the words
    hashes, counts = rng.integers(1, 1 << 62, 30).astype(np.uint64), np.array([9, 10, 0, 11])
    at, _ = decontaminate.fingerprints(hashes, counts, 10, 10, 5)
    assert set(at) <= {*range(9, 15), *range(19, 26)} and len(at) >= 2


def test_hits_end_where_words_differ_and_common_fingerprints_stay_exact(spark):
    words = lambda *parts: " ".join(parts)
    base = [f"s{k}" for k in range(30)]
    items = [(k, words(*base[:15], f"own{k}", *base[15:])) for k in range(12)] + [(90, words(*base[:9])), (91, None), (92, words(*base[:15]))]
    docs = [(1, words("a", *base, "z")), (2, words(*base[:9])), (3, words(*base[1:9], "x", *base[9:15])), (4, words(*base[:15], "own3", *base[15:])), (5, words(*base[3:12], "x") * 3)]
    split = lambda t: (t or "").split()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.MOST_BROADCAST, 0):
        before, decontaminate.MOST_BROADCAST = decontaminate.MOST_BROADCAST, most
        try:
            got = {r.doc_id: r for r in decontaminate.decontaminate(table(spark, docs), bench).collect()}
        finally:
            decontaminate.MOST_BROADCAST = before
        for i, text in docs:
            w, hit, found = split(text), set(), set()
            for item, t in items:
                own = split(t)
                n = min(10, len(own))
                for a in range(len(own) - n + 1) if n else ():
                    for at in range(len(w) - n + 1):
                        if w[at : at + n] == own[a : a + n]:
                            hit |= set(range(at, at + n))
                            found.add(str(item))
            assert (got[i].n_hit, got[i]["items"]) == (len(hit), sorted(found)), i


def test_an_id_that_stands_often_is_one_row_of_the_sample(spark, monkeypatch):
    rows = [(1, f"A good sentence number {k}.") for k in range(300)] + [(2, "bad | bad | bad")] * 300 + [(k, f"Words and words {k}.") for k in range(3, 20)]
    labels = spark.createDataFrame([(1, 1), (2, 0), *((k, k % 2) for k in range(3, 20))], "doc_id long, quality int")
    seen = []

    class Kept(quality.Classifier):
        def __init__(self, x, y, ratios):
            seen.append(len(x))
            super().__init__(x, y, ratios)

    monkeypatch.setattr(quality, "Classifier", Kept)
    assert quality.fit(table(spark, rows), labels) is not None and seen == [19]
