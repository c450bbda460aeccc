"""The corpus pipeline against a plain reading of its stages."""

import hashlib
import random
import re

import corpus_pipeline
from chronovec.llm import bpe


def test_pipeline_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sal", "vik") for c in ("a", "e", "o", "um", "is", "ath")]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bench = [(i, " ".join(prose(n))) for i, n in enumerate((12, 30, 4, 80))]
    rows, toxic = [], {}
    for i in range(400):
        words = prose(rng.choice((40, 80, 150)))
        kind = i % 8
        toxic[i] = int(kind == 0)
        if kind == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(("grubwarten", "zonkfels")))
        elif kind == 1:
            words[20:20] = bench[rng.choice((0, 1, 3))][1].split()
        elif kind == 2 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            toxic[i] = int("grubwarten" in words or "zonkfels" in words)
        elif kind == 3 and rows:
            words = rows[rng.randrange(len(rows))][1].split()
            words[rng.randrange(len(words))] = "changed"
            toxic[i] = int("grubwarten" in words or "zonkfels" in words)
        rows.append((i, rng.choice((" ", "\n", "  ")).join(words)))
    rows += [(900, None), (901, ""), (902, "one two")]
    at = str(tmp_path / "tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")

    left = {i: t or "" for i, t in rows if not toxic.get(i)}
    seen = {}
    for i in sorted(left):
        seen.setdefault(re.sub(r"[ \t-\r]+", " ", left[i]), i)
    left = {i: left[i] for i in seen.values()}
    sets = {}
    for i, t in left.items():
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in left}
    for _ in left:  # until nothing changes
        before = dict(root)
        for a in left:
            for b in left:
                if root[a] < root[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[b] = root[a]
        if root == before:
            break
    left = {i: t for i, t in left.items() if root[i] == i}
    windows = {tuple(w[j : j + min(10, len(w))]) for w in (t.split() for _, t in bench) for j in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    held = lambda w: any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))
    left = {i: t for i, t in left.items() if not held(t.split())}
    library = Tokenizer.from_file(bpe.default_path())
    want = {}
    for i, t in left.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, at).collect()}
    assert got == want
    assert 100 < len(got) < 300 and {901, 902} & set(got)
