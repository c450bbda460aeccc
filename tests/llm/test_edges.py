"""Nulls in any column, empty tables, large ids beside nulls, and extra columns whose names the operators use themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronovec.llm import bpe, chat, decontaminate, exact_dedup, html_text, near_dedup, quality, sharding, toxicity, warc
from chronovec.llm.common import new_path

BIG = (1 << 60) + 1
CLASHES = """score predicted n h h1 h2 id key keys root keep kept norm bucket owner chain copies evidence odds rate good subs sub shard slot at
 y toxic items digest bytes last of offset size group_size keep_id text_sha256 component_id n_words n_hit page item_id fp win label from i""".split()
WORDS = " ".join(f"w{i}" for i in range(30))
ROWS = [(BIG, WORDS), (BIG + 2, WORDS), (None, WORDS), (None, None), (3, None), (4, ""), (4, ""), (5, WORDS + " w30")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def crowded(df):
    """df with columns of all names in CLASHES that it lacks."""
    return df.select("*", *(F.lit("other").alias(c) for c in CLASHES if c not in df.columns))


def documents(spark, rows=ROWS):
    return crowded(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS))


def items(spark, rows=((1, WORDS), (None, WORDS), (2, None), (3, ""))):
    return crowded(spark.createDataFrame(list(rows), ITEMS).select("item_id", "text"))


def ids(rows, column="doc_id"):
    return sorted((r[column] for r in rows), key=str)


WANT = sorted((i for i, _ in ROWS), key=str)


def results(spark, docs, bench):
    lexicon = toxicity.Lexicon([("w7", True, 2.0)])
    sites = docs.withColumnsRenamed({"source": "host", "lang": "path"})
    return {
        "bpe": bpe.decode(bpe.encode(docs)),
        "round trip": bpe.round_trip(docs),
        "toxicity": toxicity.score(docs, lexicon),
        "toxicity, one column": toxicity.score(docs, lexicon, keep=["doc_id"]),
        "quality": quality.posteriors(sites, None),
        "exact": exact_dedup.exact_groups(docs),
        "shards": sharding.shard_rows(docs, [1.0, 2.0]),
        "near": near_dedup.near_duplicates(docs),
        "hits": decontaminate.decontaminate(docs, bench),
    }


def test_every_row_gets_one_result_under_its_own_id(spark):
    for name, df in results(spark, documents(spark), items(spark)).items():
        assert ids(df.collect()) == WANT, name


def test_empty_tables_give_empty_results(spark):
    for name, df in results(spark, documents(spark, []), items(spark, ())).items():
        assert df.count() == 0, name
    assert decontaminate.decontaminate(documents(spark), items(spark, ())).where("contaminated").count() == 0
    assert decontaminate.without_hits(documents(spark, []), items(spark)).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert toxicity.learn(documents(spark, []), none).entries == [] and quality.fit(documents(spark, []), none) is None
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), html_text.Labeller()).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(turns).count() == chat.format_conversations(turns).count() == 0
    archives = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), new_path(spark, "warc"))
    assert warc.read_archives(archives).count() == 0


def test_results_of_nulls_copies_and_repeated_rows(spark):
    docs = documents(spark)
    exact = exact_dedup.exact_groups(docs).collect()
    assert {r.keep_id for r in exact if r.group_size == 3} == {BIG} and {r.keep_id for r in exact if r.group_size == 4} == {3}
    assert sum(r.kept for r in exact) == 3
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert near == {BIG: 5, BIG + 2: 5, 5: 5, 3: 3, 4: 4, None: None}
    hit = {r.doc_id: r for r in decontaminate.decontaminate(docs.where("text <> ''"), items(spark)).collect()}
    assert {i: (r.n_hit, r.n_items) for i, r in hit.items()} == {i: (30, 1) for i in (BIG, BIG + 2, None, 5)}
    marks = crowded(spark.createDataFrame([(3, 1, 1), (None, 1, 1), (5, None, None), (99, 0, 0)], LABELS))
    assert toxicity.learn(docs, marks).entries == [] and quality.fit(docs, marks) is None
    assert [r.score for r in toxicity.score(docs, toxicity.Lexicon([])).where("score > 0.3").collect()] == []
    shards = sharding.shard_rows(docs, [1.0, 2.0]).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))


@pytest.mark.parametrize("block_windows", [7, decontaminate.BLOCK_WINDOWS])
def test_rows_that_repeat_an_id_are_judged_each(spark, block_windows):
    docs = documents(spark, [*ROWS, (4, WORDS), (None, "w1 w2"), (4, "x " + WORDS)])
    got = decontaminate.decontaminate(docs, items(spark), block_windows=block_windows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got), key=str) == sorted(
        [(BIG, 30, 30, 1), (BIG + 2, 30, 30, 1), (None, 30, 30, 1), (None, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (4, 0, 0, 0),
         (5, 31, 30, 1), (4, 30, 30, 1), (None, 2, 0, 0), (4, 31, 30, 1)], key=str)


def test_the_benchmark_does_not_pass_through_the_driver(spark, monkeypatch):
    rows = [(i, f"{WORDS} " + " ".join(f"i{i}x{j}" for j in range(12))) for i in range(300)]
    bench, docs = items(spark, rows), documents(spark, [(1, WORDS), (2, rows[7][1]), (2, "w1 w2"), (None, WORDS)])
    taken, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: taken.append(collect(self)) or taken[-1])
    runs = decontaminate.decontaminate(docs, bench, block_windows=200)
    left = decontaminate.without_hits(docs, bench, block_windows=200)
    assert max(map(len, taken)) <= 20  # of 3,621 windows
    monkeypatch.undo()
    got = sorted(((r.doc_id, r.n_hit, r.n_items, len(r["items"])) for r in runs.collect()), key=str)
    assert got == [(1, 30, 300, 300), (2, 0, 0, 0), (2, 42, 300, 300), (None, 30, 300, 300)]
    assert [(r.doc_id, r.text) for r in left.collect()] == [(2, "w1 w2")]


def test_signs_at_word_ends_and_in_long_runs_are_folded():
    read = {"idi07": "idiot", "m0r0n5": "morons", "worthl355": "worthless", "worthle55": "worthless", "l0053r": "looser", "idi0t!!": "idiot!!", "100 $5!": "100 $5!"}
    assert {w: toxicity.fold(w) for w in read} == read
    lexicon = toxicity.Lexicon([("idiot", True, 2.0), ("worthless", True, 2.0), ("moron", False, 1.0)])
    weights = {t: lexicon.weight(*toxicity.readings(t)) for t in ("an idi07, w0rthle55!", "idiot1", "1idiot", "m0r0n5", "idiots", "1d10tic")}
    assert weights == {"an idi07, w0rthle55!": 4.0, "idiot1": 2.0, "1idiot": 2.0, "m0r0n5": 1.0, "idiots": 0.0, "1d10tic": 0.0}


def test_all_readings_of_signs_and_disguised_letters():
    lexicon = toxicity.Lexicon([("loser", True, 1.0), ("worthless", True, 1.0), ("idiot", True, 1.0), ("moron", False, 1.0)], exceptions={"x": ("idiot proof",)})
    hidden = ("1oser", "|0$er", "worth1e55", "|d|ot", "1d!0t", "𝐢𝐝𝐢𝐨𝐭", "ídíót", "ｉｄｉｏｔ", "i.d.i.o.t", "i-d-i-o-t!", "1.d.1.0.t", "m_o_r_o_n", "mоrоns", "i.d.i.o.t, 1d|ot-proof")
    weights = {t: lexicon.weight(*toxicity.readings(t)) for t in hidden}
    assert weights == {t: 2.0 if "," in t else 1.0 for t in hidden}
    # letters as such have one reading; a spared phrase may hold a sign
    plain = ("ioser", "ldlot", "worthiess", "U.S.A.", "1.2.3.4", "i.d.o.t", "1d|ot proof", "idi.ot", "lóser")
    assert [lexicon.weight(*toxicity.readings(t)) for t in plain] == [0.0] * len(plain)


def test_beginnings_are_counted_as_plain_loops_count_them(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 40)
    rng = random.Random(3)
    words = ["du", "dumm", "dummes", "a", "x" * 200, "ab", "idi0t", "ídíót", "ídiot"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))), i % 2) for i in range(80)] + [(99, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic long").repartition(3)
    schema = "entry string, " + ", ".join(f"{c} long" for c in toxicity._COUNTS)
    got = {r[0]: list(r)[1:] for r in docs.mapInArrow(toxicity._beginnings, schema).groupBy("entry").agg(*(F.sum(c) for c in toxicity._COUNTS)).collect()}
    want = {}
    for _, text, toxic in rows:
        own = ["idiot" if w == "ídíót" else w.replace("0", "o") for w in (text or "").split()]
        forms = [x for w in own for x in [w + "$", *(w[:n] for n in range(3, 65) if n <= len(w))]]
        for x in set(forms):
            counts = want.setdefault(x, [0] * 5)
            counts[0 if toxic else 1] += 1
            counts[2 if toxic else 3] += forms.count(x) > 1
            counts[4] += toxic * forms.count(x)
    assert got == want


def test_near_duplicates_of_a_row_repeated_a_thousand_times(spark):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(7, long)] * 1000 + [(8, long + " end")] + [(9, other), (9, other + " end"), (10, other + " end now")] + [(11, "alone")] * 3
    docs = documents(spark, rows)
    got = near_dedup.near_duplicates(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    assert {tuple(r) for r in got} == {(7, 7, True, 1000), (8, 7, False, 1), (9, 9, True, 2), (10, 9, False, 1), (11, 11, True, 3)}


def test_pages_and_conversations_with_nulls(spark):
    pages = crowded(spark.createDataFrame([(BIG, None, "<p>a"), (None, None, None), (BIG + 2, "u", "<p>a"), (4, "u", ""), (4, "u", "")], "page_id long, url string, html string"))
    want = ids(pages.collect(), "page_id")
    assert ids(html_text.extract(pages, html_text.Labeller()).collect(), "page_id") == want
    read = warc.read_archives(warc.write_archives(pages, new_path(spark, "warc"))).collect()
    assert ids(read, "page_id") == want
    assert {r.page_id: r.refers_to for r in read} == {BIG: BIG + 2, BIG + 2: None, None: 4, 4: None}
    rows = [(BIG, None, None, None), (BIG, 1, "assistant", "x"), (None, 1, "assistant", "y"), (BIG + 2, 0, "user", "é"), (BIG + 2, 0, "user", "é")]
    turns = crowded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    assert {i: (r.n_turns, r.loss_chars) for i, r in got.items()} == {BIG: (2, 1), None: (1, 1), BIG + 2: (2, 0)}
    assert got[BIG].turns_sha256 == hashlib.sha256(b"\n\nassistant\nx\n").hexdigest()
    assert {r.conv_id for r in chat.format_conversations(turns).collect()} == set(got)


@pytest.fixture
def folder(spark, tmp_path):
    def write(docs, bench, labels):
        at = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        docs.write.parquet(f"{at}/documents.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        return at

    return write


def test_pipeline_stages_on_nulls_and_empty_tables(spark, folder):
    far = " ".join(f"q{i}" for i in range(30))
    labels = crowded(spark.createDataFrame([(None, None, None), (3, None, 1)], LABELS))
    at = folder(documents(spark), items(spark, [(1, far), (None, WORDS), (2, None)]), labels)
    docs = documents(spark)
    kept = {name: ids(stage(spark, docs, at).collect()) for name, stage in corpus_pipeline.STAGES}
    assert kept["toxicity"] == kept["decontamination"] == kept["tokens"] == WANT
    assert kept["exact dedup"] == ids([{"doc_id": i} for i in (BIG, 3, 5)])
    assert kept["near dedup"] == ids([{"doc_id": i} for i in (3, 4, 4, 5, None, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == corpus_pipeline.COLUMNS, name
    assert ids(corpus_pipeline.run(spark, at).collect()) == [3, 5]
    none = folder(documents(spark, []), items(spark, ()), spark.createDataFrame([], LABELS))
    assert corpus_pipeline.run(spark, none).count() == 0
