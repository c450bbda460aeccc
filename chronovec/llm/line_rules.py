"""Operator 13 [native]: quality rules, lines first.

Every line with a word is held against the rules below; lines that fail one are
removed, and a document that loses too much of its text with them is rejected. Short
documents and those that repeat themselves fail beforehand. All of it is built-in
functions on the row itself: nothing is shuffled, so no group of equal documents,
lines or sources is one task.

- punctuation: a line ends in a sentence mark, behind which quotes and brackets may
  close, or is a paragraph that breaks off: LONG_WORDS words or more with a sentence
  mark inside. Marks of emphasis (`word!! word!!`) or symbols don't fill it.
- navigation: no row of short entries between separators, no menu of a few words.
- boilerplate: no notice of cookies, rights, scripts or subscriptions, no braces, no
  line in capitals, no line that stood in the document before.

Null and empty texts have no words and fail for their length. Lines are parted by
newlines only; words by ASCII white space. Texts of any length are read whole, in
memory in proportion. Repeated rows are judged each, null doc_ids too; other columns
of `clean_lines` pass through, and those named as a result, in any case, are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST_WORDS = 50
#: Percent of the words that may lie in repeated runs of three.
MOST_REPEATED = 50
#: Percent of the characters in words that may go with lines removed.
MOST_LOST = 30
#: Words of a line that may break off behind a whole sentence.
LONG_WORDS = 20
#: Words of a line in which menus are looked for, and words between separators, on average.
MENU_WORDS, ENTRY_WORDS = 4, 3

# White space, symbols, patterns of lines. All are ASCII or explicit, so that SQL reads them alike.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"
SENTENCE_END = r"""[.!?:;…。！？；：؟।]["'”’»)\]}]*[\x20\x09-\x0D]*$"""
SENTENCE_INSIDE = r"""[.!?…。！？؟।]["'”’»)\]]*[\x20\x09-\x0D]"""
SEPARATORS = r"[|»›·•→]|[\x20][/>][\x20]"
MENU = (
    r"(?i)^[\x20\x09-\x0D]*(home|menu|search|next|previous|back|back to top|read more|more|share|print|login|log in|sign in|sign up|register"
    r"|contact|contact us|about|about us|help|faq|sitemap|archive|tags|categories|comments|reply|skip to content)[.!:\x20\x09-\x0D]*$"
)
NOTICE = (
    r"(?i)(uses? cookies|use of cookies|cookie policy|privacy policy|terms of (use|service)|terms and conditions|all rights reserved"
    r"|copyright \(c\)|enable javascript|requires javascript|lorem ipsum|subscribe to our|sign up for our|click here|follow us on|powered by)"
)
#: Whatever matches NOTICE holds one of these in lower case.
NOTICE_PARTS = ["cookie", "privacy", "terms ", "rights", "copyright", "javascript", "ipsum", "subscribe", "sign up", "click", "follow", "powered"]
EMPHASIS = r"[!?]{2,}([\x20\x09-\x0D]|$)"
CAPITALS = r"[A-ZÀ-ÖØ-ÞЀ-ЯΑ-Ω]"
SMALL = r"[a-zß-öø-ÿа-яα-ω]"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SEPARATOR, -1), "")


def may_have_notice(text: Column) -> Column:
    """Whether a text holds a part of a notice, in any case; without one, no line of it is a notice."""
    low = F.lower(text)
    return reduce(or_, (F.contains(low, F.lit(x)) for x in NOTICE_PARTS))


def line_fails(line: Column, noticed: Column | None = None) -> Column:
    """Whether a line with a word breaks a rule of its own; noticed: may_have_notice of its text.

    What is cheap to tell comes first, so that the dearer half of a condition is seldom looked at.
    """
    words = F.size(_words(line))
    marks = F.regexp_count(line, F.lit(SEPARATORS))
    symbols, emphasis, capitals = (F.regexp_count(line, F.lit(x)) for x in (f"[{SYMBOLS}]", EMPHASIS, CAPITALS))
    noticed = may_have_notice(line) if noticed is None else noticed
    return (
        ~(F.right(line, F.lit(1)).isin(*".!?:;") | line.rlike(SENTENCE_END) | (line.rlike(SENTENCE_INSIDE) & (words >= LONG_WORDS)))
        | ((emphasis > 0) & (emphasis * 4 > words))
        | ((symbols > 0) & (symbols * 10 > F.length(_without(line, SPACE))))
        | ((marks >= 2) & (words <= (marks + 1) * (ENTRY_WORDS + 1)))
        | (line.rlike(MENU) & (words <= MENU_WORDS))
        | (noticed & line.rlike(NOTICE))
        | line.rlike(r"[{}]")
        | ((capitals >= 12) & (capitals > F.regexp_count(line, F.lit(SMALL)) * 2))
    )


def _repeated_words(words: Column, grams: Column, ordered: Column, spots: Column) -> dict[str, Column]:
    """Steps to the number of words in runs of three that a text has twice or more, each a column of its own."""
    n = F.size(words)
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    runs = F.zip_with(F.zip_with(F.slice(words, F.lit(1), n - 2), F.slice(words, F.lit(2), n - 2), joined), F.slice(words, F.lit(3), n - 2), joined)
    place = lambda g, i: F.struct(g.alias("gram"), i.alias("at"))
    twice = F.size(F.array_distinct(grams)) < F.size(grams)
    same = lambda x, k: (F.get(ordered, k - 1)["gram"] == x["gram"]) | (F.get(ordered, k + 1)["gram"] == x["gram"])
    held = F.transform(F.filter(ordered, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["at"])
    gaps = F.zip_with(F.slice(spots, 1, F.size(spots) - 1), F.slice(spots, 2, F.size(spots) - 1), lambda a, b: F.least(b - a, F.lit(3)))
    return {
        "_grams": F.when(n >= 3, runs).otherwise(F.array().cast("array<string>")),
        "_ordered": F.when(twice, F.sort_array(F.transform(grams, place))).otherwise(F.array().cast("array<struct<gram:string,at:int>>")),
        "_spots": F.when(F.size(ordered) > 0, F.sort_array(held)).otherwise(F.array().cast("array<int>")),
        "n_repeat_words": F.when(F.size(spots) > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long")),
    }


def clean_lines(docs: DataFrame, text: str = "text", most_lost: int = MOST_LOST) -> DataFrame:
    """docs with cleaned, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_removed_lines, n_repeat_words, lost_chars, base_failed, kept."""
    made = ["cleaned", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_removed_lines", "n_repeat_words", "lost_chars", "base_failed", "kept"]
    own = [c for c in docs.columns if c.lower() not in made]
    step = docs.select(*own, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    step = step.withColumn("_words", _words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumn("_lines", lines)
    for name, column in _repeated_words(*map(F.col, ("_words", "_grams", "_ordered", "_spots"))).items():
        step = step.withColumn(name, column)
    once = F.array_distinct("_lines")
    step = step.withColumn("_once", once).withColumn("_noticed", may_have_notice(F.col("_text")))
    step = step.withColumn("_kept", F.filter("_once", lambda x: ~line_fails(x, F.col("_noticed"))))
    step = step.withColumn("cleaned", F.array_join("_kept", "\n"))
    step = step.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size("_once")).cast("long"),
        "n_removed_lines": (F.size("_lines") - F.size("_kept")).cast("long"),
    })
    lost = F.when(F.col("n_removed_lines") > 0, F.col("word_chars") - F.length(_without(F.col("cleaned"), SPACE))).otherwise(F.lit(0).cast("long"))
    step = step.withColumn("lost_chars", lost)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    step = step.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * most_lost)
    return step.withColumn("kept", kept).select(*own, *made)


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "lost_chars"]
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"), *names)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _without_sql(text: str, characters: str) -> str:
    return f"length(translate({text}, {' || '.join(f'chr({ord(c)})' for c in characters)}, ''))"


def _count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(line, {_quoted(pattern)}))"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(str_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
runs AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM split WHERE len(w) >= 3),
grams AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram FROM runs),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams),
repeated AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS spot FROM twice WHERE n >= 2) GROUP BY doc_id),
apart AS (SELECT DISTINCT doc_id, unnest(lines) AS line FROM split),
sized AS (SELECT doc_id, line, {_without_sql('line', SPACE)} AS chars, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words, {_count_sql(SEPARATORS)} AS marks FROM apart),
judged AS (SELECT doc_id, chars, NOT (regexp_matches(line, {_quoted(SENTENCE_END)}) OR (regexp_matches(line, {_quoted(SENTENCE_INSIDE)}) AND words >= {LONG_WORDS})) OR {_count_sql(EMPHASIS)} * 4 > words
    OR (length(line) - {_without_sql('line', SYMBOLS)}) * 10 > chars OR (marks >= 2 AND words <= (marks + 1) * {ENTRY_WORDS + 1}) OR (words <= {MENU_WORDS} AND regexp_matches(line, {_quoted(MENU)}))
    OR regexp_matches(line, {_quoted(NOTICE)}) OR regexp_matches(line, '[{{}}]') OR ({_count_sql(CAPITALS)} >= 12 AND {_count_sql(CAPITALS)} > {_count_sql(SMALL)} * 2) AS fails FROM sized),
left_over AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM judged WHERE NOT fails GROUP BY doc_id),
base AS (SELECT s.doc_id, len(w) AS n_words, {_without_sql('t', SPACE)} AS word_chars, length(t) - {_without_sql('t', SYMBOLS)} AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) - coalesce(l.n, 0) AS n_removed_lines, coalesce(l.chars, 0) AS left_chars
  FROM split s LEFT JOIN repeated r ON r.doc_id = s.doc_id LEFT JOIN left_over l ON l.doc_id = s.doc_id),
ruled AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND (word_chars - left_chars) * 100 <= word_chars * {MOST_LOST} AS kept,
  CAST(n_removed_lines AS BIGINT) AS n_removed_lines, CAST(word_chars - left_chars AS BIGINT) AS lost_chars FROM ruled
"""
