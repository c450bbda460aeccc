"""Registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronovec.functions import binary, names, vectors
from chronovec.operators import candidates, catalog, index, joins, label_store, library, playlist, preference, recommend, scorers, scoring, search, segments
from chronovec.operators import labels as store
from chronovec.plans import views
from chronovec.plans.views import COSINE_SQL, FRAMES_SQL, LABELS_SQL, SERIES_SQL, table
from chronovec.sources import paged
from chronovec.sources.shared import shared_path
from chronovec.streaming import jsonstream, playback

QUERIES: dict = {}
SQL: dict[str, str] = {}
RULES = {"high": 60.0, "low": 30.0, "min_duration": 6.0, "merge_gap": 12.0}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


# vectors and search

@query(f"WITH {FRAMES_SQL} SELECT key, frame_idx, round(list_sum(list_transform(vec, lambda x: x / (sqrt(list_dot_product(vec, vec)) + 1e-8))), 6) AS total, round(sqrt(list_dot_product(vec, vec)), 6) AS norm FROM frames")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    unit = vectors.l2_normalize(F.col("vec"))
    return f.select("key", "frame_idx", F.aggregate(unit, F.lit(0.0), lambda a, x: a + x).alias("total"), vectors.norm(F.col("vec")).alias("norm")).select("key", "frame_idx", *_r("total", "norm"))


def _cosine_sql(reduce: str) -> str:
    return f"WITH {FRAMES_SQL} SELECT f.key, f.frame_idx, round({reduce}({COSINE_SQL}), 6) AS score FROM frames f, (SELECT vec FROM frames WHERE frame_idx = 0) r GROUP BY f.key, f.frame_idx"


def _scored(spark, sf_dir, reduce="max"):
    f = views.frames(spark, sf_dir)
    return scoring.similarity_scores(f, f.where("frame_idx = 0"), reduce)


@query(_cosine_sql("max"))
def cosine_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("key", "frame_idx", *_r("score"))


@query(_cosine_sql("avg"))
def cosine_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, "mean").select("key", "frame_idx", *_r("score"))


_DOT_SQL = f"""WITH {FRAMES_SQL}, q AS (SELECT vec FROM frames WHERE key = 's0' ORDER BY abs(time - 81), frame_idx LIMIT 1),
hits AS (SELECT f.key, f.frame_idx, f.time, list_dot_product(f.vec, q.vec) / sqrt(list_dot_product(q.vec, q.vec)) AS score FROM frames f, q)"""


def _first(spark, sf_dir):
    f = views.frames(spark, sf_dir)
    return f, list(search.vector_at(f, "s0", 81.0).select("vec").first()["vec"])


@query(f"{_DOT_SQL} SELECT key, frame_idx, time, round(score, 6) AS score FROM hits ORDER BY hits.score DESC, key, frame_idx LIMIT 60")
def dot_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(*_first(spark, sf_dir), top_k=60).select("key", "frame_idx", "time", *_r("score"))


@query(f"{_DOT_SQL} SELECT key, frame_idx, time, round(score, 6) AS score FROM hits WHERE hits.score >= 0.1")
def search_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(*_first(spark, sf_dir), top_k=None, min_score=0.1).select("key", "frame_idx", "time", *_r("score"))


@query(f"{_DOT_SQL} SELECT key, frame_idx, time, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, frame_idx) AS nth FROM hits) WHERE nth <= 2 ORDER BY score DESC, key, frame_idx LIMIT 15")
def search_per_scene_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(*_first(spark, sf_dir), top_k=15, per_scene=2).select("key", "frame_idx", "time", *_r("score"))


@query(f"{_DOT_SQL} SELECT key, frame_idx, time, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, frame_idx) AS nth FROM hits WHERE key <> 's0') WHERE nth <= 3 ORDER BY score DESC, key, frame_idx LIMIT 60")
def search_by_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_by_frame(views.frames(spark, sf_dir), "s0", 81.0).select("key", "frame_idx", "time", *_r("score"))


@query(f"WITH {FRAMES_SQL} SELECT key, frame_idx, time FROM frames WHERE key = 's3' ORDER BY abs(time - 84), frame_idx LIMIT 1")
def vector_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_at(views.frames(spark, sf_dir), "s3", 84.0).select("key", "frame_idx", "time")


@query(f"""WITH {FRAMES_SQL}, r AS (SELECT vec FROM frames WHERE key = 's2' AND frame_idx = 5),
hits AS (SELECT f.key, f.frame_idx, f.time, {COSINE_SQL} AS score FROM frames f, r WHERE NOT (f.key = 's2' AND f.frame_idx = 5) AND f.category <> 3)
SELECT key, frame_idx, time, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, frame_idx) AS nth FROM hits) WHERE nth <= 3 ORDER BY score DESC, key, frame_idx LIMIT 60""")
def similar_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    labeled = f.where("category = 3").select("key", store.centiseconds(F.col("time")).alias("time_cs"))
    return search.similar_frames(f, "s2", 40.0, labeled).select("key", "frame_idx", "time", *_r("score"))


_EACH_SQL = f"""WITH {FRAMES_SQL}, q AS (SELECT key AS query_key, frame_idx AS query_idx, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS query FROM frames WHERE (CAST(key[2:] AS BIGINT) * 50 + frame_idx) % 20 = 0),
hits AS (SELECT query_key, query_idx, key, frame_idx, time, round(list_dot_product(vec, query), 9) AS score FROM frames JOIN q ON key <> query_key),
held AS (SELECT *, row_number() OVER (PARTITION BY query_key, query_idx, key ORDER BY score DESC, frame_idx) AS nth FROM hits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_key, query_idx ORDER BY score DESC, key, frame_idx) AS rank FROM held WHERE nth <= 3)
SELECT query_key, query_idx, rank, key, frame_idx, time, round(score, 6) AS score FROM ranked WHERE rank <= 60"""


def _six_places(column: str):
    """A half goes up where the product in doubles is one, as in SQL; scores of nine places often end in a half of the sixth."""
    return (F.signum(column) * F.floor(F.abs(F.col(column)) * 1e6 + 0.5) / 1e6).alias(column)


@query(_EACH_SQL)
def search_each_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame whose id is divisible by 20 is a query against all frames of other scenes."""
    f = views.frames(spark, sf_dir)
    asked = f.where((F.substring("key", 2, 20).cast("long") * 50 + F.col("frame_idx")) % 20 == 0)
    return search.search_each(f, asked).select("query_key", "query_idx", "rank", "key", "frame_idx", "time", _six_places("score"))


@query(_EACH_SQL)
def search_each_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through a clustered index, which reads only slices that can still win."""
    f = views.frames(spark, sf_dir)
    asked = f.where((F.substring("key", 2, 20).cast("long") * 50 + F.col("frame_idx")) % 20 == 0)
    return index.VectorIndex(f, rows_of_slice=64).search(asked).hits.select("query_key", "query_idx", "rank", "key", "frame_idx", "time", _six_places("score"))


@query(SQL["similar_frames"])
def similar_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    labeled = f.where("category = 3").select("key", store.centiseconds(F.col("time")).alias("time_cs"))
    return index.VectorIndex(f, normalize=True, rows_of_slice=64).similar("s2", 40.0, labeled).select("key", "frame_idx", "time", *_r("score"))


# series

@query(f"WITH {SERIES_SQL} SELECT key, idx, round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 6) AS score FROM series WINDOW w AS (PARTITION BY key)")
def scene_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.standardize(views.numbered(views.series(spark, sf_dir)), "scene-z").select("key", F.col("idx").cast("long").alias("idx"), *_r("score"))


def _smooth_sql(w: int) -> str:
    p = w // 2
    return f"""WITH {SERIES_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM series),
at AS (SELECT key, idx, unnest(range(idx - {p}, idx + {w - p})) AS j, n FROM sized WHERE n >= {w}),
mirrored AS (SELECT key, idx, CASE WHEN j < 0 THEN -j WHEN j >= n THEN 2 * (n - 1) - j ELSE j END AS j FROM at)
SELECT m.key, m.idx, round(avg(s.score), 6) AS score FROM mirrored m JOIN series s ON s.key = m.key AND s.idx = m.j GROUP BY m.key, m.idx""".replace("at AS", "spots AS").replace("FROM at)", "FROM spots)")


@query(_smooth_sql(3))
def smooth_w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.smooth(views.numbered(views.series(spark, sf_dir)), 3).select("key", F.col("idx").cast("long").alias("idx"), *_r("score"))


@query(_smooth_sql(4))
def smooth_w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.smooth(views.numbered(views.series(spark, sf_dir)), 4).select("key", F.col("idx").cast("long").alias("idx"), *_r("score"))


_RUNS = f"""WITH {SERIES_SQL},
state AS (SELECT *, coalesce(last_value(CASE WHEN score >= 60 THEN 1 WHEN score < 30 THEN 0 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS s FROM series),
fresh AS (SELECT *, CAST(s = 1 AND coalesce(lag(s) OVER (PARTITION BY key ORDER BY idx), 0) = 0 AS INTEGER) AS f FROM state),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY idx) AS run FROM fresh),
runs AS (SELECT key, min(time) AS "start", max(time) AS "end", max(score) AS peak, avg(score) AS mean FROM numbered WHERE s = 1 GROUP BY key, run)"""


def _merge_sql(name: str, of: str, gap: float) -> str:
    fold = """list_reduce(parts, lambda a, b: {'start': a['start'], 'end': greatest(a['end'], b['end']), 'peak': greatest(a.peak, b.peak),
      'mean': CASE WHEN a['end'] - a['start'] + b['end'] - b['start'] > 0 THEN (a.mean * (a['end'] - a['start']) + b.mean * (b['end'] - b['start'])) / (a['end'] - a['start'] + b['end'] - b['start']) ELSE (a.mean + b.mean) / 2 END})"""
    return f"""{name}_gap AS (SELECT *, coalesce("start" - max("end") OVER (PARTITION BY key ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {gap}, false) AS apart FROM {of}),
{name}_island AS (SELECT *, sum(CAST(apart AS INTEGER)) OVER (PARTITION BY key ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {name}_gap),
{name}_parts AS (SELECT key, list({{'start': "start", 'end': "end", 'peak': peak, 'mean': mean}} ORDER BY "start", "end") AS parts FROM {name}_island GROUP BY key, island),
{name} AS (SELECT key, o['start'] AS "start", o['end'] AS "end", o.peak AS peak, o.mean AS mean FROM (SELECT key, {fold} AS o FROM {name}_parts))"""


_MERGED = f"{_RUNS}, {_merge_sql('merged', 'runs', 12)}"
_KEPT = f"""{_MERGED}, kept AS (SELECT * FROM merged WHERE "end" - "start" >= 6)"""
_SPLIT = f"""{_KEPT}, cut AS (SELECT *, unnest(range(0, greatest(CAST(ceil(("end" - "start") / 48) AS BIGINT), 1))) AS i FROM kept),
pieces AS (SELECT key, "start" + i * 48 AS "start", least("start" + (i + 1) * 48, "end") AS "end", peak, mean FROM cut)"""
_PADDED = f"""{_SPLIT}, bounds AS (SELECT key, min(time) AS lo, max(time) AS hi FROM series GROUP BY key),
wide AS (SELECT key, greatest(lo, "start" - 1.5) AS "start", least(hi, "end" + 1.5) AS "end", peak, mean FROM pieces JOIN bounds USING (key)),
{_merge_sql('padded', 'wide', 0)}"""
_OUT = 'key, round("start", 4) AS "start", round("end", 4) AS "end", round(peak, 6) AS peak, round(mean, 6) AS mean'


def _segments(df: DataFrame) -> DataFrame:
    return df.select("key", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), *_r("peak", "mean"))


@query(f"{_RUNS} SELECT {_OUT} FROM runs")
def hysteresis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(segments.runs(views.series(spark, sf_dir), 60.0, 30.0))


@query(f"{_MERGED} SELECT {_OUT} FROM merged")
def merge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(segments.merge(segments.runs(views.series(spark, sf_dir), 60.0, 30.0), 12.0))


@query(f"{_SPLIT} SELECT {_OUT} FROM pieces")
def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(segments.extract(views.series(spark, sf_dir), **RULES, max_duration=48.0))


@query(f"{_PADDED} SELECT {_OUT} FROM padded")
def pad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(segments.extract(views.series(spark, sf_dir), **RULES, max_duration=48.0, padding=1.5))


@query(f"{_KEPT} SELECT {_OUT} FROM kept")
def extract_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(segments.extract(views.series(spark, sf_dir), **RULES))


_SCORED_SQL = f"scored AS (SELECT f.key, f.frame_idx, f.time, max({COSINE_SQL}) AS score FROM frames f, (SELECT vec FROM frames WHERE frame_idx = 0) r GROUP BY f.key, f.frame_idx, f.time)"
def _ranked_sql(high: float, low: float) -> str:
    return f"""state AS (SELECT *, coalesce(last_value(CASE WHEN score >= {high} THEN 1 WHEN score < {low} THEN 0 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS s FROM scored),
fresh AS (SELECT *, CAST(s = 1 AND coalesce(lag(s) OVER (PARTITION BY key ORDER BY time), 0) = 0 AS INTEGER) AS f FROM state),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY time) AS run FROM fresh),
runs AS (SELECT key, min(time) AS "start", max(time) AS "end", max(score) AS peak, avg(score) AS mean FROM numbered WHERE s = 1 GROUP BY key, run),
{_merge_sql('merged', 'runs', 2)}, kept AS (SELECT * FROM merged WHERE "end" - "start" >= 3),
ranked AS (SELECT *, round(peak, 4) AS score, row_number() OVER (ORDER BY round(peak, 4) DESC, key, "start") AS rank FROM kept)"""


_MOMENTS_SQL = f"WITH {FRAMES_SQL}, {_SCORED_SQL}, {_ranked_sql(0.25, 0.15)}"


def _moments(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumnRenamed("frame_idx", "idx")
    return playlist.ranked(segments.extract(scored, 0.25, 0.15, 3.0, 2.0), 50)


@query(f'{_MOMENTS_SQL} SELECT rank, key, "start", "end", score, round(mean, 6) AS mean FROM ranked WHERE rank <= 50')
def recommend_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(spark, sf_dir).select(F.col("rank").cast("long").alias("rank"), "key", "start", "end", "score", *_r("mean"))


@query(f'''{_MOMENTS_SQL}, list AS (SELECT *, lag(key) OVER (ORDER BY rank) AS before FROM ranked WHERE rank <= 50),
held AS (SELECT *, greatest("end" - "start", 2.0) + CASE WHEN before IS DISTINCT FROM key THEN 0.5 ELSE 0 END AS hold FROM list)
SELECT rank, key AS path, CASE WHEN before = key THEN 'seek' ELSE 'load' END AS action, hold, coalesce(sum(hold) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS "at" FROM held''')
def dj_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = _moments(spark, sf_dir).withColumn("path", F.col("key")).withColumn("playlist", F.lit("all"))
    return playlist.schedule(moments).select(F.col("rank").cast("long").alias("rank"), "path", "action", "hold", "at")


@query(f'{_MOMENTS_SQL} SELECT count(*) AS moments, round(sum("end" - "start"), 6) AS duration FROM ranked WHERE rank <= 50')
def playlist_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = _moments(spark, sf_dir).withColumn("playlist", F.lit("all"))
    return moments.agg(F.count("*").alias("moments"), F.round(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))), 6).alias("duration"))


_LIKES_SQL = f"""WITH {FRAMES_SQL}, l AS (SELECT 's' || CAST(user_id % 4 AS VARCHAR) AS key, CAST(event_id % 4000 AS DOUBLE) / 10 AS time, event_id FROM events WHERE event_type = 'purchase'),
near AS (SELECT l.event_id, f.key, f.frame_idx, row_number() OVER (PARTITION BY event_id ORDER BY abs(f.time - l.time), f.frame_idx) AS nth FROM l JOIN frames f ON f.key = l.key),
r AS (SELECT vec FROM frames SEMI JOIN (SELECT * FROM near WHERE nth = 1) USING (key, frame_idx)),
scored AS (SELECT f.key, f.frame_idx, f.time, max({COSINE_SQL}) AS score FROM frames f, r WHERE f.key NOT IN (SELECT key FROM l) GROUP BY f.key, f.frame_idx, f.time), {_ranked_sql(0.35, 0.3)}"""


@query(f'{_LIKES_SQL} SELECT rank, key, round("start", 3) AS "start", round("end", 3) AS "end", score, round(mean, 6) AS mean FROM ranked WHERE rank <= 50')
def recommend_from_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are likes of moments in the first four scenes; these are left out of the result."""
    likes = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("key"), ((F.col("event_id") % 4000).cast("double") / 10).alias("time")
    )
    found = recommend.recommend(views.frames(spark, sf_dir), likes, 0.35, 0.3, min_duration=3.0, merge_gap=2.0)
    return found.select(F.col("rank").cast("long").alias("rank"), "key", "start", "end", "score", *_r("mean"))


_SCENES_SQL = f"""WITH {FRAMES_SQL}, {_SCORED_SQL},
z AS (SELECT key, frame_idx, time, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS score FROM scored WINDOW w AS (PARTITION BY key)),
spots AS (SELECT key, frame_idx, time, unnest(range(frame_idx - 1, frame_idx + 2)) AS j, count(*) OVER (PARTITION BY key) AS n FROM z),
smoothed AS (SELECT m.key, m.frame_idx, m.time, avg(z.score) AS score FROM (SELECT key, frame_idx, time, CASE WHEN j < 0 THEN -j WHEN j >= n THEN 2 * (n - 1) - j ELSE j END AS j FROM spots) m
  JOIN z ON z.key = m.key AND z.frame_idx = m.j GROUP BY m.key, m.frame_idx, m.time), {_ranked_sql(0.5, 0.0).replace("FROM scored", "FROM smoothed")}"""


@query(f'{_SCENES_SQL} SELECT key, "start", "end", round(peak, 6) AS peak, round(mean, 6) AS mean FROM kept')
def score_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    found = recommend.score_scenes(f, f.where("frame_idx = 0"), 0.5, 0.0, normalize="scene-z", window=3, min_duration=3.0, merge_gap=2.0)
    return found.select("key", "start", "end", *_r("peak", "mean"))


# scorers: a model of two means, the direction from the mean vector of all frames to that of the first of each scene

_MODEL_SQL = f"""WITH {FRAMES_SQL}, parts AS (SELECT frame_idx = 0 AS liked, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM frames),
m AS (SELECT list(4 * (u - v) ORDER BY i) AS w FROM (SELECT i, round(avg(x) FILTER (liked), 9) AS u, round(avg(x), 9) AS v FROM parts GROUP BY i)),
scored AS (SELECT key, frame_idx, time, category, 1 / (1 + exp(-(list_dot_product(vec, w) - 0.5))) AS score FROM frames, m)"""


def _means_model(f: DataFrame):
    parts = f.select((F.col("frame_idx") == 0).alias("liked"), F.posexplode("vec").alias("i", "x")).groupBy("i")
    means = parts.agg(F.round(F.avg(F.when(F.col("liked"), F.col("x"))), 9).alias("u"), F.round(F.avg("x"), 9).alias("v"))
    # one row for each number of a vector
    return scorers.logistic_scorer([4 * (r["u"] - r["v"]) for r in means.orderBy("i").collect()], -0.5)


@query(f"{_MODEL_SQL} SELECT key, frame_idx, round(score, 6) AS score FROM scored")
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    return _means_model(f)(f, "vec", "score").select("key", "frame_idx", *_r("score"))


@query(f"""{_MODEL_SQL}, liked AS (SELECT DISTINCT key FROM frames WHERE category = 2 AND frame_idx = 7), {_ranked_sql(0.39, 0.37).replace("FROM scored", "FROM (SELECT * FROM scored WHERE key NOT IN (SELECT key FROM liked))")}
SELECT rank, key, round("start", 3) AS "start", round("end", 3) AS "end", score, round(mean, 6) AS mean FROM ranked WHERE rank <= 50""")
def recommend_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments by a model's scores, in scenes without a like."""
    f = views.frames(spark, sf_dir)
    likes = f.where("category = 2 AND frame_idx = 7").select("key", "time")
    found = recommend.recommend(f, likes, 0.39, 0.37, scorer=_means_model(f), min_duration=3.0, merge_gap=2.0)
    return found.select(F.col("rank").cast("long").alias("rank"), "key", "start", "end", "score", *_r("mean"))


@query(f"""{_MODEL_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, frame_idx) AS nth FROM scored),
drawn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('0:' || key || ':' || frame_idx)) AS pick FROM ranked WHERE nth > 3 AND category <> 4)
SELECT key, frame_idx, time, round(score, 6) AS score, 'top' AS pool FROM ranked WHERE nth <= 3 AND category <> 4 UNION ALL SELECT key, frame_idx, time, round(score, 6), 'random' FROM drawn WHERE pick <= 1""")
def candidates_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    found = candidates.gather(f, _labeled(f), 3, 1, scorer=_means_model(f))
    return found.select("key", "frame_idx", "time", *_r("score"), "pool")


# labels

_L = f"WITH {LABELS_SQL} "


def _store(spark, sf_dir):
    return store.upsert(views.labels(spark, sf_dir))


@query(_L + "SELECT key, time_cs, profile, label, seq FROM store")
def label_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).select("key", "time_cs", "profile", "label", "seq")


@query(_L + "SELECT profile, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM store GROUP BY profile")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.counts(_store(spark, sf_dir))


@query(_L + "SELECT coalesce(profile, '*') AS profile, count(*) AS likes FROM store WHERE label = 1 GROUP BY ROLLUP (profile)")
def taste_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.summary(_store(spark, sf_dir), "base")


@query(_L + "SELECT DISTINCT split_part(profile, ':', 1) AS base FROM store UNION SELECT 'default'")
def profile_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.bases(_store(spark, sf_dir), "default")


@query(_L + "SELECT key, time_cs, profile, label FROM store WHERE NOT (profile = 'base:c1' OR starts_with(profile, 'base:c1:'))")
def label_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.reset(_store(spark, sf_dir), "base:c1").select("key", "time_cs", "profile", "label")


@query(_L + "SELECT key, time_cs, profile, label FROM store WHERE NOT (profile = 'base:c2' AND ts >= 5000)")
def label_undo_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.remove(_store(spark, sf_dir), "base:c2", 5000.0).select("key", "time_cs", "profile", "label")


@query(_L + "SELECT key, time_cs, profile, label FROM store WHERE NOT (label = 0 AND time_cs % 2 = 0)")
def label_unlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _store(spark, sf_dir)
    return store.unlike(own, own.where("label = 0 AND time_cs % 2 = 0")).select("key", "time_cs", "profile", "label")


@query(_L + "SELECT DISTINCT key, time_cs FROM store WHERE label = 1")
def liked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.liked_ids(_store(spark, sf_dir), "base")


@query("""WITH m AS (SELECT event_id, unnest(list_distinct(list_filter([CASE WHEN value > 100 THEN floor(value) - 2 END, floor(value), CASE WHEN value > 50 THEN floor(value) + (event_id % 3) END], lambda x: x IS NOT NULL))) AS mark FROM events)
SELECT event_id, mark FROM m""")
def mark_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.floor("value").cast("double")
    marks = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("value") > 100, value - 2).alias("in_time"), value.alias("time"), F.when(F.col("value") > 50, value + F.col("event_id") % 3).alias("out_time")
    )
    return store.mark_times(marks).select("event_id", "mark")


@query(_L + """SELECT key, time_cs, profile, round(greatest(0.05, pow(0.5, greatest(0.0, 20000.0 - ts) / 5000.0)), 6) AS weight FROM (SELECT key, time_cs, profile,
  greatest(20000.0, (SELECT max(ts) FROM store)) - 20000.0 AS more, CASE WHEN ts > 0 THEN ts ELSE (SELECT min(ts) FROM store WHERE ts > 0) END - greatest(0.0, (SELECT max(ts) FROM store) - 20000.0) AS ts FROM store)""")
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _store(spark, sf_dir)
    return preference.recency_weights(own, 5000.0 / 86400.0, 20000.0).select("key", "time_cs", "profile", *_r("weight"))


@query(_L + "SELECT key, time_cs, profile, label FROM store")
def versioned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings in three batches into a store by versions; a batch that comes again changes nothing."""
    log = views.labels(spark, sf_dir).withColumn("time", F.col("time_cs") / 100)
    last = log.agg(F.max("seq")).first()[0] or 0
    own = label_store.LabelStore(spark, shared_path(spark, "labels"))
    for number in (0, 1, 2, 1):
        part = log.where(F.least(F.floor(F.col("seq") * 3 / (last + 1)), F.lit(2)) == number)
        own.add(part.select("key", "time", "label", "profile", "ts", "seq"), order="seq", batch=("events", number))
    return own.load().select("key", "time_cs", "profile", "label")


# joins

@query(f"""WITH {FRAMES_SQL}, l AS (SELECT 's' || CAST(user_id % 12 AS VARCHAR) AS key, CAST(event_id % 4000 AS DOUBLE) / 10 AS time, event_id FROM events WHERE event_type = 'purchase'),
near AS (SELECT l.event_id, l.key, l.time, f.frame_idx, f.time AS frame_time, row_number() OVER (PARTITION BY event_id ORDER BY abs(f.time - l.time), f.frame_idx) AS nth FROM l JOIN frames f ON f.key = l.key)
SELECT event_id, key, time, frame_idx, frame_time FROM near WHERE nth = 1""")
def training_set_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    likes = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("key"), ((F.col("event_id") % 4000).cast("double") / 10).alias("time"), "event_id"
    )
    return joins.nearest(likes, views.frames(spark, sf_dir)).select("event_id", "key", "time", "frame_idx", "frame_time")


@query(f"""{_KEPT}, tagged AS (SELECT *, key % 3 AS tag FROM kept), m AS (SELECT user_id AS key, user_id % 2 AS tag, epoch(ts) / 3600 AS seconds, CASE WHEN event_id % 2 = 0 THEN epoch(ts) / 3600 + 5 END AS end_seconds FROM events WHERE event_type = 'purchase')
SELECT key, tag, round("start", 4) AS "start", round("end", 4) AS "end" FROM tagged t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.key = t.key AND m.tag = t.tag AND t."start" <= coalesce(m.end_seconds, m.seconds) AND t."end" >= m.seconds)""")
def marker_overlap_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = segments.extract(views.series(spark, sf_dir), **RULES).withColumn("tag", F.col("key") % 3)
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id")
    marks = views.series(spark, sf_dir).join(events, F.col("idx") == F.col("event_id"), "left_semi").select(
        "key", (F.col("key") % 2).alias("tag"), F.col("time").alias("seconds"), F.when(F.col("idx") % 2 == 0, F.col("time") + 5).alias("end_seconds")
    )
    return joins.without_overlap(own, marks).select("key", "tag", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


# catalog

_CACHE = """cached AS (SELECT c_custkey AS key, '/lib/' || c_name AS path, c_custkey AS scene_id, CASE WHEN c_custkey % 3 = 0 THEN -108.0 ELSE 8.0 END AS "interval" FROM customer),
library AS (SELECT o_custkey AS key, CASE WHEN o_custkey % 4 = 0 THEN '/moved/' || min(c_name) ELSE '/lib/' || min(c_name) END AS path, CASE WHEN o_custkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS scene_id FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey)"""


def _catalog(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cached = c.select(
        F.col("c_custkey").alias("key"), F.concat(F.lit("/lib/"), "c_name").alias("path"), F.col("c_custkey").alias("scene_id"),
        F.when(F.col("c_custkey") % 3 == 0, -108.0).otherwise(8.0).alias("interval"),
    )
    used = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    library = c.join(used, c["c_custkey"] == used["o_custkey"]).select(
        F.col("c_custkey").alias("key"), F.concat(F.when(F.col("c_custkey") % 4 == 0, "/moved/").otherwise("/lib/"), "c_name").alias("path"),
        F.when(F.col("c_custkey") % 5 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("scene_id"),
    )
    return cached, library


_SYNC = f"""WITH {_CACHE}, synced AS (SELECT c.key, CASE WHEN l.key IS NULL THEN 'orphaned' WHEN l.path <> c.path OR l.scene_id <> c.scene_id THEN 'moved' ELSE 'unchanged' END AS status, coalesce(l.path, c.path) AS path, coalesce(l.scene_id, c.scene_id) AS scene_id FROM cached c LEFT JOIN library l ON l.key = c.key)"""


@query(f"{_SYNC} SELECT * FROM synced")
def sync_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reconcile(*_catalog(spark, sf_dir))


@query(f"{_SYNC} SELECT status, count(*) AS n FROM synced GROUP BY status")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.status_counts(catalog.reconcile(*_catalog(spark, sf_dir)))


@query(f"{_SYNC}, held AS (SELECT o_custkey, count(*) AS frames FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT status, count(*) AS n, CAST(coalesce(sum(frames), 0) AS BIGINT) AS frames FROM synced LEFT JOIN held ON key = o_custkey GROUP BY status")
def embed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes and frames by status; a customer's filled orders are its frames."""
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("frames"))
    return catalog.run_stats(catalog.reconcile(*_catalog(spark, sf_dir)).join(held, "key", "left"))


@query(f"{_SYNC} SELECT count(*) AS cached, count(*) FILTER (status = 'moved') AS moved, count(*) FILTER (status = 'orphaned') AS orphaned, count(*) FILTER (status = 'orphaned') AS pruned FROM synced")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.sync_counts(catalog.reconcile(*_catalog(spark, sf_dir), prune=True))


@query(f"""WITH {_CACHE} SELECT key, path FROM library l WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.key = l.key AND abs(c."interval" + 108) < 1e-6)""")
def embed_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached, library = _catalog(spark, sf_dir)
    scenes = library.withColumn("signature", names.interval_signature(F.lit("sparse"), F.lit(8.0)))
    return catalog.worklist(scenes, cached).select("key", "path")


@query("""WITH f AS (SELECT DISTINCT url AS path FROM pages), e AS (SELECT DISTINCT url FROM pages WHERE page_id % 2 = 0), x AS (SELECT url, min('page ' || page_id) AS error FROM pages WHERE page_id % 5 = 1 GROUP BY url), o AS (SELECT url, max('fmt' || CAST(page_id % 3 AS VARCHAR)) AS format FROM pages WHERE page_id % 7 = 0 GROUP BY url)
SELECT path, 'path-' || sha1(path)[1:16] AS key, e.url IS NOT NULL AS embedded, x.url IS NOT NULL AS failed, coalesce(error, '') AS error, format AS override FROM f LEFT JOIN e ON e.url = path LEFT JOIN x ON x.url = path LEFT JOIN o ON o.url = path""")
def qc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    embedded = pages.where("page_id % 2 = 0").select(names.path_key(F.col("path")).alias("key"))
    failed = pages.where("page_id % 5 = 1").groupBy("path").agg(F.min(F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("error"))
    override = pages.where("page_id % 7 = 0").groupBy("path").agg(F.max(F.concat(F.lit("fmt"), (F.col("page_id") % 3).cast("string"))).alias("format"))
    return catalog.quality_status(pages.select("path").distinct(), embedded, failed, override)


@query("SELECT page_id, 'path-' || sha1(url)[1:16] AS key, regexp_extract(url, '[^/\\\\]+$', 0) AS name FROM pages")
def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", names.path_key(F.col("url")).alias("key"), names.display_name(F.col("url")).alias("name"))


@query("SELECT c_custkey, c_name FROM customer WHERE 'lib/' || c_mktsegment = 'lib/BUILDING' OR starts_with('lib/' || c_mktsegment || '/' || c_name, 'lib/BUILDING/')")
def path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where(names.under_path(F.concat(F.lit("lib/"), "c_mktsegment", F.lit("/"), "c_name"), "lib/BUILDING/")).select("c_custkey", "c_name")


@query(f"WITH {FRAMES_SQL} SELECT key, count(*) AS frames, max(time) AS last FROM frames GROUP BY key")
def cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.frames(spark, sf_dir).groupBy("key").agg(F.count("*").alias("frames"), F.max("time").alias("last"))


def _by_model(spark, sf_dir):
    return views.frames(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), (F.col("category") % 3).cast("string")))


_BY_MODEL = f"WITH {FRAMES_SQL}, held AS (SELECT *, 'm' || CAST(category % 3 AS VARCHAR) AS model FROM frames)"


@query(f"{_BY_MODEL} SELECT DISTINCT key FROM held WHERE model = 'm1'")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.cache_keys(_by_model(spark, sf_dir), "m1")


@query(f"{_BY_MODEL} SELECT DISTINCT model FROM held")
def cache_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.cache_models(_by_model(spark, sf_dir))


@query(f"{_BY_MODEL} SELECT model, key, count(*) AS frames FROM held GROUP BY model, key")
def peek_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.peek_counts(_by_model(spark, sf_dir))


# candidates and sampling

_GATHER = f"""WITH {FRAMES_SQL}, {_SCORED_SQL}, ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.key ORDER BY score DESC, s.frame_idx) AS nth, f.category = 4 AS known FROM scored s JOIN frames f USING (key, frame_idx)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('0:' || key || ':' || frame_idx)) AS pick FROM ranked WHERE nth > {{top}} AND NOT known)
SELECT key, frame_idx, time, round(score, 6) AS score, 'top' AS pool FROM ranked WHERE nth <= {{top}} AND NOT known UNION ALL SELECT key, frame_idx, time, round(score, 6), 'random' FROM drawn WHERE pick <= {{chance}}"""


def _labeled(f: DataFrame) -> DataFrame:
    return f.where("category = 4").select("key", store.centiseconds(F.col("time")).alias("time_cs"))


@query(_GATHER.format(top=3, chance=1))
def candidates_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return candidates.gather(scored, _labeled(scored), 3, 1).select("key", "frame_idx", "time", *_r("score"), "pool")


@query(_GATHER.format(top=2, chance=1))
def suggest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return candidates.suggest(scored, _labeled(scored), likes=40, count=10**6).select("key", "frame_idx", "time", *_r("score"), "pool")


_DRAWN = "md5('0:' || key || ':' || frame_idx)"


@query(f"""WITH c AS ({_GATHER.format(top=3, chance=1)}) SELECT * FROM (SELECT * FROM c WHERE pool = 'top' ORDER BY score DESC, key, frame_idx LIMIT 15)
UNION ALL SELECT * FROM (SELECT * FROM c WHERE pool = 'random' ORDER BY {_DRAWN} LIMIT 5)""")
def candidates_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of twenty, of which the drawn frames keep their quarter."""
    scored = _scored(spark, sf_dir)
    return candidates.gather(scored, _labeled(scored), 3, 1, limit=20).select("key", "frame_idx", "time", *_r("score"), "pool")


@query(f"""WITH {FRAMES_SQL}, d AS (SELECT key, frame_idx, time, row_number() OVER (PARTITION BY key ORDER BY {_DRAWN}) AS nth FROM frames WHERE category <> 4)
SELECT key, frame_idx, time, 0.0::DOUBLE AS score, 'random' AS pool FROM d WHERE nth <= 3 ORDER BY {_DRAWN} LIMIT 25""")
def suggest_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too few likes: drawn frames only."""
    f = views.frames(spark, sf_dir)
    return candidates.suggest(f, _labeled(f), likes=3, count=25).select("key", "frame_idx", "time", "score", "pool")


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS duration FROM part)
SELECT p_partkey, len(g) AS n, round(list_sum(g), 3) AS total, g[-1] AS last FROM (SELECT p_partkey, list_transform(range(0, CAST(ceil((duration - 0.5) / 2.5) AS BIGINT)), lambda k: round(k * 2.5::DOUBLE + 0.5::DOUBLE, 3)) AS g FROM p)""")
def plan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = candidates.plan_grid(F.col("p_size").cast("double"), 2.5, 0.5)
    return table(spark, sf_dir, "part").select("p_partkey", grid.alias("g")).select(
        "p_partkey", F.size("g").cast("long").alias("n"), F.round(F.when(F.size("g") > 0, F.aggregate("g", F.lit(0.0), lambda a, x: a + x)), 3).alias("total"), F.try_element_at("g", F.lit(-1)).alias("last")
    )


@query(f"""WITH {SERIES_SQL}, b AS (SELECT key, idx, score, max(score) OVER (PARTITION BY key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM series)
SELECT key, idx, round(score, 6) AS pts FROM b WHERE before IS NULL OR score > before""")
def pts_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.numbered(views.series(spark, sf_dir)).withColumnRenamed("score", "pts")
    return candidates.increasing(rows, "key", "idx").select("key", F.col("idx").cast("long").alias("idx"), *_r("pts"))


# names and formats

@query("SELECT page_id, len(t) AS n, array_to_string(list_sort(t), ' ') AS words FROM (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM pages)")
def filename_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = names.tokens(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(t).cast("long").alias("n"), F.array_join(F.sort_array(t), " ").alias("words"))


_NAMES_SQL = """n AS (SELECT p_partkey, 'clip ' || ['MKX200_SBS', 'x_180_LR', '360.ou', 'fisheye190-tb', 'plain', 'mono 180', 'rf52'][p_partkey % 7 + 1] AS name,
  [NULL, 2.0, 1.0, 1.3][p_partkey % 4 + 1] AS aspect, [NULL, '180_sbs', 'mkx220_tb'][p_partkey % 3 + 1] AS assume FROM part)"""
_DETECT_SQL = f"""WITH {_NAMES_SQL},
t AS (SELECT *, regexp_split_to_array(lower(name), '[^a-z0-9]+') AS a, regexp_split_to_array(coalesce(assume, ''), '[^a-z0-9]+') AS b FROM n),
own AS (SELECT *, CASE WHEN list_contains(a, 'mkx200') THEN 200.0 WHEN list_contains(a, 'rf52') THEN 190.0 WHEN list_contains(a, 'fisheye190') THEN 190.0 END AS fish,
  CASE WHEN list_contains(a, '180') THEN 180.0 WHEN list_contains(a, '360') THEN 360.0 END AS angle,
  CASE WHEN list_contains(a, 'sbs') OR list_contains(a, 'lr') THEN 'sbs' WHEN list_contains(a, 'tb') OR list_contains(a, 'ou') THEN 'tb' WHEN list_contains(a, 'mono') THEN 'mono' END AS lay,
  CASE assume WHEN '180_sbs' THEN 'equirect' WHEN 'mkx220_tb' THEN 'fisheye' END AS proj2, CASE assume WHEN '180_sbs' THEN 180.0 WHEN 'mkx220_tb' THEN 220.0 END AS fov2, CASE assume WHEN '180_sbs' THEN 'sbs' WHEN 'mkx220_tb' THEN 'tb' END AS lay2 FROM t),
k AS (SELECT *, CASE WHEN fish IS NOT NULL THEN 'fisheye' WHEN angle IS NOT NULL THEN 'equirect' END AS proj, least(1.0, ((fish IS NOT NULL)::INT + (angle IS NOT NULL)::INT + (lay IS NOT NULL)::INT) / 3.0) AS conf,
  CASE WHEN lay IS NULL AND aspect >= 1.5 THEN 'sbs' WHEN lay IS NULL AND aspect <= 1.1 THEN 'tb' END AS seen FROM own),
d AS (SELECT p_partkey, coalesce(proj, proj2, 'unknown') AS projection, coalesce(lay, seen, lay2, 'unknown') AS layout, coalesce(fish, angle, fov2) AS fov, CASE WHEN assume IS NOT NULL THEN 0.3 ELSE conf END AS confidence,
  coalesce(nullif(concat_ws('+', CASE WHEN conf > 0 THEN 'filename' END, CASE WHEN seen IS NOT NULL THEN 'aspect' END, CASE WHEN assume IS NOT NULL THEN 'assumed' END), ''), 'none') AS source FROM k WHERE proj IS NULL OR lay IS NULL
  UNION ALL SELECT p_partkey, proj, lay, coalesce(fish, angle), conf, 'filename' FROM k WHERE proj IS NOT NULL AND lay IS NOT NULL)"""


def _formats(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    name = F.concat(F.lit("clip "), pick(["MKX200_SBS", "x_180_LR", "360.ou", "fisheye190-tb", "plain", "mono 180", "rf52"], 7))
    fmt = names.detect_format(name, pick([None, 2.0, 1.0, 1.3], 4), pick([None, "180_sbs", "mkx220_tb"], 3))
    return table(spark, sf_dir, "part").select("p_partkey", fmt.alias("f"))


@query(f"{_DETECT_SQL} SELECT p_partkey, projection, layout, CAST(fov AS DOUBLE) AS fov, round(CAST(confidence AS DOUBLE), 6) AS confidence, source FROM d")
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats(spark, sf_dir).select("p_partkey", "f.projection", "f.layout", "f.fov", F.round("f.confidence", 6).alias("confidence"), "f.source")


@query(f"""{_DETECT_SQL} SELECT p_partkey, CASE layout WHEN 'sbs' THEN 'crop=iw/2:ih:0:0,' WHEN 'tb' THEN 'crop=iw:ih/2:0:0,' ELSE '' END || 'scale=1600:1600,v360=' ||
CASE projection WHEN 'equirect' THEN 'input=he' ELSE 'input=fisheye:ih_fov=' || CAST(CAST(coalesce(fov, 180) AS INTEGER) AS VARCHAR) || ':iv_fov=' || CAST(CAST(coalesce(fov, 180) AS INTEGER) AS VARCHAR) END || ':output=flat:h_fov=100:v_fov=100:yaw=0:pitch=0:w=512:h=512' AS "filter"
FROM d WHERE layout <> 'unknown' AND (projection = 'fisheye' OR projection = 'equirect' AND coalesce(fov, 180) <= 180)""")
def dewarp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats(spark, sf_dir).select("p_partkey", names.dewarp_filter(F.col("f")).alias("filter")).where("filter IS NOT NULL")


@query("SELECT event_id, [round(value, 2), round(value + 0.5, 2)][1] AS first, 2 AS n FROM events")
def showinfo_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    log = F.concat(F.lit("[info] n:0 pts_time: "), F.format_string("%.2f", v), F.lit(" x\n[info] n:1 pts_time:"), F.format_string("%.2f", v + 0.5))
    t = names.log_times(log)
    return table(spark, sf_dir, "events").select("event_id", F.element_at(t, 1).alias("first"), F.size(t).alias("n"))


@query("SELECT doc_id, 'base' || CASE WHEN trim(c) = '' THEN '' ELSE ':' || regexp_replace(trim(c), '[^\\p{L}\\p{N}_-]', '_', 'g') END AS profile FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN ' ' ELSE text END AS c FROM documents)")
def resolve_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("lang") == "en", " ").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", names.resolve_profile(F.lit("base"), c).alias("profile"))


# models

_AUC = """WITH s AS (SELECT l.quality AS label, CAST(d.n_chars % 97 AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id))
SELECT 'n_chars' AS model, round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM (SELECT score FROM s WHERE label = 1) p, (SELECT score FROM s WHERE label = 0) n"""


@query(_AUC)
def auc_rank_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.lit("n_chars").alias("model"), F.col("quality").alias("label"), (F.col("n_chars") % 97).cast("double").alias("score")
    )
    return preference.auc(s).select("model", *_r("auc"))


def _examples(spark, sf_dir):
    return views.frames(spark, sf_dir).select("key", "frame_idx", "vec", (F.col("category") < 5).cast("int").alias("label"))


@query()
def train_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _examples(spark, sf_dir)
    return preference.predict(preference.train(data, "logreg"), data).select("key", "frame_idx", *_r("probability"))


@query()
def train_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _examples(spark, sf_dir)
    return preference.predict(preference.train(data, "mlp"), data).select("key", "frame_idx", *_r("probability"))


@query()
def train_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a profile trained on purchases and errors, and the model's probability for every frame."""
    marks = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')").select(
        F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("key"), ((F.col("event_id") % 4000).cast("double") / 10).alias("time"),
        (F.col("event_type") == "purchase").cast("int").alias("label"), F.lit("base").alias("profile"), F.col("event_id").cast("double").alias("ts"),
    )
    f = views.frames(spark, sf_dir)
    model, stats = preference.train_profile(marks, f, "base", "logreg", 0.1, 20000.0)
    scored = scorers.model_scorer(model)(f, "vec", "probability").select("key", "frame_idx", *_r("probability"))
    return scored.select("*", *(F.lit(v).alias(k) for k, v in stats.items()))


# streaming

@query("""SELECT user_id AS source, arg_max(event_type, event_id) AS path, arg_max(round(value, 2), event_id) AS current_time, arg_max(event_type <> 'error', event_id) AS playing, arg_max(CASE WHEN value > 100 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, event_id) AS speed, max(event_id) AS seq FROM events GROUP BY user_id""".replace("AS current_time", 'AS "current_time"'))
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playback packets as a stream, run over what is there."""
    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema)
    one_file = any(f.endswith("/events.parquet") for f in events.inputFiles())
    stream = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if one_file else source.parquet(f"{sf_dir}/events.parquet")
    packet = F.to_json(F.struct(
        F.col("event_type").alias("resource"), F.round("value", 2).alias("currentTime"), F.when(F.col("value") > 100, 2.0).otherwise(0.0).alias("playbackSpeed"),
        F.when(F.col("event_type") == "error", 1).alias("playerState"),
    ))
    states = stream.select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), playback.playback_state(packet).alias("s"))
    last = playback.latest_state(states.select("source", "seq", "s.path", "s.current_time", "s.playing", F.col("s.playback_speed").alias("speed")), "source", "seq")
    name = f"latest_state_{uuid.uuid4().hex}"
    return playback.run_to_table(last, name, shared_path(spark, name)).select("source", "path", "current_time", "playing", "speed", "seq")


# a library in pages

_PAGED_SQL = """WITH scenes AS (SELECT o_orderkey AS id, o_orderpriority AS title, '/lib/' || o_orderstatus || '/' || o_custkey || '/' || o_orderkey AS path, o_totalprice AS duration FROM orders)
SELECT CAST(id AS VARCHAR) AS scene_id, title, path, round(CAST(duration AS DOUBLE), 2) AS duration FROM scenes WHERE starts_with(path, '/lib/O/')"""


@query(_PAGED_SQL)
def paged_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenes of a library in pages, of which those under a folder are read."""
    file = F.struct(
        F.concat_ws("/", F.lit("/lib"), "o_orderstatus", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("path"), F.round(F.col("o_totalprice").cast("double"), 2).alias("duration")
    )
    scenes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.array(file).alias("files"))
    path = shared_path(spark, "library")
    paged.write_pages(scenes, path, 1000)
    return paged.read_pages(spark, path, "/lib/O/").select("scene_id", "title", "path", "duration")


@query("SELECT user_id AS source, event_id AS seq, event_type AS kind, round(value, 2) AS value FROM events")
def unframed_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets without framing, each cut into two chunks somewhere, put together again."""
    packet = F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.round("value", 2).alias("value"))).cast("binary")
    cut = F.col("event_id") % 23 + 1
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", packet.alias("packet"), cut.cast("int").alias("cut"))
    pieces = F.array(F.struct(F.lit(0).alias("nth"), F.expr("substring(packet, 1, cut)").alias("data")), F.struct(F.lit(1).alias("nth"), F.expr("substring(packet, cut + 1)").alias("data")))
    chunks = rows.select("user_id", "event_id", F.explode(pieces).alias("p")).select(F.col("user_id").alias("source"), (F.col("event_id") * 2 + F.col("p.nth")).alias("seq"), "p.data")
    held = F.from_json("message", "seq long, kind string, value double")
    return jsonstream.json_objects(chunks).select("source", held.alias("m")).select("source", "m.seq", "m.kind", "m.value")


# library records and byte strings

def _orders(spark, sf_dir):
    """Orders as scenes, their lines as files, markers and people; an order has a handful of lines."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    file = F.struct("l_linenumber", F.col("l_quantity").alias("duration"))
    person = F.struct("l_linenumber", F.col("l_suppkey").alias("id"), F.col("s_name").alias("name"))
    marker = F.struct(
        F.col("l_linenumber").alias("marker_id"), F.col("l_quantity").alias("seconds"), (F.col("l_quantity") * F.col("l_discount")).alias("end_seconds"),
        F.col("l_linestatus").alias("title"), F.array("l_returnflag", "l_linestatus").alias("tags"),
    )
    inside = lines.groupBy(F.col("l_orderkey").alias("scene_id")).agg(
        F.sort_array(F.collect_list(file)).alias("files"), F.sort_array(F.collect_list(person)).alias("people"), F.collect_list(marker).alias("markers")
    )
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    scenes = orders.select(F.col("o_orderkey").alias("scene_id"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("title"), F.col("c_name").alias("studio"))
    return scenes.join(inside, "scene_id", "left")


_LINES = "orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey"


@query(f"SELECT o_orderkey AS scene_id, l_linenumber AS marker_id, l_quantity AS seconds, nullif(l_quantity * l_discount, 0) AS end_seconds, l_linestatus AS title FROM {_LINES} WHERE l_returnflag = 'R'")
def markers_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.markers_by_tag(_orders(spark, sf_dir), "R")


@query(f"""SELECT o_orderkey AS scene_id, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE '' END AS title, c_name AS studio,
string_agg(s_name, '|' ORDER BY l_linenumber, l_suppkey) AS people, (list(l_quantity ORDER BY l_linenumber, l_quantity))[1] AS duration
FROM {_LINES} WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY o_orderkey, o_orderstatus, c_name""")
def scene_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("scene_id"))
    found = library.scene_details(_orders(spark, sf_dir), wanted).withColumn("people", F.array_join("people", "|"))
    return found.select("scene_id", "title", "studio", "people", "duration")


@query("SELECT count(DISTINCT o_orderkey) AS scenes FROM orders JOIN customer ON c_custkey = o_custkey")
def scene_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.scene_count(_orders(spark, sf_dir))


@query("""SELECT p_partkey AS scene_id, CASE WHEN n > 2 THEN 'often' ELSE p_name END AS title, coalesce(most, p_size) AS rating, coalesce(n > 1, false) AS organized
FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, CAST(max(l_quantity) AS INTEGER) AS most FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON l_partkey = p_partkey""")
def scene_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scenes, changed by what was sent back of them."""
    scenes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id"), F.col("p_name").alias("title"), F.col("p_size").alias("rating"), F.lit(False).alias("organized"))
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("scene_id"))
    changes = back.agg(F.count("*").alias("n"), F.max("l_quantity").cast("int").alias("rating"))
    return library.update_scenes(scenes, changes.select("scene_id", F.when(F.col("n") > 2, "often").alias("title"), "rating", (F.col("n") > 1).alias("organized")))


@query(f"SELECT DISTINCT o_orderkey AS scene_id FROM {_LINES} WHERE l_suppkey = 7")
def scenes_with_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.scenes_with(_orders(spark, sf_dir), F.lit(7))


@query(f"SELECT l_suppkey AS id, s_name AS name, count(DISTINCT o_orderkey) AS scene_count FROM {_LINES} WHERE regexp_matches(s_name, '[05]$') GROUP BY l_suppkey, s_name")
def find_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.find_people(_orders(spark, sf_dir), "[05]$")


@query("""WITH t AS (SELECT p_type AS name, 'id-' || CAST(min(p_partkey) AS VARCHAR) AS id FROM part WHERE p_size < 20 GROUP BY p_type), w AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT p_type FROM part)
SELECT coalesce(t.id, 'tag-' || sha1(name)[1:16]) AS id, name, t.id IS NULL AS created FROM t FULL JOIN w USING (name)""")
def tag_find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    tags = part.where("p_size < 20").groupBy(F.col("p_type").alias("name")).agg(F.concat(F.lit("id-"), F.min("p_partkey").cast("string")).alias("id"))
    return library.find_or_create_tags(tags, part.select(F.col("p_brand").alias("name")).union(part.select("p_type")))


_TAGS_SQL = "SELECT p_partkey AS scene_id, array_to_string(list_sort(list_distinct({})), ' ') AS tags FROM (SELECT *, string_split(p_type, ' ') AS t FROM part) p LEFT JOIN (SELECT l_partkey, list(DISTINCT 'mode-' || l_returnflag) || ['PROMO'] AS c FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey) ON l_partkey = p_partkey"


def _tagged(spark, sf_dir, mode):
    scenes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scene_id"), F.split("p_type", " ").alias("tags"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("scene_id"), F.concat(F.lit("mode-"), "l_returnflag").alias("tag"))
    changes = lines.union(lines.select("scene_id", F.lit("PROMO")))
    return library.change_tags(scenes, changes, mode).select("scene_id", F.array_join(F.sort_array(F.array_distinct("tags")), " ").alias("tags"))


@query(_TAGS_SQL.format("t || coalesce(c, [])"))
def bulk_tags_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, "add")


@query(_TAGS_SQL.format("list_filter(t, lambda x: NOT list_contains(coalesce(c, []), x))"))
def bulk_tags_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, "remove")


@query(r"SELECT p_partkey, 'http://lib/scene/' || p_partkey || '/stream' || CASE WHEN p_size > 25 THEN '?start=' || regexp_replace(printf('%.6f', p_retailprice), '\.?0+$', '') ELSE '' END AS url FROM part")
def stream_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("p_size") > 25, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", library.stream_url("http://lib/", F.col("p_partkey"), start).alias("url"))


@query(f"WITH {LABELS_SQL} SELECT key, time_cs, ts FROM store WHERE profile = 'base' AND label = 1 ORDER BY ts DESC LIMIT 50")
def marks_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(_store(spark, sf_dir), "base").select("key", "time_cs", "ts")


@query("""WITH e AS (SELECT user_id AS key, event_id, repeat('error ' || event_id || ' ', 60) AS error FROM events WHERE event_type = 'error'),
l AS (SELECT key, arg_max(error, event_id) AS error, max(event_id) AS ts FROM e WHERE event_id % 2 = 0 GROUP BY key),
f AS (SELECT key, arg_max(error, event_id)[1:500] AS error, max(event_id) AS ts FROM e WHERE event_id % 2 = 1 GROUP BY key)
SELECT key, error, ts FROM (SELECT * FROM f UNION ALL SELECT * FROM l WHERE key NOT IN (SELECT key FROM f)) WHERE key NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0)""")
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    text = F.repeat(F.concat(F.lit("error "), F.col("event_id").cast("string"), F.lit(" ")), F.lit(60))
    errors = events.where("event_type = 'error'").select(F.col("user_id").alias("key"), "event_id", text.alias("error"))
    last = lambda rows: rows.groupBy("key").agg(F.max_by("error", "event_id").alias("error"), F.max("event_id").alias("ts"))
    log = catalog.record_failures(last(errors.where("event_id % 2 = 0")), last(errors.where("event_id % 2 = 1")))
    done = events.where("event_type = 'purchase' AND user_id % 3 = 0").select(F.col("user_id").alias("key"))
    return catalog.resolve(log, done).select("key", "error", "ts").orderBy("ts")


@query(f"""{_DETECT_SQL} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN p_partkey % 4 = 0 THEN 'fisheye' ELSE projection END AS projection,
CASE WHEN p_partkey % 5 = 0 THEN 'mono' WHEN p_partkey % 4 = 0 THEN 'tb' ELSE layout END AS layout, CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 200 ELSE fov END AS DOUBLE) AS fov,
CASE WHEN p_partkey % 5 = 0 THEN 'override:flat' WHEN p_partkey % 4 = 0 THEN 'filename' ELSE source END AS source FROM d""")
def stored_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    name = F.concat(F.lit("clip "), pick(["MKX200_SBS", "x_180_LR", "360.ou", "fisheye190-tb", "plain", "mono 180", "rf52"], 7))
    token = pick(["mkx200 tb", None, "not a format", ""], 4)
    f = names.effective_format(token, k % 5 == 0, name, pick([None, 2.0, 1.0, 1.3], 4), pick([None, "180_sbs", "mkx220_tb"], 3))
    return table(spark, sf_dir, "part").select("p_partkey", f.alias("f")).select("p_partkey", "f.projection", "f.layout", "f.fov", "f.source")


@query("SELECT event_id, event_type AS message, 3 AS n FROM events")
def framed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's type between a ping and an unfinished frame, framed and read back: ping, message, ping."""
    frame = binary.frame_message
    stream = F.concat(frame(F.lit(None).cast("string")), frame(F.col("event_type")), frame(F.lit("")), F.unhex(F.lit("0000000941")))
    read = table(spark, sf_dir, "events").select("event_id", binary.unframe_messages(stream).alias("m"))
    return read.select("event_id", F.element_at("m", 2).alias("message"), F.size("m").alias("n"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS idx, md5(h[1 + 512 * i : 512 * (i + 1)]) AS piece FROM (SELECT doc_id, h, unnest(range(0, len(h) // 512)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents))""")
def fixed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = binary.fixed_chunks(F.col("text").cast("binary"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("idx", "piece")).withColumn("piece", F.md5(F.hex("piece").cast("binary")))


@query()
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no such random numbers; tests compare the vectors with numpy's."""
    return table(spark, sf_dir, "pages").select("page_id", binary.hashed_embedding(F.col("html").cast("binary"), 16).alias("vec"))


# stores, progress and live marks

def _picked(key: str, values: list):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


@query("""WITH m AS (SELECT p_partkey, ['dinov2_vits14', 'dinov2', 'dinov2_vitb14', 'dinov2_vitl14_reg', 'ViT-B-32', 'ViT-L-14', 'RN50 x/4'][p_partkey % 7 + 1] AS model FROM part)
SELECT p_partkey, CASE WHEN model IN ('dinov2_vits14', 'dinov2') THEN 'dinov2' WHEN model LIKE 'dino%' THEN 'dinov2-' || replace(replace(model, 'dinov2_', ''), '_', '-')
WHEN model = 'ViT-B-32' THEN 'clip' ELSE 'clip-' || replace(replace(lower(model), '/', '-'), ' ', '') END AS namespace FROM m""")
def model_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _picked("p_partkey", ["dinov2_vits14", "dinov2", "dinov2_vitb14", "dinov2_vitl14_reg", "ViT-B-32", "ViT-L-14", "RN50 x/4"])
    return table(spark, sf_dir, "part").select("p_partkey", names.model_namespace(model).alias("namespace"))


@query("""WITH m AS (SELECT p_partkey, ['sparse', 'interval', 'keyframes'][p_partkey % 3 + 1] AS mode, ['raw', 'jpeg'][p_partkey % 2 + 1] AS pipeline, CAST(p_size AS DOUBLE) AS step FROM part)
SELECT p_partkey, CASE mode WHEN 'keyframes' THEN -1.0::DOUBLE WHEN 'sparse' THEN -(100 + step) ELSE step END AS signature, mode = 'sparse' OR mode = 'interval' AND pipeline = 'raw' AS raw FROM m""")
def sampler_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode, pipeline = _picked("p_partkey", ["sparse", "interval", "keyframes"]), _picked("p_partkey", ["raw", "jpeg"])
    signature = names.interval_signature(mode, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", signature.alias("signature"), names.wants_raw(mode, pipeline).alias("raw"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    path = F.concat(F.lit("lib"), _picked("c_custkey", ["/", "\\", "/x\\", "\\y/"]), "c_name")
    return c.select("c_custkey", names.display_name(path).alias("name"))


@query(f"""WITH {_CACHE} SELECT key, path FROM library l WHERE EXISTS (SELECT 1 FROM cached c WHERE c.key = l.key AND abs(c."interval" + 108) < 1e-6)""")
def fresh_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached, library = _catalog(spark, sf_dir)
    scenes = library.withColumn("signature", names.interval_signature(F.lit("sparse"), F.lit(8.0)))
    return catalog.fresh(scenes, cached).select("key", "path")


@query(f"WITH {FRAMES_SQL} SELECT key, count(*) AS frames FROM frames WHERE key NOT IN (SELECT key FROM frames WHERE frame_idx = 0 AND category = 4) GROUP BY key")
def cache_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.frames(spark, sf_dir)
    return catalog.resolve(f, f.where("frame_idx = 0 AND category = 4")).groupBy("key").agg(F.count("*").alias("frames"))


@query("SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 'new ' ELSE 'old ' END || url AS format FROM pages WHERE NOT contains(url, '?')")
def override_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are stored, those of secure sites once more, and those with a query string taken out again."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = lambda rows, word: rows.select("page_id", F.concat(F.lit(word), "url").alias("format"))
    held = catalog.put(named(pages, "old "), named(pages.where(F.col("url").startswith("https:")), "new "), "page_id")
    return catalog.resolve(held, pages.where(F.col("url").contains("?")), "page_id")


@query("SELECT min(p_partkey) AS id, p_type AS name FROM part WHERE p_type = (SELECT min(p_type) FROM part) GROUP BY p_type")
def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    first = part.agg(F.min("p_type")).first()[0]
    return library.tag_named(part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")), first)


@query(f"""{_KEPT}, tagged AS (SELECT *, key % 3 AS tag FROM kept), m AS (SELECT user_id AS key, user_id % 2 AS tag, epoch(ts) / 3600 AS seconds FROM events WHERE event_type = 'purchase')
SELECT key, tag, round("start", 4) AS seconds, round("end", 4) AS end_seconds, CAST(tag AS VARCHAR) AS name FROM tagged t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.key = t.key AND m.tag = t.tag AND t."start" <= m.seconds AND t."end" >= m.seconds)""")
def new_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = segments.extract(views.series(spark, sf_dir), **RULES).withColumn("tag", F.col("key") % 3)
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id")
    marks = views.series(spark, sf_dir).join(events, F.col("idx") == F.col("event_id"), "left_semi")
    marks = marks.select("key", (F.col("key") % 2).alias("tag"), F.col("time").alias("seconds"), F.lit(None).cast("double").alias("end_seconds"))
    found = joins.new_markers(own, marks)
    return found.select("key", "tag", F.round("seconds", 4).alias("seconds"), F.round("end_seconds", 4).alias("end_seconds"), F.substring_index("title", " ", 1).alias("name"))


@query("""SELECT job, done, total, CASE WHEN done > 0 AND total > 0 THEN round(elapsed / done * (total - done), 1) END AS eta FROM (
SELECT user_id AS job, count(*) FILTER (event_type = 'purchase') AS done, count(*) AS total, CAST(max(event_id) - min(event_id) AS DOUBLE) AS elapsed FROM events GROUP BY user_id)""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("done"), F.count("*").alias("total"), (F.max("event_id") - F.min("event_id")).cast("double").alias("elapsed")
    )
    return catalog.progress(steps).select("job", "done", "total", "eta")


@query("""WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS path FROM events GROUP BY user_id),
m AS (SELECT DISTINCT user_id, event_id, unnest([floor(value), floor(value) + event_id % 2]) AS t FROM events WHERE event_type = 'purchase')
SELECT 'path-' || sha1(path)[1:16] AS key, t AS time, CAST(event_id AS DOUBLE) AS ts FROM m JOIN s USING (user_id) WHERE path <> 'error'""")
def live_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases mark what their user plays last; users at an error play nothing."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "source")
    states = playback.latest_state(events.select("source", "event_id", F.col("event_type").alias("path")), "source", "event_id")
    states = states.withColumn("path", F.nullif("path", F.lit("error"))).select("source", "path")
    at = F.floor("value").cast("double")
    marks = events.where("event_type = 'purchase'").select(
        "source", at.alias("in_time"), (at + F.col("event_id") % 2).alias("time"), F.lit(None).cast("double").alias("out_time"), F.col("event_id").cast("double").alias("marked_at")
    )
    return playback.marks_to_labels(marks, states, "base").select("key", "time", "ts")


@query("""WITH p AS (SELECT user_id AS source, ts, ts - lag(ts) OVER w <= INTERVAL 6 HOUR AS goes_on FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT source, ts, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM p)
SELECT source, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS packets FROM n GROUP BY source, nth""")
def connected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a user's events without a silence of six hours."""
    packets = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "ts")
    return playback.connections(packets, "6 hours").select("source", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "packets")
