"""Series operators against loops written from their definitions."""

import math
import random

import pytest

from chronovec.operators import candidates, scoring, segments

SCHEMA = "key string, idx long, time double, score double"


def series(spark, scores, step=1.0, key="a"):
    return spark.createDataFrame([(key, i, i * step, float(s)) for i, s in enumerate(scores)], SCHEMA)


def loop(points, high, low, min_duration, gap, longest, pad):
    out, run = [], None
    for t, s in points:
        if run is None and s >= high:
            run = []
        elif run is not None and s < low:
            out.append(run)
            run = None
        if run is not None:
            run.append((t, s))
    if run:
        out.append(run)
    segs = [[r[0][0], r[-1][0], max(s for _, s in r), sum(s for _, s in r) / len(r)] for r in out]

    def join(items, near):
        got = []
        for s in items:
            if got and s[0] - got[-1][1] <= near:
                a = got[-1]
                da, db = a[1] - a[0], s[1] - s[0]
                mean = (a[3] * da + s[3] * db) / (da + db) if da + db > 0 else (a[3] + s[3]) / 2
                got[-1] = [a[0], max(a[1], s[1]), max(a[2], s[2]), mean]
            else:
                got.append(list(s))
        return got

    kept = [s for s in join(segs, gap) if s[1] - s[0] >= min_duration]
    if longest:
        cut = []
        for s in kept:
            n = max(1, math.ceil((s[1] - s[0]) / longest))
            cut += [[s[0] + i * longest, min(s[0] + (i + 1) * longest, s[1]), s[2], s[3]] for i in range(n)]
        kept = cut
    if pad:
        lo, hi = points[0][0], points[-1][0]
        kept = join([[max(lo, s[0] - pad), min(hi, s[1] + pad), s[2], s[3]] for s in kept], 0.0)
    return kept


@pytest.mark.parametrize("longest,pad", [(None, 0.0), (4.0, 0.0), (None, 0.5), (4.0, 0.5)])
def test_extraction_equals_the_loop(spark, longest, pad):
    rng = random.Random(1)
    data = {f"k{j}": [(i * 0.5, rng.random()) for i in range(rng.choice([1, 2, 30, 120]))] for j in range(12)}
    rows = [(k, i, t, s) for k, pts in data.items() for i, (t, s) in enumerate(pts)]
    got = {}
    for r in segments.extract(spark.createDataFrame(rows, SCHEMA), 0.7, 0.3, 1.0, 0.6, longest, pad).collect():
        got.setdefault(r.key, []).append((r.start, r.end, r.peak, r["mean"]))
    for k, pts in data.items():
        want = loop(pts, 0.7, 0.3, 1.0, 0.6, longest, pad)
        assert len(want) == len(got.get(k, []))
        for a, b in zip(sorted(got.get(k, [])), want):
            assert a == pytest.approx(tuple(b))


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_small_cases(spark):
    one = series(spark, [0, 0, 0, 1, 1, 1, 1, 0, 0, 0])
    assert spans(segments.extract(one, 0.5, min_duration=1, merge_gap=0)) == [(3.0, 6.0)]
    dip = series(spark, [0, 0.8, 0.4, 0.8, 0, 0])
    assert spans(segments.extract(dip, 0.5, 0.3, 1, 0)) == [(1.0, 3.0)]
    assert spans(segments.extract(series(spark, [0, 0, 1, 0, 0]), 0.5, min_duration=2, merge_gap=0)) == []
    two = series(spark, [1, 1, 0, 0, 1, 1])
    assert spans(segments.extract(two, 0.5, min_duration=1, merge_gap=3)) == [(0.0, 5.0)]
    assert len(spans(segments.extract(two, 0.5, min_duration=1, merge_gap=1))) == 2
    assert spans(segments.extract(series(spark, [0, 1, 1, 0]), 0.5, min_duration=1, merge_gap=0, padding=10)) == [(0.0, 3.0)]
    assert spans(segments.extract(series(spark, []), 0.5)) == []
    held = series(spark, [1, float("nan"), 1, 0])
    assert spans(segments.extract(held, 0.5, min_duration=1, merge_gap=0)) == [(0.0, 2.0)]
    pieces = spans(segments.extract(series(spark, [1] * 10), 0.5, min_duration=1, merge_gap=0, max_duration=3))
    assert len(pieces) == 3 and all(b - a <= 3 for a, b in pieces)
    with pytest.raises(ValueError):
        segments.runs(one, 0.3, 0.5)


def test_smoothing_reflects(spark):
    rng = random.Random(2)
    for n, w in ((1, 3), (2, 5), (5, 4), (5, 9), (6, 20), (20, 3), (20, 5)):
        x = [rng.random() for _ in range(n)]
        width = min(w, n)
        p = width // 2
        mirror = lambda i: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
        want = [sum(x[mirror(i + d)] for d in range(-p, width - p)) / width for i in range(n)]
        got = [r.score for r in scoring.smooth(series(spark, x), w).orderBy("idx").collect()]
        assert got == pytest.approx(want)


def test_standardizing_constant_series(spark):
    assert {r.score for r in scoring.standardize(series(spark, [2, 2, 2]), "scene-z").collect()} == {0.0}
    with pytest.raises(ValueError):
        scoring.standardize(series(spark, [1]), "other")


def test_blocks_of_references_agree(spark, monkeypatch):
    rng = random.Random(3)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    frames = spark.createDataFrame([("a", i, vec()) for i in range(20)] + [("z", 0, [0.0] * 6)], "key string, frame_idx int, vec array<double>")
    refs = spark.createDataFrame([(vec(),) for _ in range(9)], "vec array<double>")
    by_frame = lambda df: {(r.key, r.frame_idx): r.score for r in df.collect()}
    for reduce in ("max", "mean"):
        whole = by_frame(scoring.similarity_scores(frames, refs, reduce))
        for size in (2, 8):
            with monkeypatch.context() as m:
                m.setattr(scoring, "BLOCK", size), m.setattr(scoring, "REFERENCES_OF_SLICE", 3)
                parts = scoring.similarity_scores(frames, refs, reduce)
                assert by_frame(parts) == pytest.approx(whole) and parts.columns == [*frames.columns, "score"] and len(whole) == 21
    with pytest.raises(ValueError):
        scoring.similarity_scores(frames, refs.limit(0))


def test_grid_and_increasing_times(spark):
    rows = spark.createDataFrame([(10.0, 2.0), (0.5, 2.0), (0.0, 2.0), (-1.0, 2.0)], "d double, i double")
    assert [r.g for r in rows.select(candidates.plan_grid(rows.d, 2.0).alias("g")).collect()] == [[0, 2, 4, 6, 8], [0], [], []]
    pts = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.0, 1.0, 1.0, None, 0.5, 2.0])], "key string, frame_idx int, pts double")
    assert [r.frame_idx for r in candidates.increasing(pts).orderBy("frame_idx").collect()] == [0, 1, 3, 5]


def test_series_cut_anywhere_equal_the_loop(spark):
    rng = random.Random(9)
    data = {"long": [(i * 0.5, rng.random()) for i in range(160)], "short": [(0.0, 0.9)], "still": [(i * 1.0, 0.1) for i in range(40)], "on": [(i * 1.0, 0.9) for i in range(40)]}
    data["gaps"] = [(i * 1.0, rng.choice([0.9, 0.5, 0.1])) for i in range(90)]
    rows = [(k, i, t, s) for k, pts in data.items() for i, (t, s) in enumerate(pts)]
    rng.shuffle(rows)
    own = spark.createDataFrame(rows, SCHEMA)
    for size in (40, 1000):
        got = {}
        found = segments.merge(segments.runs(own, 0.7, 0.3, size), 0.6, size)
        for r in found.collect():
            got.setdefault(r.key, []).append((r.start, r.end, r.peak, r["mean"]))
        for k, pts in data.items():
            want = loop(pts, 0.7, 0.3, 0, 0.6, None, 0)
            assert len(want) == len(got.get(k, []))
            for a, b in zip(sorted(got.get(k, [])), want):
                assert a == pytest.approx(tuple(b))


def test_a_long_island_is_folded_over_slices(spark):
    rng = random.Random(10)
    parts = [(i * 1.0, i * 1.0 + rng.choice([0.0, 0.5, 1.2, 30.0]), rng.random(), rng.random()) for i in range(400)]
    shuffled = [("a", *p) for p in rng.sample(parts, len(parts))] + [("b", 5.0, 5.0, 0.5, 0.2), ("b", 5.0, 5.0, 0.7, 0.6)]
    want = list(parts[0])
    for s in parts[1:]:
        left, right = want[1] - want[0], s[1] - s[0]
        mean = (want[3] * left + s[3] * right) / (left + right) if left + right > 0 else (want[3] + s[3]) / 2
        want = [want[0], max(want[1], s[1]), max(want[2], s[2]), mean]
    for size in (60, 5000):
        found = segments.merge(spark.createDataFrame(shuffled, "key string, start double, end double, peak double, mean double"), 1.0, size).collect()
        got = {r.key: (r.start, r.end, r.peak, r["mean"]) for r in found}
        assert len(found) == 2 and got["a"] == pytest.approx(tuple(want)) and got["b"] == pytest.approx((5.0, 5.0, 0.7, 0.4))


def test_smoothing_and_increasing_times_over_slices(spark):
    rng = random.Random(11)
    for n, w in ((1, 3), (6, 20), (50, 7), (50, 4)):
        x = [rng.random() for _ in range(n)]
        own = series(spark, x)
        whole = [r.score for r in scoring.smooth(own, w).orderBy("idx").collect()]
        for size in (4,):
            rows = scoring.smooth(own, w, size).orderBy("idx").collect()
            assert [r.score for r in rows] == pytest.approx(whole) and [r.idx for r in rows] == list(range(n))
    pts = [rng.choice([None, *range(30)]) for _ in range(120)]
    rows = spark.createDataFrame([("a", i, None if p is None else float(p)) for i, p in enumerate(pts)], "key string, frame_idx int, pts double")
    kept, top = [], -1.0
    for i, p in enumerate(pts):
        if p is None or p > top:
            kept.append(i)
        top = max(top, p if p is not None else top)
    for size in (30, 1000):
        assert [r.frame_idx for r in candidates.increasing(rows, size=size).orderBy("frame_idx").collect()] == kept
