"""Preference models: recency weights, logistic and neural classifiers, AUC."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronovec.functions.vectors import dot
from chronovec.sources.shared import written

from .joins import nearest
from .slices import Slices, latest

NEURAL_FROM = 200


def recency_weights(labels: DataFrame, halflife_days: float, now: float) -> DataFrame:
    """labels with weight: halved each half-life, at least 0.05; unknown times (0) count as the oldest known one."""
    if halflife_days <= 0:
        return labels.withColumn("weight", F.lit(None).cast("double"))
    known = labels.where("ts > 0").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    age = F.greatest(F.lit(0.0), F.greatest(F.col("newest"), F.lit(now)) - F.when(F.col("ts") > 0, F.col("ts")).otherwise(F.col("oldest")))
    weight = F.greatest(F.lit(0.05), F.pow(F.lit(0.5), age / 86400.0 / halflife_days))
    # one row is joined to each label
    return labels.crossJoin(F.broadcast(known)).withColumn("weight", weight).drop("oldest", "newest")


def _times(times: str | None):
    return F.col(times) if times else F.lit(1)


def train(data: DataFrame, kind: str = "auto", weight: str | None = None, seed: int = 0, times: str | None = None):
    """A fitted model of data(vec, label); auto takes the neural one from NEURAL_FROM rows on.

    With `times`, a row stands for as many equal ones; `weight` is then the sum of theirs. The neural model takes single rows only.

    The logistic one balances classes and has the penalty 1/2 |b|^2 beside the summed loss. The neural one knows no
    weights: rows are drawn again within each class, with replacement and in proportion to theirs. One class alone, or vectors of several
    lengths, raise ValueError.
    """
    sizes = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.sum(_times(times)).alias("n")).collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        raise ValueError("both classes are needed")
    if times and kind != "logreg":
        raise ValueError("only the logistic model takes rows that stand for several")
    rows = data.withColumn("features", array_to_vector("vec")).withColumn("label", F.col("label").cast("double"))
    if kind == "mlp" or (kind == "auto" and n >= NEURAL_FROM):
        width = _width(rows)
        if weight:
            rows = _drawn_again(rows, weight, seed)
        return MultilayerPerceptronClassifier(layers=[width, 128, 2], seed=seed, maxIter=60).fit(rows)
    _width(rows)
    balance = F.when(F.col("label") == 1, n / (2.0 * sizes[1])).otherwise(n / (2.0 * sizes[0]))
    rows = rows.withColumn("w", balance * (F.col(weight) if weight else _times(times)))
    total = rows.agg(F.sum("w")).first()[0]
    return LogisticRegression(weightCol="w", standardization=False, regParam=1.0 / total, maxIter=200, tol=1e-9).fit(rows)


def _width(rows: DataFrame) -> int:
    sizes = rows.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError("vectors have several lengths")
    return sizes["most"]


def drawn_rows(rows: DataFrame, weight: str, seed: int) -> DataFrame:
    """(_row, times): a bootstrap of rows(_row, label, weight): from each label as many draws as it has rows, with replacement, by weight.

    Weights, 1e-9 at least, are cumulated in order of _row; a draw is a hashed number below their sum, and falls on the row in
    whose share it lies. Rows and draws are ordered together in ranges, and a draw takes the last row before it: no label is one task.
    """
    own = Slices(rows.select("_row", "label", F.greatest(F.col(weight).cast("double"), F.lit(1e-9)).alias("w")), "label", ["_row"])
    own.carry("before", F.sum("w"), F.sum)
    start = F.coalesce(F.sum("w").over(own.along(preceding=True)), F.lit(0.0)) + F.coalesce("before", F.lit(0.0))
    shares = written(own.rows.select("label", "_row", "w", start.alias("start")), "shares")
    totals = {r["label"]: (r["n"], r["total"]) for r in shares.groupBy("label").agg(F.count("*").alias("n"), F.max(F.col("start") + F.col("w")).alias("total")).collect()}
    both = shares.select("label", F.col("start").alias("at"), F.lit(0).alias("kind"), "_row", F.lit(None).cast("long").alias("draw"))
    for label, (n, total) in totals.items():
        share = F.shiftrightunsigned(F.xxhash64("id", F.lit(int(label)), F.lit(seed)), 11).cast("double") / float(1 << 53)
        draws = rows.sparkSession.range(n).select(F.lit(label).alias("label"), (share * total).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("_row"), F.col("id").alias("draw"))
        both = both.unionByName(draws)
    met = Slices(both, "label", ["at", "kind", "_row", "draw"])
    met.carry("row_in", F.max_by("_row", F.when(F.col("_row").isNotNull(), F.struct("at", "_row"))), latest)
    found = met.rows.withColumn("found", F.coalesce(F.last("_row", ignorenulls=True).over(met.along()), F.col("row_in")))
    return found.where("kind = 1").groupBy(F.col("found").alias("_row")).agg(F.count("*").cast("int").alias("times"))


def _drawn_again(rows: DataFrame, weight: str, seed: int) -> DataFrame:
    """A weighted bootstrap of rows(label, ...); labels keep their sizes."""
    held = written(rows.withColumn("_row", F.monotonically_increasing_id()), "examples")
    times = written(drawn_rows(held, weight, seed), "draws")
    return held.join(times, "_row").withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).drop("_row", "times", "again")


def save(model, path: str) -> None:
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load(path: str):
    return PipelineModel.load(path).stages[0]


def predict(model, rows: DataFrame) -> DataFrame:
    """rows with the probability of label 1; no rows give none, a vector of another length than the model's raises."""
    wrong = F.raise_error(F.concat(F.lit(f"vectors need {model.numFeatures} numbers, one has "), F.size("vec").cast("string")))
    held = F.when(F.size("vec") == model.numFeatures, F.col("vec")).otherwise(wrong)
    scored = model.transform(rows.withColumn("features", array_to_vector(held)))
    return scored.withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def auc(scored: DataFrame, score: str = "score", label: str = "label", by: str = "model", times: str | None = None) -> DataFrame:
    """Area under the ROC curve of each group from ranks of distinct scores; ties count half. With `times`, a row stands for as many.

    Counts are summed for each distinct score first. Scores are then dealt into ranges, so that ranks are sums within
    a range and of the ranges before it, and no group is one task.
    """
    of_label = lambda y: F.sum(F.when(F.col(label) == y, _times(times)).otherwise(0))
    steps = scored.groupBy(by, score).agg(of_label(1).alias("pos"), of_label(0).alias("neg"))
    ranges = written(steps.repartitionByRange(by, score).withColumn("part", F.spark_partition_id()), "scores")
    earlier = Window.partitionBy("group").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and range
    offsets = ranges.groupBy(F.col(by).alias("group"), F.col("part").alias("of_part")).agg(F.sum("neg").alias("n"))
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy(by, "part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        ranges.withColumn("inside", inside)
        .join(offsets, F.col(by).eqNullSafe(F.col("group")) & (F.col("part") == F.col("of_part")))
        .withColumn("wins", F.col("pos") * (F.col("offset") + F.col("inside") + F.col("neg") / 2.0))
        .groupBy(by)
        .agg((F.sum("wins") / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def stratified_folds(data: DataFrame, folds: int, seed: int = 0, buckets: int = 1024, times: str | None = None) -> DataFrame:
    """data(vec, label) with fold from 0: each fold gets as many rows of a label as the others, but for one.

    Rows are counted within buckets of a label, behind the buckets before; no label is one task. With `times`, a row that stands for
    several is dealt out as these would be: it comes once for each fold that gets some, with their number.
    """
    draw = F.xxhash64("vec", F.lit(seed))
    own = data.withColumn("draw", draw).withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    before = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most `buckets` rows a label
    offsets = own.groupBy("label", "bucket").agg(F.sum(_times(times)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    earlier = F.sum(_times(times)).over(Window.partitionBy("label", "bucket").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("nth", F.coalesce(earlier, F.lit(0))).join(offsets, ["label", "bucket"]).withColumn("nth", F.col("nth") + F.col("offset"))
    if times:
        # of the places nth + 1 to nth + times those that leave the fold as remainder
        upto = lambda at: F.floor((at - F.col("fold")) / folds)
        own = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn(times, upto(F.col("nth") + F.col(times)) - upto(F.col("nth"))).where(F.col(times) > 0)
    else:
        own = own.withColumn("fold", F.pmod(F.col("nth") + 1, F.lit(folds)).cast("int"))
    return own.drop("draw", "bucket", "nth", "offset")


def fold_models(dealt: DataFrame, folds: int, most_steps: int = 50, tol: float = 1e-10, times: str | None = None) -> np.ndarray:
    """(folds, width + 1) weights and intercept of the logistic models that leave one fold of dealt(vec, label, fold) out each.

    Newton's method for all folds at once: a step is one pass, in which tasks add up the gradients and Gram matrices of all
    models; sums of tasks are added in two rounds. The loss is train's: classes balanced, penalty 1/2 |b|^2 without the intercept.
    A result has folds * width^2 numbers. With `times`, a row stands for as many equal ones.
    """
    width = _width(dealt)
    n = np.zeros((folds, 2))
    for r in dealt.groupBy("fold", "label").agg(F.sum(_times(times)).alias("n")).collect():
        n[np.arange(folds) != r["fold"], int(r["label"])] += r["n"]
    if (n == 0).any():
        raise ValueError("both classes are needed")
    balance = n.sum(1, keepdims=True) / (2 * n)
    size = width + 1
    beta = np.zeros((folds, size))
    rows = dealt.select("vec", F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"), _times(times).cast("double").alias("times"))
    parts = max(1, int(dealt.rdd.getNumPartitions() ** 0.5))

    def sums(known: np.ndarray):
        def run(batches):
            gradient, gram = np.zeros((folds, size)), np.zeros((folds, size, size))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.stack([np.asarray(v, float) for v in batch.column("vec").to_pandas()])
                x = np.hstack([x, np.ones((len(x), 1))])
                y, fold, many = (batch.column(c).to_numpy() for c in ("label", "fold", "times"))
                for k in range(folds):
                    own = fold != k
                    z, w = x[own], balance[k][y[own]] * many[own]
                    p = 1 / (1 + np.exp(-np.clip(z @ known[k], -500, 500)))
                    gradient[k] += z.T @ (w * (p - y[own]))
                    gram[k] += (z * (w * p * (1 - p))[:, None]).T @ z
            yield packed(gradient, gram)

        return run

    def packed(gradient: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
        flat = [np.concatenate([g, h.ravel()]).tolist() for g, h in zip(gradient, gram)]
        return pa.RecordBatch.from_arrays([pa.array(range(folds), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["model", "sums"])

    def added(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        total = np.sum(np.stack([np.asarray(v) for v in found.column("sums").to_pandas()]), axis=0)
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema = "model int, sums array<double>"
    for _ in range(most_steps):
        each = rows.mapInArrow(sums(beta), schema)
        if parts > 1:
            each = each.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(parts))).groupBy("model", "group").applyInArrow(added, schema)
        step = np.zeros_like(beta)
        penalty = np.diag([1.0] * width + [0.0])
        for r in each.groupBy("model").applyInArrow(added, schema).toArrow().to_pylist():
            k, flat = r["model"], np.array(r["sums"])
            gradient, gram = flat[:size] + penalty @ beta[k], flat[size:].reshape(size, size) + penalty
            step[k] = np.linalg.solve(gram + 1e-12 * np.eye(size), gradient)
        beta = beta - step
        if np.abs(step).max() < tol:
            break
    return beta


def cross_validated_auc(data: DataFrame, folds: int = 5, kind: str = "logreg", seed: int = 0, times: str | None = None) -> float:
    """Mean AUC over stratified folds, at most as many as the smaller class has rows; logistic models of all folds in one go.

    With `times`, for logistic models only, a row stands for as many equal ones.
    """
    least = data.groupBy("label").agg(F.sum(_times(times)).alias("n")).agg(F.min("n")).first()[0]
    folds = min(folds, least)
    dealt = written(stratified_folds(data, folds, seed, times=times), "folds")
    if kind == "logreg":
        beta = fold_models(dealt, folds, times=times)
        weights = F.array(*(F.array(*(F.lit(float(x)) for x in b)) for b in beta))
        own = F.element_at(weights, F.col("fold") + 1)
        scored = dealt.select(F.col("fold").alias("model"), "label", _times(times).alias("times"), (dot(F.col("vec"), F.slice(own, 1, beta.shape[1] - 1)) + F.element_at(own, -1)).alias("score"))
        found = [r["auc"] for r in auc(scored, times="times").collect()]
    else:
        held = lambda i: predict(train(dealt.where(F.col("fold") != i), kind), dealt.where(F.col("fold") == i)).withColumn("model", F.lit(0))
        found = [auc(held(i), "probability").first()["auc"] for i in range(folds)]
    return sum(found) / len(found)


def labeled_frames(labels: DataFrame, frames: DataFrame, profile: str) -> DataFrame:
    """(key, frame_idx, label, ts) of the frame nearest to each of a profile's labels(key, time, label, profile, ts); others drop out."""
    own = labels.where(F.col("profile") == profile).select("key", F.col("time").cast("double").alias("time"), "label", F.coalesce("ts", F.lit(0.0)).alias("ts"))
    return nearest(own, frames).select("key", "frame_idx", F.col("label").cast("int").alias("label"), "ts")


def with_vectors(near: DataFrame, frames: DataFrame) -> DataFrame:
    """near(key, frame_idx, ...) with vec in their place."""
    return near.join(frames.select("key", F.col("frame_idx").cast("long").alias("frame_idx"), "vec"), ["key", "frame_idx"]).drop("key", "frame_idx")


def training_set(labels: DataFrame, frames: DataFrame, profile: str) -> DataFrame:
    """(vec, label, ts) of labeled_frames."""
    return with_vectors(labeled_frames(labels, frames, profile), frames).select("vec", "label", "ts")


def train_profile(labels: DataFrame, frames: DataFrame, profile: str, kind: str = "logreg", halflife_days: float = 0.0, now: float = 0.0, folds: int = 5, seed: int = 0):
    """(model, statistics) for a profile's labels: samples, positives, kind, recency, and for logistic ones cv_auc and cv_folds.

    auto takes the neural model from NEURAL_FROM samples on. With a half-life, and where any label's time is known, recent
    labels weigh more; the cross-validation stays without weights. Labels of one frame are one row with their number and summed weight:
    the loss of a logistic model is the same. A network gets a row for each label.
    """
    near = written(labeled_frames(labels, frames, profile), "training-set")
    recency = halflife_days > 0 and bool(near.where("ts > 0").take(1))
    weighed = recency_weights(near, halflife_days, now) if recency else near.withColumn("weight", F.lit(1.0))
    equal = weighed.groupBy("key", "frame_idx", "label").agg(F.count("*").alias("times"), F.sum("weight").alias("weight"))
    data = written(with_vectors(equal, frames), "examples")
    sizes = data.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("times"))), F.lit(0)).alias("pos")).first()
    if not 0 < sizes["pos"] < sizes["n"]:
        raise ValueError("both classes are needed")
    resolved = ("mlp" if sizes["n"] >= NEURAL_FROM else "logreg") if kind == "auto" else kind
    if resolved == "logreg":
        model = train(data, resolved, "weight", seed, "times")
    else:
        model = train(with_vectors(weighed, frames), resolved, "weight" if recency else None, seed)
    stats = {"samples": sizes["n"], "positives": sizes["pos"], "kind": resolved, "recency": recency}
    folds = min(folds, sizes["pos"], sizes["n"] - sizes["pos"])
    if resolved == "logreg" and folds >= 2:
        stats |= {"cv_auc": round(cross_validated_auc(data.select("vec", "label", "times"), folds, seed=seed, times="times"), 3), "cv_folds": folds}
    return model, stats
