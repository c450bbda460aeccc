"""Scorers: what turns frames into scores, to be handed to the operators that score, segment, recommend and gather.

A scorer is a function of frames that adds a column of scores; it may be made of a column expression, of a function of
matrices, of reference vectors or of a fitted model. Whatever it is made of, a null vector has a null score, and a series
goes on over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronovec.functions.vectors import dot

#: frames, the column of vectors, the column to add.
Scorer = Callable[[DataFrame, str, str], DataFrame]


def column_scorer(score: Callable[[Column], Column]) -> Scorer:
    """Scores by an expression of the vector, which stays in the plan with all that Spark can do about it."""

    def run(frames: DataFrame, vec: str = "vec", into: str = "score") -> DataFrame:
        return frames.withColumn(into, F.when(F.col(vec).isNotNull(), score(F.col(vec)).cast("double")))

    return run


def arrow_scorer(score: Callable[[np.ndarray], np.ndarray]) -> Scorer:
    """Scores by a function of an (n, d) matrix of doubles to n numbers, called for the vectors of an Arrow batch.

    Vectors of one batch that differ in length, or another number of scores than vectors, raise ValueError.
    """

    def batch(vectors: pd.Series) -> pd.Series:
        held = vectors.notna().to_numpy()
        out = np.full(len(vectors), np.nan)
        if held.any():
            rows = [np.asarray(v, float) for v in vectors[held]]
            if len({len(r) for r in rows}) > 1:
                raise ValueError("vectors have several lengths")
            found = np.asarray(score(np.stack(rows)), float)
            if found.shape != (len(rows),):
                raise ValueError(f"{len(rows)} vectors got scores of shape {found.shape}")
            out[held] = found
        return pd.Series(out)

    def run(frames: DataFrame, vec: str = "vec", into: str = "score") -> DataFrame:
        found = F.pandas_udf(batch, "double")(F.col(vec))
        return frames.withColumn(into, F.when(F.col(vec).isNotNull(), found))

    return run


def similarity_scorer(refs: DataFrame, reduce: str = "max") -> Scorer:
    """Scores by the largest or mean cosine with refs(vec)."""
    from .scoring import similarity_scores

    return lambda frames, vec="vec", into="score": similarity_scores(frames, refs if vec == "vec" else refs.withColumnRenamed("vec", vec), reduce, vec, into)


def logistic_scorer(weights: Sequence[float], intercept: float = 0.0) -> Scorer:
    """Scores by 1 / (1 + exp(-(weights . vec + intercept))); a vector of another length than the weights raises."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    wrong = F.raise_error(F.lit(f"vectors need {len(weights)} numbers")).cast("double")

    def score(vec: Column) -> Column:
        return F.when(F.size(vec) == len(weights), 1 / (1 + F.exp(-(dot(vec, w) + float(intercept))))).otherwise(wrong)

    return column_scorer(score)


def model_scorer(model) -> Scorer:
    """Scores by a fitted model's probability of label 1; a logistic one as a column expression."""
    if isinstance(model, LogisticRegressionModel):
        return logistic_scorer(model.coefficients.toArray().tolist(), model.intercept)
    from .preference import predict

    def run(frames: DataFrame, vec: str = "vec", into: str = "score") -> DataFrame:
        rows = frames.withColumn("_vec", F.col(vec)) if vec != "vec" else frames
        known = predict(model, rows.where(F.col(vec).isNotNull()).withColumn("vec", F.col(vec))).withColumnRenamed("probability", into)
        if vec != "vec":
            known = known.withColumn(vec, F.col("_vec"))
        columns = [*frames.columns, into]
        return known.select(columns).unionByName(frames.where(F.col(vec).isNull()).withColumn(into, F.lit(None).cast("double")).select(columns))

    return run


def as_scorer(scorer: Scorer | DataFrame, reduce: str = "max") -> Scorer:
    """A scorer as it is, or reference vectors as a scorer by similarity."""
    return similarity_scorer(scorer, reduce) if isinstance(scorer, DataFrame) else scorer
