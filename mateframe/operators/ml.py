"""Fitting and scoring: models of pyspark.ml, and batch scoring of any NumPy model in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored


def score(df: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], *, key: str, x: str = "x", batch: int = 8192) -> DataFrame:
    """Class probabilities by a model that ``load`` opens once per task: key, probs, pred."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in parts:
            model = model or load()
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                p = model(np.array(part[x].tolist(), np.float32))
                yield pd.DataFrame({key: part[key].to_numpy(), "probs": p.tolist(), "pred": p.argmax(axis=1).astype(np.int32)})

    return df.select(key, x).mapInPandas(run, f"{key} long, probs array<double>, pred int")


def features(df: DataFrame, x: str = "x") -> DataFrame:
    return df.withColumn("features", array_to_vector(x))


def fit(df: DataFrame, *, label: str, x: str = "x", reg: float = 0.01, weight: str | None = None):
    """Class-weighted logistic regression; weights even out the classes unless a column is given."""
    if weight is None:
        sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
        every = Window.partitionBy()
        weights = sizes.select(label, (F.sum("__n").over(every) / (F.count("*").over(every) * F.col("__n"))).alias("__w"))
        df, weight = df.join(F.broadcast(weights), label), "__w"
    data = df.select(array_to_vector(x).alias("features"), F.col(label).cast("double").alias("label"), F.col(weight).alias("w"))
    return LogisticRegression(regParam=reg, weightCol="w", maxIter=30).fit(data)


def predict(model, df: DataFrame, *, x: str = "x") -> DataFrame:
    out = model.transform(df.withColumn("features", array_to_vector(x)))
    return out.withColumns({"probs": vector_to_array("probability"), "pred": F.col("prediction").cast("int")}).drop("features", "rawPrediction", "probability", "prediction")


def fit_distance(df: DataFrame, *, label: str, x: str = "x"):
    return LinearRegression(regParam=0.01, maxIter=30).fit(df.select(array_to_vector(x).alias("features"), F.col(label).cast("double").alias("label")))


def refit_on_errors(df: DataFrame, *, label: str, key: str, rounds: int = 2, copies: int = 2):
    """Fit, join the rows that come out wrong to the training rows ``copies`` more times, and fit again.

    Returns the last model and a table of rounds (round, rows trained on, rows wrong). A round's training rows are written
    before they are fitted, so plans don't grow with the rounds and a lost executor costs a part of one
    round. Hard rows are those of the last round only. Keys that repeat are judged row by row.
    """
    base = stored(df.select(key, label, "x"), "refit-base")
    train, log, n = base, [], base.count()
    for k in range(rounds + 1):
        model = fit(train, label=label)
        if k == rounds or not n:
            wrong = predict(model, base).where(F.col("pred") != F.col(label)).count() if n else 0
            log.append((k, train.count(), wrong))
            break
        hard = predict(model, base).where(F.col("pred") != F.col(label)).select(base.columns)
        again = hard.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies)))).select(base.columns)
        grown = stored(base.unionByName(again), f"refit-round-{k + 1}")
        held = grown.count()
        log.append((k, train.count(), (held - n) // copies))
        train = grown
    return model, df.sparkSession.createDataFrame(log, "round int, rows long, wrong long")


def grid_scores(df: DataFrame, *, label: str, x: str, scales: list[float], classes: int = 10) -> DataFrame:
    """How often each component of a vector, times each scale and rounded down modulo the classes, is the label: place, scale, correct.

    Components become rows once, scales are counted side by side and turned into rows of the result, so nothing is multiplied by the grid.
    """
    tall = df.select(label, F.posexplode(x).alias("place", "v"))
    hit = lambda s: F.count_if(F.pmod(F.floor(F.col("v").cast("double") * s), F.lit(classes)) == F.col(label))
    wide = tall.groupBy("place").agg(*[hit(s).alias(f"__{i}") for i, s in enumerate(scales)])
    return wide.select("place", F.inline(F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.col(f"__{i}").alias("correct")) for i, s in enumerate(scales)])))


def best_of_grid(scores: DataFrame) -> DataFrame:
    """The cell of the grid with the most hits; of equal ones the first place, then the least scale."""
    order = F.struct("correct", -F.col("place"), -F.col("scale"))
    return scores.agg(F.max_by(F.struct("place", "scale", "correct"), order).alias("r")).select("r.*")


def sweep(df: DataFrame, *, label: str, x: str = "x"):
    """The best regularisation by a held-out fifth."""
    data = df.select(array_to_vector(x).alias("features"), F.col(label).cast("double").alias("label"))
    lr = LogisticRegression(maxIter=15)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.001, 0.01, 0.1]).build()
    return TrainValidationSplit(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), trainRatio=0.8, parallelism=3, seed=5).fit(data)
