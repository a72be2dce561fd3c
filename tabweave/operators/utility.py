"""Train on synthetic rows, test on real ones."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.ml import Model, Pipeline, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.fidelity import apply_scaler
from tabweave.session import durable

SEED = 42
# Rows of a training task at least, and training tasks a core at most: every task of every iteration answers the driver.
ROWS_PER_TASK = 20_000
TASKS_PER_CORE = 3
CLASSIFIERS = ("LinearSVC", "DecisionTreeClassifier", "RandomForestClassifier", "LogisticRegression", "MLPClassifier")
REGRESSORS = ("LinearRegression", "Ridge", "Lasso", "BayesianRidge")


def _assembled(df: DataFrame, features: Sequence[str], label: str = "target") -> DataFrame:
    safe = df.select(
        *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)],
        F.col(f"`{label}`").cast("double").alias("label"),
    )
    names = [f"f{i}" for i in range(len(features))]
    # Scores have to cover all rows: a null is an error here, not a row less. ``drop_incomplete`` comes before.
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="error").transform(safe).select("features", "label")


def training_tasks(rows: int, cores: int) -> int:
    """Tasks of a training pass. They follow the rows only until every core has a few, so that what an iteration sends to the
    driver does not grow with the table."""
    return max(1, min(math.ceil(rows / ROWS_PER_TASK), TASKS_PER_CORE * cores))


def _classifier(model: str, features: int, classes: int, rows: int):
    """Spark ML counterparts of the five classifiers.

    Fixed values: depth 5 trees, 100 trees, 100 hidden units, 300 iterations, tolerance 1e-4, unit penalty on raw
    features (Spark divides the loss by the row count, hence one over it).
    """
    penalty = 1.0 / max(1, rows)
    if model == "LinearSVC":
        one = LinearSVC(maxIter=100, regParam=penalty, tol=1e-4, standardization=False)
        return OneVsRest(classifier=one, parallelism=4)
    if model == "DecisionTreeClassifier":
        return DecisionTreeClassifier(maxDepth=5, seed=SEED)
    if model == "RandomForestClassifier":
        return RandomForestClassifier(maxDepth=5, numTrees=100, seed=SEED)
    if model == "LogisticRegression":
        return LogisticRegression(maxIter=100, regParam=penalty, tol=1e-4, standardization=False)
    if model == "MLPClassifier":
        return MultilayerPerceptronClassifier(layers=[features, 100, classes], maxIter=300, seed=SEED)
    raise ValueError(f"unknown classifier {model!r}")


def utility_classification(
    synthetic: DataFrame, test: DataFrame, features: Sequence[str], model: str, label: str = "target"
) -> DataFrame:
    """``(label, prediction)`` on the real test rows of a classifier trained on the synthetic rows.

    Labels are category codes. The perceptron scales its inputs, since it converges on nothing else.
    """
    train, held = _assembled(synthetic, features, label), _assembled(test, features, label)
    highest, rows = train.agg(F.max("label"), F.count("*")).first()
    if highest is None:
        raise ValueError("no synthetic rows to train on")
    # Training reads the rows hundreds of times: as few tasks as their number and the cores ask for, and no lineage behind them.
    train = durable(train.repartition(training_tasks(rows, train.sparkSession.sparkContext.defaultParallelism)))
    estimator = _classifier(model, len(features), int(highest) + 1, rows)
    if model == "MLPClassifier":
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        fitted: Model | Transformer = Pipeline(stages=[scaler, estimator.setFeaturesCol("scaled")]).fit(train)
    else:
        fitted = estimator.fit(train)
    return fitted.transform(held).select("label", "prediction")


class Gram(NamedTuple):
    """Count, means and centred cross products of complete rows, the label last."""

    n: int
    mean: np.ndarray
    centred: np.ndarray


def grams(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ()) -> dict[tuple, Gram]:
    """The Gram matrix of each key's complete rows in one aggregation: a d x d result per key for the driver.

    Covariances are aggregated about running means, so large means or counts cancel nothing.
    """
    names = [*features, label]
    rows = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    whole = [F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}") for i in range(len(names))]
    rows = rows.filter(reduce(Column.__and__, whole))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    aggs = [F.count("*"), *[F.avg(f"x{i}") for i in range(len(names))], *[F.covar_pop(f"x{i}", f"x{j}") for i, j in pairs]]
    out, d = {}, len(names)
    for row in rows.groupBy(*keys).agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).collect():
        values = row[len(keys) :]
        n = values[0]
        if n:
            centred = np.zeros((d, d))
            for (i, j), value in zip(pairs, values[1 + d :]):
                centred[i, j] = centred[j, i] = n * value
            out[tuple(row[: len(keys)])] = Gram(n, np.array(values[1 : 1 + d], float), centred)
    return out


def _gram(df: DataFrame, features: Sequence[str], label: str) -> Gram:
    found = grams(df, features, label)
    if not found:
        raise ValueError("no complete rows to train on")
    return found[()]


def bayesian_ridge(df: DataFrame, features: Sequence[str], label: str, iterations: int = 300, tol: float = 1e-3):
    """Coefficients and intercept by evidence maximisation on the centred Gram matrix.

    The table is read once; the iteration works on a matrix as wide as the feature list. Fixed values: the four
    hyperprior parameters of 1e-6.
    """
    return _evidence(_gram(df, features, label), iterations, tol)


def _evidence(gram: Gram, iterations: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    n, mean, centred = gram
    xx, xy, yy = centred[:-1, :-1], centred[:-1, -1], centred[-1, -1]
    prior = 1e-6
    eigen, vectors = np.linalg.eigh(xx)
    eigen = np.maximum(eigen, 0)
    alpha, lam = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    rotated = vectors.T @ xy
    weights = np.zeros(len(xy))
    for _ in range(iterations):
        old = weights
        weights = vectors @ (rotated / (eigen + lam / alpha))
        residual = max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0)
        effective = np.sum(alpha * eigen / (lam + alpha * eigen))
        lam = (effective + 2 * prior) / (weights @ weights + 2 * prior)
        alpha = (n - effective + 2 * prior) / (residual + 2 * prior)
        if np.abs(weights - old).sum() < tol:
            break
    weights = vectors @ (rotated / (eigen + lam / alpha))
    return weights, float(mean[-1] - mean[:-1] @ weights)


def _lasso(xx: np.ndarray, xy: np.ndarray, penalty: float = 1.0, rounds: int = 10_000) -> np.ndarray:
    """Coordinate descent on the Gram matrix per row."""
    weights = np.zeros(len(xy))
    for _ in range(rounds):
        before = weights.copy()
        for j in range(len(xy)):
            if xx[j, j] > 0:
                pull = xy[j] - xx[j] @ weights + xx[j, j] * weights[j]
                weights[j] = np.sign(pull) * max(abs(pull) - penalty, 0.0) / xx[j, j]
        if np.abs(weights - before).max(initial=0) < 1e-12:
            break
    return weights


def linear_fit(model: str, gram: Gram) -> tuple[np.ndarray, float]:
    """Weights and intercept of one of the four linear models, all of which depend on the Gram matrix alone."""
    n, mean, centred = gram
    xx, xy = centred[:-1, :-1], centred[:-1, -1]
    if model == "BayesianRidge":
        return _evidence(gram)
    if model == "LinearRegression":
        weights = np.linalg.lstsq(xx, xy, rcond=None)[0]
    elif model == "Ridge":
        weights = np.linalg.solve(xx + np.eye(len(xy)), xy)
    elif model == "Lasso":
        weights = _lasso(xx / n, xy / n)
    else:
        raise ValueError(f"unknown regressor {model!r}")
    return weights, float(mean[-1] - mean[:-1] @ weights)


def regression_scores(
    synthetic: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str = "target",
    scaler: DataFrame | None = None,
    keys: Sequence[str] = (),
    models: Sequence[str] = REGRESSORS,
) -> DataFrame:
    """``(keys, model, score)``: the mean squared error on ``test`` of every model trained on each key's synthetic rows.

    Training sums up one Gram matrix per key, and so does testing: the error is a quadratic form of the test rows'
    moments. Two jobs serve any number of keys and models. Incomplete synthetic rows are left out, incomplete test rows are an
    error, and a key without complete rows has no score.
    """
    if scaler is not None:
        synthetic = apply_scaler(synthetic, scaler, [*features, label])
        test = apply_scaler(test, scaler, [*features, label])
    held, rows = grams(test, features, label).get(()), test.count()
    if held is None or held.n < rows:
        raise ValueError("the test rows are incomplete" if rows else "no test rows")
    out = []
    for key, gram in grams(synthetic, features, label, keys).items():
        for model in models:
            weights, intercept = linear_fit(model, gram)
            turn = np.append(-weights, 1.0)
            offset = held.mean @ turn - intercept
            out.append((*key, model, float(turn @ held.centred @ turn / held.n + offset**2)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in synthetic.select(*keys).schema.fields) if keys else ""
    return synthetic.sparkSession.createDataFrame(out, f"{kinds.removesuffix(', ') + ', ' if kinds else ''}model string, score double")


def utility_regression(
    synthetic: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    model: str,
    label: str = "target",
    scaler: DataFrame | None = None,
    truncate_target: bool = False,
) -> DataFrame:
    """``(label, prediction)`` of a linear model trained on synthetic rows, with penalty one for Ridge and Lasso.

    ``scaler`` (``fit_scaler`` of the real train rows, target included) puts both sides on one scale.
    ``truncate_target`` trains on whole-number targets.
    """
    if scaler is not None:
        synthetic = apply_scaler(synthetic, scaler, [*features, label])
        test = apply_scaler(test, scaler, [*features, label])
    if truncate_target:
        target = F.col(f"`{label}`").cast("double")
        synthetic = synthetic.withColumn(label, F.when(target < 0, F.ceil(target)).otherwise(F.floor(target)).cast("double"))
    if model == "BayesianRidge":
        weights, intercept = bayesian_ridge(synthetic, features, label)
        value = F.lit(intercept)
        for c, w in zip(features, weights):
            value = value + F.col(f"`{c}`").cast("double") * F.lit(float(w))
        return test.select(F.col(f"`{label}`").cast("double").alias("label"), value.alias("prediction"))
    train, held = _assembled(synthetic, features, label), _assembled(test, features, label)
    if model == "LinearRegression":
        estimator = LinearRegression(regParam=0.0, solver="normal")
    elif model == "Ridge":
        # Spark divides the loss by n and works on a target scaled by its standard deviation.
        spread = train.agg(F.stddev_pop("label").alias("s"), F.count("*").alias("n")).first()
        penalty = (spread["s"] or 0.0) / max(1, spread["n"])
        estimator = LinearRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal")
    elif model == "Lasso":
        estimator = LinearRegression(
            regParam=1.0, elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-10
        )
    else:
        raise ValueError(f"unknown regressor {model!r}")
    return estimator.fit(train).transform(held).select("label", "prediction")


def _confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def f1_macro(pred: DataFrame) -> DataFrame:
    """Unweighted mean of the per-class F1 over all classes seen as label or prediction."""
    cells = _confusion(pred)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed"), hit.alias("hits")),
        F.struct(
            F.col("prediction").alias("c"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed"),
            F.lit(0).cast("bigint").alias("hits"),
        ),
    )
    classes = cells.select(F.explode(sides).alias("s")).groupBy("s.c").agg(
        F.sum("s.actual").alias("a"), F.sum("s.guessed").alias("g"), F.sum("s.hits").alias("h")
    )
    return classes.agg(F.avg(2 * F.col("h") / (F.col("a") + F.col("g"))).alias("score"))


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("score"))


def mse(pred: DataFrame) -> DataFrame:
    gap = F.col("label") - F.col("prediction")
    return pred.agg(F.avg(gap * gap).alias("score"))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {"F1": f1_macro, "Accuracy": accuracy, "MSE": mse}
