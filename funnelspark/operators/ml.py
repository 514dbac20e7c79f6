"""Training, tuning and comparing classifiers with MLlib.

Every function takes rows whose categories are already encoded as numbers.
"""

from __future__ import annotations

import random
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ALL_FEATURES, TARGET
from . import boosting
from .encode import class_weight, fit_one_hot, one_hot_capped
from .evaluate import binary_metrics

ESTIMATORS = {
    "random_forest": RandomForestClassifier,
    "decision_tree": DecisionTreeClassifier,
    "logistic_regression": LogisticRegression,
    "gradient_boosting": GBTClassifier,
}

# Inverse regularization strengths that are tried.
C_VALUES = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]


def estimator(model_type: str, params: dict | None = None, label: str = TARGET):
    """An untrained MLlib classifier; an error lists the known types."""
    if model_type not in ESTIMATORS:
        raise ValueError(f"unknown model type {model_type!r}, expected one of {sorted(ESTIMATORS)}")
    made = ESTIMATORS[model_type](featuresCol="features", labelCol=label)
    return made.setParams(**params) if params else made


def pipeline(
    model_type: str,
    params: dict | None = None,
    features: list[str] = ALL_FEATURES,
    label: str = TARGET,
    weight: str | None = None,
    stop_on: str | None = None,
) -> Pipeline:
    """Vector assembly (scaled for logistic regression) and the classifier.

    ``weight`` names a column of row weights. ``stop_on`` names a boolean column of rows that boosted
    trees do not learn from: boosting ends when the error on them no longer falls.
    """
    linear = model_type == "logistic_regression"
    assembled = VectorAssembler(
        inputCols=features, outputCol="raw_features" if linear else "features", handleInvalid="error"
    )
    stages = [assembled]
    if linear:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True))
    last = estimator(model_type, params, label)
    if weight is not None:
        last = last.setParams(weightCol=weight)
    if stop_on is not None:
        last = last.setParams(validationIndicatorCol=stop_on)
    return Pipeline(stages=[*stages, last])


def require_complete(df: DataFrame, features: list[str] = ALL_FEATURES) -> DataFrame:
    """The rows; an error names the features that are null or NaN in some of them."""
    bad = [
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in features
    ]
    found = {c: n for c, n in df.agg(*bad).first().asDict().items() if n}
    if found:
        raise ValueError(f"features without a value, by number of rows: {found}")
    return df


def require_binary(df: DataFrame, label: str = TARGET) -> DataFrame:
    """The rows; an error gives the number of those whose label is neither 0 nor 1."""
    bad = df.filter(~F.coalesce(F.col(label).cast("double").isin(0.0, 1.0), F.lit(False))).count()
    if bad:
        raise ValueError(f"rows whose {label} is neither 0 nor 1: {bad}")
    return df


def with_class_weight(df: DataFrame, label: str = TARGET, out: str = "class_weight") -> DataFrame:
    """Add the balanced weight of each row's class, so that both classes count alike."""
    weights = class_weight(df, label).select(F.struct("weight_0", "weight_1")).scalar()
    return df.withColumn(
        out, F.when(F.col(label) == 1, weights["weight_1"]).otherwise(weights["weight_0"])
    )


def one_hot_tables(
    train: DataFrame,
    others: list[DataFrame],
    numeric: list[str],
    categorical: list[str],
    max_categories: int = 100,
) -> tuple[list[DataFrame], list[str]]:
    """([train, *others] with 0/1 columns for the categories, feature names).

    Slots are fitted on the train rows; their number is bounded by ``max_categories`` per column.
    """
    tables, before = [train, *others], set(train.columns)
    for column in categorical:
        fitted = fit_one_hot(train, column, max_categories)
        tables = [one_hot_capped(t, fitted, column) for t in tables]
    # Names of values may hold dots, which feature columns must not.
    slots = [c for c in tables[0].columns if c not in before]
    names = {c: f"slot_{i}" for i, c in enumerate(slots)}
    tables = [
        t.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in t.columns]) for t in tables
    ]
    return tables, [*numeric, *names.values()]


def scored(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns with probability of class 1 and prediction."""
    return model.transform(df).select(
        *keep,
        vector_to_array("probability")[1].alias("probability"),
        F.col("prediction").cast("bigint").alias("prediction"),
    )


def accuracy(model: PipelineModel, df: DataFrame, label: str = TARGET) -> DataFrame:
    """One row: rows and accuracy."""
    hits = F.count_if(F.col("prediction") == F.col(label))
    return scored(model, df, [label]).agg(
        F.count("*").alias("rows"), (hits / F.count("*")).alias("accuracy")
    )


@dataclass
class Trained:
    """A fitted classifier and its accuracies on both sides of the split."""

    model_type: str
    model: PipelineModel
    features: list[str]
    metrics: DataFrame


def train_classifier(
    train: DataFrame,
    test: DataFrame,
    model_type: str,
    params: dict | None = None,
    features: list[str] = ALL_FEATURES,
    label: str = TARGET,
    weight: str | None = None,
    stop_on: str | None = None,
) -> Trained:
    """Fit one classifier and measure accuracy on train and test.

    Rows may be weighted, as by ``with_class_weight``, and boosting may be stopped early (``pipeline``).
    """
    pipe = pipeline(model_type, params, features, label, weight, stop_on)
    model = pipe.fit(require_complete(train, features))
    sides = [
        accuracy(model, side, label).withColumn("part", F.lit(name))
        for name, side in (("train", train), ("test", test))
    ]
    return Trained(model_type, model, features, sides[0].unionByName(sides[1]))


def importances(trained: Trained) -> list[float]:
    """One number per feature: importance, or absolute coefficient. Its size is the feature count."""
    last = trained.model.stages[-1]
    if hasattr(last, "featureImportances"):
        return [float(x) for x in last.featureImportances.toArray()]
    return [abs(float(x)) for x in last.coefficients.toArray()]


def top_importances(spark, trained: Trained, n: int = 10) -> DataFrame:
    """The n most important features."""
    rows = list(zip(trained.features, importances(trained)))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(n)


def evaluate_model(model: PipelineModel, df: DataFrame, label: str = TARGET) -> DataFrame:
    """Six metrics of a model on labelled rows, one row."""
    return binary_metrics(scored(model, df, [label]), label)


def tune_regularization(
    train: DataFrame,
    val: DataFrame,
    values: list[float] = C_VALUES,
    features: list[str] = ALL_FEATURES,
    label: str = TARGET,
    max_iter: int = 50,
) -> DataFrame:
    """(c, reg_param, auc_roc, is_best): logistic regression for each inverse strength.

    The penalty per row that equals an inverse strength C on n summed losses is 1 / (C n).
    """
    n = train.count()
    out = None
    for c in values:
        reg = 1.0 / (c * n)
        params = {"regParam": reg, "maxIter": max_iter, "standardization": False}
        model = pipeline("logistic_regression", params, features, label).fit(train)
        row = evaluate_model(model, val, label).select(
            F.lit(float(c)).alias("c"), F.lit(reg).alias("reg_param"), "auc_roc"
        )
        out = row if out is None else out.unionByName(row)
    best = out.agg(F.max_by("c", F.struct("auc_roc", (-F.col("c")).alias("c")))).scalar()
    return out.withColumn("is_best", F.col("c") == best)


Space = dict[str, Callable[[random.Random], object]]

# Search space of the boosted trees.
BOOSTING_SPACE: Space = {
    "maxIter": lambda r: r.randint(5, 20),
    "maxDepth": lambda r: r.randint(3, 6),
    "stepSize": lambda r: 10 ** r.uniform(-2, -0.5),
    "subsamplingRate": lambda r: r.uniform(0.6, 1.0),
}


def behind(scores: dict[int, list[float]], keep: int) -> set[int]:
    """Trials whose mean so far is below the median of those still running; the ``keep`` best always go on."""
    means = {i: sum(s) / len(s) for i, s in scores.items()}
    order = sorted(means, key=lambda i: (-means[i], i))
    middle = statistics.median(means.values())
    return {i for i in order[keep:] if means[i] < middle}


def search_params_cv(
    df: DataFrame,
    fold: str,
    k: int,
    model_type: str = "gradient_boosting",
    space: Space | None = None,
    trials: int = 10,
    features: list[str] = ALL_FEATURES,
    label: str = TARGET,
    seed: int = 42,
    parallelism: int = 4,
    keep: int = 2,
) -> DataFrame:
    """(trial, params, mean_f1, std_f1, folds, stopped_after, is_best): random search that stops bad trials.

    All trials are fitted fold by fold. After each fold but the last, those below the median of the running trials are
    stopped (``behind``), so most of the work goes into the better half; ``keep`` trials at least see all ``k`` folds.
    ``folds`` were fitted, ``stopped_after`` is the last of them or null for a finished trial, and means are over those
    folds. The best is among finished trials; the earlier one of equals. Boosted trees of all trials are grown
    together, by shared passes over the rows of a fold (``boosting``). Trials of other models, or with parameters that
    are not known there, are fitted ``parallelism`` at a time, each of them distributed.
    """
    rng = random.Random(seed)
    space = space or BOOSTING_SPACE
    drawn = [{name: draw(rng) for name, draw in space.items()} for _ in range(trials)]
    pipe = pipeline(model_type, None, features, label)
    model = pipe.getStages()[-1]
    judge = MulticlassClassificationEvaluator(
        labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0
    )
    together = model_type == "gradient_boosting" and boosting.fits_here(df, drawn, features)
    if together:
        require_binary(require_complete(df.filter(F.col(fold).isNotNull()), features), label)
        judge = judge.setParams(weightCol="rows")

    def together_scores(f: int, order: list[int]) -> list[float]:
        rows = df.filter(F.col(fold).isNotNull()).withColumn("_held", F.col(fold) == f)
        found = boosting.fitted_together(rows, "_held", [drawn[i] for i in order], features, label, seed)
        schema = f"`{label}` double, prediction double, rows double"
        return [float(judge.evaluate(df.sparkSession.createDataFrame(counts, schema))) for counts in found]

    def single_scores(f: int, order: list[int]) -> list[float]:
        train = df.filter(F.col(fold) != f).persist()
        held = df.filter(F.col(fold) == f).persist()

        def score(i: int) -> float:
            params = {model.getParam(name): value for name, value in drawn[i].items()}
            return float(judge.evaluate(pipe.fit(train, params).transform(held)))

        try:
            with ThreadPool(parallelism) as pool:
                return pool.map(inheritable_thread_target(score), order)
        finally:
            train.unpersist()
            held.unpersist()

    scores: dict[int, list[float]] = {i: [] for i in range(trials)}
    running, stopped = set(scores), {}
    for f in range(k):
        order = sorted(running)
        found = (together_scores if together else single_scores)(f, order)
        for i, s in zip(order, found):
            scores[i].append(s)
        if f < k - 1:
            slow = behind({i: scores[i] for i in running}, keep)
            stopped |= dict.fromkeys(slow, f + 1)
            running -= slow
    rows = [
        (
            i, {name: float(v) for name, v in drawn[i].items()}, statistics.fmean(s), statistics.pstdev(s), len(s),
            stopped.get(i),
        )
        for i, s in scores.items()
    ]
    out = df.sparkSession.createDataFrame(
        rows,
        "trial bigint, params map<string,double>, mean_f1 double, std_f1 double, folds bigint, stopped_after bigint",
    )
    best = max(running, key=lambda i: (rows[i][2], -i))
    return out.withColumn("is_best", F.col("trial") == best)


def benchmark_models(
    train: DataFrame,
    test: DataFrame,
    models: dict[str, dict],
    features: list[str] = ALL_FEATURES,
    label: str = TARGET,
) -> DataFrame:
    """Six metrics and training seconds per model, all on the same split."""
    out = None
    for name, params in models.items():
        start = time.perf_counter()
        model = pipeline(name, params, features, label).fit(train)
        seconds = time.perf_counter() - start
        row = evaluate_model(model, test, label).select(
            F.lit(name).alias("model"), "*", F.lit(seconds).alias("train_seconds")
        )
        out = row if out is None else out.unionByName(row)
    return out


def benchmark_differences(results: DataFrame, baseline: str) -> DataFrame:
    """Each model's metrics minus those of the baseline."""
    names = ["accuracy", "precision", "recall", "f1", "auc_roc", "log_loss"]
    base = (
        results.filter(F.col("model") == baseline)
        .agg(F.struct(*[F.max(n).alias(n) for n in names]))
        .scalar()
    )
    return results.select("model", *[(F.col(n) - base[n]).alias(f"{n}_diff") for n in names])


def refit_and_evaluate(
    train: DataFrame,
    val: DataFrame,
    test: DataFrame,
    model_type: str,
    params: dict | None = None,
    features: list[str] = ALL_FEATURES,
    label: str = TARGET,
) -> tuple[PipelineModel, DataFrame]:
    """Fit on train and validation rows together; (model, metrics on test)."""
    model = pipeline(model_type, params, features, label).fit(train.unionByName(val))
    return model, evaluate_model(model, test, label)
