import numpy as np
import pytest

from funnelspark.operators import ml, split

FEATURES = ["price", "rate", "noise"]


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(42)
    price, rate, noise = rng.lognormal(3, 1, 600), rng.beta(2, 5, 600), rng.normal(size=600)
    y = (rate + 0.1 * rng.normal(size=600) > 0.3).astype(int)
    data = [(i, float(a), float(b), float(c), int(d)) for i, (a, b, c, d) in enumerate(zip(price, rate, noise, y))]
    df = spark.createDataFrame(data, "id long, price double, rate double, noise double, is_purchased int")
    rows = split.split_three_way(df, ["id"], "is_purchased").cache()
    return [rows.filter(f"part = '{p}'") for p in ("train", "val", "test")]


@pytest.mark.parametrize(
    "kind, params",
    [
        ("logistic_regression", {"maxIter": 10}),
        ("decision_tree", {"maxDepth": 3}),
        ("random_forest", {"numTrees": 5, "seed": 1}),
        ("gradient_boosting", {"maxIter": 3, "seed": 1}),
    ],
)
def test_every_model_learns_the_signal(spark, parts, kind, params):
    train, _val, test = parts
    fitted = ml.train_classifier(train, test, kind, params, FEATURES)
    scores = {r.part: r.accuracy for r in fitted.metrics.collect()}
    assert scores["test"] > 0.75 and set(scores) == {"train", "test"}
    top = ml.top_importances(spark, fitted, 2).collect()
    assert top[0].feature == "rate" and len(top) == 2


def test_unknown_model_is_an_error():
    with pytest.raises(ValueError, match="decision_tree"):
        ml.estimator("catboosted")


def test_tuning_marks_one_best_value(parts):
    train, val, _test = parts
    got = ml.tune_regularization(train, val, [0.01, 1.0], FEATURES, max_iter=10).collect()
    assert [r.c for r in got] == [0.01, 1.0] and sum(r.is_best for r in got) == 1
    assert max(got, key=lambda r: (r.auc_roc, -r.c)).is_best


def test_cross_validated_search(parts):
    train, _val, _test = parts
    folded = split.stratified_folds(train, ["id"], "is_purchased", 3)
    space = {"maxDepth": lambda r: r.randint(1, 4)}
    got = ml.search_params_cv(folded, "fold", 3, "decision_tree", space, 3, FEATURES).collect()
    assert len(got) == 3 and sum(r.is_best for r in got) == 1 and all(0 < r.mean_f1 <= 1 for r in got)


def test_benchmark_and_refit(parts):
    train, val, test = parts
    results = ml.benchmark_models(train, test, {"decision_tree": {"maxDepth": 2}, "logistic_regression": {}}, FEATURES)
    got = {r.model: r for r in ml.benchmark_differences(results, "decision_tree").collect()}
    assert got["decision_tree"].accuracy_diff == 0.0 and len(got) == 2
    _model, metrics = ml.refit_and_evaluate(train, val, test, "decision_tree", {"maxDepth": 3}, FEATURES)
    assert metrics.first().auc_roc > 0.8


def test_class_weights_raise_recall(spark, parts):
    train, _val, test = parts
    rare = train.filter("is_purchased = 0 or id % 6 = 0")
    weighted = ml.with_class_weight(rare)
    sums = {r[0]: r[1] for r in weighted.groupBy("is_purchased").sum("class_weight").collect()}
    assert sums[0] == pytest.approx(sums[1])
    recall = [
        ml.evaluate_model(
            ml.train_classifier(weighted, test, "logistic_regression", {"maxIter": 10}, FEATURES, weight=w).model, test
        ).first().recall
        for w in (None, "class_weight")
    ]
    assert recall[1] > recall[0]


def test_a_missing_value_is_named(spark, parts):
    from pyspark.sql import functions as F

    train, _val, test = parts
    holes = train.withColumn("rate", F.when(F.col("id") % 50 != 0, F.col("rate")))
    with pytest.raises(ValueError, match="rate"):
        ml.train_classifier(holes, test, "logistic_regression", {"maxIter": 2}, FEATURES)


def test_one_hot_table_and_early_stopping(spark, parts):
    from pyspark.sql import functions as F

    train, val, test = (p.withColumn("kind", F.when(F.col("rate") > 0.3, "a.b").otherwise("c")) for p in parts)
    (train1, test1), names = ml.one_hot_tables(train, [test], ["noise"], ["kind"], 5)
    assert names == ["noise", "slot_0", "slot_1"] and train1.columns == test1.columns
    fitted = ml.train_classifier(train1, test1, "logistic_regression", {"maxIter": 10}, names)
    assert {r.part: r.accuracy for r in fitted.metrics.collect()}["test"] > 0.75
    both = train.withColumn("held", F.lit(False)).unionByName(val.withColumn("held", F.lit(True)))
    long = ml.pipeline("gradient_boosting", {"maxIter": 30, "seed": 1}, FEATURES, stop_on="held").fit(both)
    assert 0 < len(long.stages[-1].trees) < 30


def test_trials_that_fall_behind_are_stopped(parts):
    scores = {0: [0.5, 0.7], 1: [0.9, 0.1], 2: [0.1, 0.1], 3: [0.8, 0.8], 4: [0.6, 0.6]}
    # Means .6 .5 .1 .8 .6; the median stays.
    assert ml.behind(scores, 2) == {1, 2} and ml.behind(scores, 4) == {2} and ml.behind({7: [0.3]}, 1) == set()
    train, _val, _test = parts
    folded = split.stratified_folds(train, ["id"], "is_purchased", 4)
    space = {"maxDepth": lambda r: r.randint(1, 5), "minInstancesPerNode": lambda r: r.choice([1, 150, 400])}
    got = ml.search_params_cv(folded, "fold", 4, "decision_tree", space, 8, FEATURES, keep=2).collect()
    assert [r.folds == (r.stopped_after or 4) for r in got] == [True] * 8
    done = [r for r in got if r.stopped_after is None]
    assert 2 <= len(done) < 8 and max(done, key=lambda r: (r.mean_f1, -r.trial)).is_best
    assert all(0 < r.stopped_after < 4 for r in got if r.stopped_after is not None)
    alone = ml.search_params_cv(folded, "fold", 4, "decision_tree", space, 1, FEATURES).collect()
    assert alone[0].is_best and alone[0].folds == 4
