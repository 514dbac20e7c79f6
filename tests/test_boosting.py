import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from funnelspark.operators import boosting, ml

FEATURES = ["price", "rate", "kind", "same"]


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(7)
    price, rate, kind = rng.lognormal(3, 1, 3000), rng.beta(2, 5, 3000), rng.integers(0, 4, 3000)
    y = (rate + 0.05 * kind + 0.15 * rng.normal(size=3000) > 0.45).astype(int)
    data = [(i, float(a), float(b), int(c), 1, int(d), i % 3) for i, (a, b, c, d) in enumerate(zip(price, rate, kind, y))]
    return spark.createDataFrame(
        data, "id long, price double, rate double, kind int, same int, is_purchased int, fold int"
    ).cache()


def listed(drawn):
    """A search space that draws the given trials in turn."""
    return {name: lambda _, values=iter([p[name] for p in drawn]): next(values) for name in drawn[0]}


def searched(df, drawn, k=3, **more):
    return ml.search_params_cv(df, "fold", k, space=listed(drawn), trials=len(drawn), features=FEATURES, **more)


def test_trees_grown_together_are_those_of_mllib(folded):
    drawn = [
        {"maxIter": n, "maxDepth": depth, "stepSize": step}
        for n, depth, step in [(1, 1, 0.1), (5, 3, 0.3), (3, 4, 0.1), (2, 0, 0.1), (8, 2, 0.05)]
    ]
    judge = MulticlassClassificationEvaluator(labelCol="is_purchased", metricName="fMeasureByLabel", metricLabel=1.0)
    for params, row in zip(drawn, searched(folded, drawn, keep=len(drawn)).collect()):
        own = []
        for f in range(3):
            model = ml.pipeline("gradient_boosting", params, FEATURES).fit(folded.filter(F.col("fold") != f))
            own.append(judge.evaluate(model.transform(folded.filter(F.col("fold") == f))))
        assert row.mean_f1 == pytest.approx(np.mean(own)) and row.std_f1 == pytest.approx(np.std(own))


def test_trials_share_the_passes_over_the_rows(spark, folded):
    def jobs(trials):
        spark.sparkContext.setJobGroup(f"search of {trials}", "")
        try:
            got = searched(folded, [{"maxIter": 4, "maxDepth": 3, "subsamplingRate": 0.8}] * trials, 2).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len({r.mean_f1 for r in got}) == 1 and got[0].mean_f1 > 0.5
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search of {trials}"))

    # A fit alone takes 12 passes or more; what is left for a trial is the judging of its folds.
    assert jobs(6) - jobs(1) <= 5 * 2 * 4


def test_bad_rows_are_errors_and_rows_without_a_fold_are_left_out(folded):
    drawn = [{"maxIter": 3, "maxDepth": 3}]
    holes = folded.withColumn("rate", F.when(F.col("id") != 5, F.col("rate")))
    with pytest.raises(ValueError, match="rate"):
        searched(holes, drawn)
    for odd in (F.lit(2), F.lit(None)):
        with pytest.raises(ValueError, match="is_purchased"):
            searched(folded.withColumn("is_purchased", F.when(F.col("id") == 5, odd).otherwise(F.col("is_purchased"))), drawn)
    more = folded.withColumn("rate", F.lit(None).cast("double")).withColumn("fold", F.lit(None).cast("int"))
    assert searched(folded.unionByName(more), drawn).first().mean_f1 == searched(folded, drawn).first().mean_f1


def test_other_parameters_are_left_to_mllib(folded):
    assert not boosting.fits_here(folded, [{"maxIter": 3}, {"minInstancesPerNode": 30}], FEATURES)
    for odd in ({"maxDepth": boosting.DEEPEST + 1}, {"subsamplingRate": 0.0}, {"stepSize": 1.5}):
        assert not boosting.fits_here(folded, [odd], FEATURES)
    assert boosting.fits_here(folded, [{"maxIter": 3}], FEATURES)
    got = searched(folded, [{"maxIter": 2, "minInstancesPerNode": n} for n in (1, 400)], 2).collect()
    assert got[0].mean_f1 > got[1].mean_f1


def test_blocks_tasks_and_kept_sums_change_no_tree(folded, monkeypatch):
    drawn = [{"maxIter": n, "maxDepth": d} for n, d in ((4, 2), (2, 4), (3, 3))]
    whole = searched(folded, drawn, 2, keep=3).collect()
    # Small limits: several blocks to a task, codes of one feature, trials in turn, sums added up on the executors.
    for name, value in {"BLOCK_ROWS": 128, "TASK_ROWS": 600, "CODES": 2, "TOGETHER": 2, "DIRECT": 3}.items():
        monkeypatch.setattr(boosting, name, value)
    assert [r.mean_f1 for r in searched(folded, drawn, 2, keep=3).collect()] == pytest.approx([r.mean_f1 for r in whole])


def test_thresholds_of_few_and_many_values():
    assert boosting.thresholds(np.array([3.0, 1.0, 1.0]), 3).tolist() == [2.0]
    assert boosting.thresholds(np.ones(5), 5).tolist() == []
    even = boosting.thresholds(np.arange(6400.0), 10**6)
    assert len(even) == 31 and np.allclose(np.diff(even), 200)


def test_the_smaller_sibling_is_enough():
    rng = np.random.default_rng(1)
    bins, y = rng.integers(0, 5, (2, 500)).astype(np.uint8), rng.choice([-1, 1], 500).astype(np.int8)
    trial = boosting.Trial(0, {"maxIter": 2, "maxDepth": 4})
    while not trial.done:
        plans = [(0, len(trial.trees), 1.0, trial.tree, list(trial.wanted))]
        (found,) = boosting._counted(plans, [5, 5], 1)([(1, bins, y, None)])
        trial.grow(found[0])
    for tree, _ in trial.trees:
        for node, rows in tree.reached(bins):
            assert len(rows) and tree.value[node] == pytest.approx(y[rows].mean())
