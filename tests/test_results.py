import pytest
from helpers import rows
from pyspark.sql import functions as F

from funnelspark.operators import evaluate, monitor, results, score
from funnelspark.schemas import ALL_FEATURES

PREDICTION = (
    "row_id long, is_purchased long, probability double, actual_label long, "
    "decision_threshold double, brand string"
)


@pytest.fixture(scope="module")
def batch(spark):
    data = [
        (1, 0, 0.0, 0, 0.5, "a"),
        (2, 0, 0.1, 0, 0.5, "a"),
        (3, 1, 0.95, 1, 0.5, "b"),
        (4, 1, 1.0, 1, None, ""),
        (5, 1, None, 1, 0.5, None),
        (6, 1, 0.52, 0, 0.5, "c"),
        (7, 0, 0.48, 1, 0.5, "c"),
        (8, 1, 0.65, None, 7.0, "d"),
    ]
    return spark.createDataFrame(data, PREDICTION)


def test_histogram_edges(batch):
    got = {r.bin: r["count"] for r in results.probability_histogram(batch).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 0, 8: 0, 9: 2}


def test_thresholds_are_clamped_and_defaulted(batch):
    got = rows(batch.select("row_id", results.effective_threshold().alias("t")))
    assert dict(got)[4] == 0.5 and dict(got)[8] == 1.0


def test_summary_counts_stored_labels_without_probability(batch):
    r = results.batch_summary(batch).first()
    assert (r.total, r.purchased, r.not_purchased, r.high_confidence) == (8, 4, 4, 5)
    assert r.average_probability == pytest.approx((0 + 0.1 + 0.95 + 1 + 0.52 + 0.48 + 0.65) / 7)
    assert results.threshold_flip_count(batch, 0.6).first().flips == 1
    assert results.threshold_flip_count(batch, None).first().flips == 0


def test_bands_and_overlapping_segments(batch):
    bands = {r.band: r["count"] for r in results.threshold_bands(batch, 0.5).collect()}
    assert bands == {
        "High-conf negative": 2, "Near threshold": 2, "Moderate confidence": 0, "High-conf positive": 3,
    }
    segments = {r.segment: r["count"] for r in results.action_segments(batch, 0.5).collect()}
    assert segments == {"drop": 2, "hesitant": 1, "converters": 3, "unknown": 2}


@pytest.mark.parametrize(
    "n, sizes", [(11, [2, 2, 2, 2, 2, 1]), (10, [1] * 10), (3, [1, 1, 1]), (25, [3] * 8 + [1])]
)
def test_deciles_fill_from_the_top(spark, n, sizes):
    df = spark.range(1, n + 1).select(F.col("id").alias("row_id"), (F.col("id") / n).alias("probability"))
    got = results.score_deciles(df).groupBy("decile").count().orderBy("decile").collect()
    assert [r["count"] for r in got] == sizes
    assert [r.decile for r in got] == list(range(1, len(sizes) + 1))


def test_calibration_and_confusion_agree_on_labelled_rows(batch):
    labelled = results.labelled(batch).count()
    assert sum(r["count"] for r in results.calibration(batch).collect()) == labelled == 6
    c = results.confusion_at_threshold(batch).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (2, 1, 2, 1)
    assert c.precision == pytest.approx(2 / 3) and c.tp_intensity == 1.0


def test_more_than_eight_cohorts_become_seven_and_others(spark):
    data = [(i, 1, 0.9, 1, 0.5, f"b{i % 9}") for i in range(9 * 4)] + [(99, 0, 0.1, 0, 0.5, "b0")]
    got = results.cohort_breakdown(spark.createDataFrame(data, PREDICTION), "brand").collect()
    by_name = {r.cohort: r for r in got}
    assert len(got) == 8 and by_name["Others"]["count"] == 8
    assert by_name["b0"]["count"] == 5 and by_name["b0"].predicted_rate == pytest.approx(80.0)
    assert sum(r["count"] for r in got) == 37


def test_blank_cohorts_are_unknown(batch):
    got = {r.cohort: r["count"] for r in results.cohort_breakdown(batch, "brand").collect()}
    assert got == {"a": 2, "b": 1, "c": 2, "d": 1, "Unknown": 2}


@pytest.mark.parametrize(
    "keys, labels", [(["0", "6"], ["Mon", "Sun"]), (["1", "7"], ["Mon", "Sun"]), (["1", "9", "x"], ["Mon", "9", "x"])]
)
def test_weekday_labels(spark, keys, labels):
    df = spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1)
    zero = F.lit("0" in keys)
    assert [r[0] for r in df.select(results.weekday_label(F.col("k"), zero)).collect()] == labels


def test_filters_swap_bounds_and_drop_null_probabilities(batch):
    assert rows(results.filter_results(batch, low=0.7, high=0.4), "row_id") == [(6,), (7,), (8,)]
    assert rows(results.filter_results(batch, "high_confidence", simulated=0.5), "row_id") == [
        (1,), (2,), (3,), (4,), (8,),
    ]
    assert rows(results.filter_results(batch, row_text="4"), "row_id") == [(4,)]
    subset = batch.filter("row_id < 3")
    assert rows(results.filter_results(batch, rows=subset), "row_id") == [(1,), (2,)]
    page = results.page_results(batch, [F.desc_nulls_last("probability"), "row_id"], 2, 3)
    assert [r.row_id for r in page.collect()] == [6, 7, 2]


def _full(spark, **changes):
    base = {c: 0.0 for c in ALL_FEATURES}
    base.update(brand="b", category_code_level1="c", category_code_level2="d", **changes)
    return spark.createDataFrame([base])


def test_heuristic_score_and_signals(spark):
    df = _full(
        spark, user_cart_to_purchase_rate=0.5, brand_purchase_rate=0.4,
        product_cart_to_purchase_rate=0.3, activity_count=40.0, user_view_to_cart_rate=0.2,
        price_vs_user_avg=1.5,
    )
    r = score.score_rows(df, threshold=0.4).first()
    assert r.probability == round(0.35 * 0.5 + 0.25 * 0.4 + 0.2 * 0.3 + 0.1 + 0.05 * 0.2 + 0.05 * 0.5, 4)
    assert r.is_purchased == 1 and len(r.feature_contributions) == 3
    assert [s.feature for s in r.explainability.top_signals] == [
        "user_cart_to_purchase_rate", "activity_count", "brand_purchase_rate",
    ]
    full = score.score_rows(df, level="full").first()
    assert [c.feature for c in full.feature_contributions] == ALL_FEATURES
    assert full.feature_contributions[0].display_name == "Price"


def test_lite_derivation(spark):
    row = dict(
        price=99.99, activity_count=5.0, event_weekday=1, event_hour=14, user_total_views=80.0,
        user_total_carts=15.0, product_total_views=800.0, product_total_carts=100.0,
        brand_purchase_rate=0.4, price_vs_user_avg=0.2, price_vs_category_avg=0.1,
        brand="apple", category_code_level1="electronics", category_code_level2="smartphone",
    )
    c2p = 0.3 * 0.4 + 0.7 * 0.4
    r = score.feature_quality(score.derive_full_from_lite(spark.createDataFrame([row]))).first()
    assert r.user_total_purchases == round(15 * c2p) == 6 and r.product_total_purchases == round(100 * c2p)
    assert r.user_avg_purchase_price == 99.99 / 0.5 and r.user_view_to_cart_rate == 15 / 80
    assert r.user_unique_products == max(1.0, 15 * 0.5 * 0.1) and r.user_total_events == 80 + 15 + 6
    assert r.product_unique_buyers == pytest.approx(100 * c2p * (0.3 + 0.125 * 0.7))
    raw = 14 / 26 * 0.6 + (15 / 80 + 0.125 + 0.4) / 3 * 0.4
    assert r.feature_quality.score == round(raw * 100, 1) and r.feature_quality.grade == "C"
    assert (r.feature_quality.inferred_count, r.feature_quality.fallback_count) == (12, 0)


def test_importances_are_padded_and_zero_rows_divide_by_one(spark):
    numbers = spark.createDataFrame([{c: float(i) for i, c in enumerate(ALL_FEATURES)}])
    got = score.importance_contributions(numbers, [1.0, 2.0]).first().feature_contributions
    assert got[1].contribution == round(1 / sum(range(26)) * 2.0, 6) and got[2].contribution == 0.0
    zeros = spark.createDataFrame([{c: 0.0 for c in ALL_FEATURES}])
    assert score.importance_contributions(zeros, [1.0]).first().feature_contributions[0].contribution == 0.0


def test_metrics_against_hand_counts(spark):
    data = [(1, 0.9, 1), (1, 0.8, 1), (0, 0.8, 1), (1, 0.3, 0), (0, 0.2, 0), (0, 0.1, 0)]
    df = spark.createDataFrame(data, "actual_label int, probability double, prediction int")
    r = evaluate.binary_metrics(df).first()
    wins = sum(
        (p > q) + (p == q) / 2 for y, p, _ in data if y for z, q, _ in data if not z
    )
    assert (r.accuracy, r.precision, r.recall) == (4 / 6, 2 / 3, 2 / 3)
    assert r.auc_roc == pytest.approx(wins / 9)
    per = {x["class"]: x for x in evaluate.class_metrics(df).collect()}
    assert per["0"].support == 3 and per["macro"].support == 6
    long = evaluate.metrics_long(evaluate.binary_metrics(df))
    assert evaluate.validate_thresholds(long, {"accuracy": 0.6, "nope": 2.0}).first().passed
    assert not evaluate.validate_thresholds(long, {"accuracy": 0.7}).first().passed


def test_metrics_of_an_empty_class_are_zero(spark):
    df = spark.createDataFrame([(0, 0.0, 0), (0, 1.0, 0)], "actual_label int, probability double, prediction int")
    r = evaluate.binary_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.auc_roc) == (0.0, 0.0, 0.0, None)


def test_model_comparison_guards_a_zero_baseline(spark):
    base = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", 1.0)], "metric string, value double")
    cand = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "metric string, value double")
    got = {r.metric: (r.improvement, r.improvement_pct) for r in evaluate.compare_models(base, cand).collect()}
    assert got == {"a": (1.0, 0.0), "b": (1.0, 50.0), "c": (-1.0, -100.0)}


def test_counters_of_an_empty_log(spark):
    log = spark.createDataFrame([], "model string, success boolean, feature_quality struct<fallback_ratio:double>")
    assert monitor.fallback_ratio(log).first()[:] == (0.0, 0)
    some = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "model string, success boolean")
    got = {r.model: (r.total, r.failed, r.success_rate) for r in monitor.prediction_stats(some).collect()}
    assert got == {"a": (2, 1, 50.0), "b": (1, 0, 100.0), "all": (3, 1, 66.7)}


def test_pages_of_an_index_are_those_of_a_sort(spark):
    df = spark.range(1000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 20) / 20).alias("probability")
    )
    order = [F.desc_nulls_last("probability")]
    whole = [r.row_id for r in df.orderBy(*order, "row_id").collect()]
    index = results.index_results(df, order, slices=6)
    assert index.before[0] == 0 and index.before[-1] == 1000
    for page, size in ((1, 10), (17, 10), (100, 10), (2, 333), (4, 333), (1, 1000), (9, 500)):
        got = [r.row_id for r in index.page(page, size).collect()]
        assert got == whole[(page - 1) * size : page * size], (page, size)
    # A page in the middle reads one or two of the six folders.
    text = index.page(60, 10)._jdf.queryExecution().executedPlan().toString()
    filters = text.split("PartitionFilters: [")[1].split("]")[0]
    assert "_slice" in filters and ">=" in filters and "<=" in filters
    assert [r.row_id for r in results.page_results(df.unionByName(df), order, 1, 4).collect()] == [
        i for i in whole[:2] for _ in range(2)
    ]
    assert results.index_results(df.limit(0), order).page(3).count() == 0


def test_late_pages_go_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(results, "LIMIT_ROWS", 50)
    df = spark.range(300).select((F.col("id") % 4).alias("x"), F.col("id").alias("y"))
    got = results.page_results(df, [F.desc("x")], 20, 10)
    assert "_slice" in got._jdf.queryExecution().executedPlan().toString()
    want = df.orderBy(F.desc("x"), "x", "y").collect()[190:200]
    assert got.collect() == want
