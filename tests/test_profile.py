import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from funnelspark.operators import eda, profile, runs


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    data = [
        (round(float(rng.lognormal(2, 1)), 2), int(rng.integers(0, 7)), None if i % 10 == 0 else f"b{rng.integers(0, 4)}", int(rng.random() < 0.3))
        for i in range(500)
    ]
    return spark.createDataFrame(data, "price double, event_weekday long, brand string, is_purchased int")


def test_histogram_equals_numpy(table):
    x = np.array([r.price for r in table.select("price").collect()])
    for bins in (1, 8, 50):
        got = [r["count"] for r in eda.histogram(table, "price", bins).orderBy("bin").collect()]
        assert got == list(np.histogram(x, bins=bins)[0])


def test_histogram_by_class_covers_all_rows_on_shared_bins(table):
    got = eda.histogram_by_class(table, "price", 10).collect()
    assert len(got) == 20 and sum(r["count"] for r in got) == 500
    for y in (0, 1):
        assert sum(r.density * (r.high - r.low) for r in got if r.is_purchased == y) == pytest.approx(1.0)


def test_constant_column_gets_one_widened_bin(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    r = profile.numeric_distribution(df, ["x"]).collect()
    assert len(r) == 1 and (r[0].label, r[0]["count"], r[0].median) == ("2.50-3.50", 4, 3.0)


def test_bins_are_limited_by_distinct_values(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 3)], "x double")
    got = profile.numeric_distribution(df, ["x"]).orderBy("bin").collect()
    assert [r["count"] for r in got] == list(np.histogram([1, 1, 2, 3], bins=3)[0])


def test_profile_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None)], "x int, s string")
    r = profile.dataset_profile(df).first()
    assert (r.rows, r.cols, r.duplicate_rows, r.numeric_columns, r.categorical_columns) == (4, 2, 2, 1, 1)
    assert r.missing_percent == pytest.approx(100 / 8)
    assert rows(profile.null_counts(df, only_missing=True)) == [("s", 1, 25.0)]
    assert profile.dataset_profile(df.limit(0)).first().missing_percent == 0.0


def test_missing_category_is_named(table):
    got = profile.categorical_distribution(table, ["brand"]).collect()
    assert {r.label for r in got} == {"<missing>", "b0", "b1", "b2", "b3"} and got[0].unique_count == 5
    assert sum(r["count"] for r in got) == 500


def test_conversion_without_events_or_target(spark):
    df = spark.createDataFrame(
        [("a", 10, 1, 0.25), ("a", 20, 2, 0.25), (None, 5, 0, 0.0)],
        "brand string, product_total_views int, product_total_purchases int, brand_purchase_rate double",
    )
    assert profile.conversion_counts(df).first()[:] == (35, 3, 3)
    # 2 carts at 0.25 is half a purchase, which rounds to the even number.
    assert rows(profile.brand_conversion(df)) == [("a", 2, 0, 0.0), ("unknown", 1, 0, 0.0)]


def test_funnel_of_no_views(spark):
    counts = spark.createDataFrame([(0, 4, 2)], "views long, carts long, purchases long")
    got = {r.stage: (r.rate, r.pct_of_view) for r in profile.funnel_stages(counts).collect()}
    assert got == {"View": (1.0, 0.0), "Add to Cart": (0.0, 0.0), "Purchase": (0.5, 0.0)}


def test_binned_median_and_weekdays(spark):
    binned = spark.createDataFrame([(1.0, 10), (2.0, 10), (9.0, 5)], "minute double, volume long")
    assert profile.bin_weighted_median(binned).first().median == 2.0
    stats = profile.histogram_stats(binned).first()
    assert (stats.mean, stats.within_fast_pct, stats.median) == (75 / 25, 80.0, 2.0)
    assert profile.histogram_stats(binned.limit(0)).first()[:] == (0.0, 0.0, 0.0, 0.0)
    days = profile.dense_weekdays(spark.createDataFrame([(6,), (6,)], "event_weekday int"))
    assert [r.value for r in days.orderBy("weekday").collect()] == [0] * 6 + [2]


def test_correlations_equal_pandas_with_pairwise_nulls(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(1e6, 1, 300), "b": rng.normal(size=300), "k": 0.1})
    pdf["c"] = pdf.a * 2 + rng.normal(size=300)
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::5, "c"] = np.nan
    data = [tuple(None if v != v else float(v) for v in r) for r in pdf.to_numpy()]
    df = spark.createDataFrame(data, "a double, b double, k double, c double").repartition(5)
    want = pdf.corr()
    for r in eda.correlation_matrix(df, ["a", "b", "k", "c"]).collect():
        if "k" in (r.a, r.b):
            assert r.corr is None
        else:
            assert r.corr == pytest.approx(want.loc[r.a, r.b], abs=1e-9)


def test_long_tail_and_top_values(spark):
    df = spark.createDataFrame([(v,) for v in "aaaaaaaabbcd"], "brand string")
    got = eda.cumulative_share(df).orderBy("rank").collect()
    assert [r.brand for r in got] == ["a", "b", "c", "d"] and got[-1].cumulative_pct == pytest.approx(100)
    assert eda.long_tail(df).first()[:] == (1, 3, 4)
    assert rows(eda.semi_topk(df, "brand", 2).distinct()) == [("a",), ("b",)]


def test_psi_of_equal_tables_is_zero(table):
    assert profile.psi(table, table, ["brand"]).first().psi == pytest.approx(0.0)
    other = table.withColumn("brand", F.lit("b0"))
    assert profile.psi(table, other, ["brand"]).first().psi > 0.5


def test_run_history(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    data = [
        ("r1", "t1", "evaluate", "FINISHED", day(1), day(2), {"f1": 0.7}, {}),
        ("r2", "t1", "evaluate", "FINISHED", day(3), day(4), {"auc": 0.9}, {}),
        ("r3", "t1", "evaluate", "FAILED", day(5), day(6), {"f1": 0.99}, {}),
        ("r4", None, "train", "FINISHED", day(7), day(8), {"f1": 0.8}, {"k": "v"}),
    ]
    from funnelspark.schemas import RUNS

    df = spark.createDataFrame(data, RUNS)
    assert runs.best_run(df, "f1").first().run_id == "r3"
    assert runs.best_run(df, "f1", ascending=True).first().run_id == "r1"
    # The newest finished evaluation did not log f1.
    assert rows(runs.latest_eval_metric(df, "f1")) == [("t1", "r2", None)]
    found = runs.search_runs(df, runs.metric("f1") > 0.75, "f1")
    assert [r.run_id for r in found.collect()] == ["r3", "r4"]
    assert runs.best_run(df.limit(0), "f1").count() == 0
