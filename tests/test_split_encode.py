import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from funnelspark.operators import encode, split


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    data = [
        (i, "hot" if rng.random() < 0.7 else f"c{rng.integers(0, 40)}", int(rng.random() < 0.25))
        for i in range(1000)
    ]
    return spark.createDataFrame(data, "id long, cat string, y int").repartition(6)


def counts(df, *by):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).count().collect()}


def test_stratified_split_sizes_are_exact(table):
    totals, parts = counts(table, "y"), counts(split.split_stratified(table, ["id"], "y"), "y", "part")
    for (y,), n in totals.items():
        assert parts[(y, "test")] == int(n * 0.2 + 0.5)
        assert parts[(y, "test")] + parts[(y, "train")] == n


def test_split_does_not_depend_on_the_layout(table):
    once = split.split_stratified(table, ["id"], "y")
    again = split.split_stratified(table.repartition(2, "cat"), ["id"], "y")
    assert rows(once, "id", "part") == rows(again, "id", "part")


def test_three_parts_are_disjoint_and_nested(table):
    parts = split.split_three_way(table, ["id"], "y")
    assert parts.count() == 1000 and parts.select("id").distinct().count() == 1000
    two = split.split_stratified(table, ["id"], "y")
    test_ids = rows(parts.filter("part = 'test'"), "id")
    assert test_ids == rows(two.filter("part = 'test'"), "id")
    assert abs(parts.filter("part = 'val'").count() - 160) <= 2


def test_every_category_is_in_train(table):
    parts = split.split_with_coverage(table, ["cat"], "y", ["id"])
    assert parts.count() == 1000
    assert rows(split.validate_split(parts, ["cat"])) == [("cat", 0, True)]
    once = [r.cat for r in table.groupBy("cat").count().filter("count = 1").collect()]
    assert parts.filter(F.col("cat").isin(once) & (F.col("part") == "test")).count() == 0
    assert abs(parts.filter("part = 'test'").count() - 200) <= 2


def test_coverage_split_takes_at_most_half_of_the_rest(spark):
    df = spark.createDataFrame([(i, f"c{i % 8}", 1) for i in range(10)], "id long, cat string, y int")
    parts = split.split_with_coverage(df, ["cat"], "y", ["id"], test_size=0.9)
    assert parts.filter("part = 'test'").count() == 1


def test_unseen_values_are_found(spark):
    train = spark.createDataFrame([("a", 1), ("b", 2)], "c string, d int")
    test = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "c string, d int")
    assert rows(split.unseen_values(train, test, ["c", "d"])) == [("c", "z"), ("c", None), ("d", "3")]


def test_folds_are_balanced_per_class(table):
    folds = counts(split.stratified_folds(table, ["id"], "y", 5), "y", "fold")
    for y in (0, 1):
        sizes = [folds[(y, k)] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("n", [0, 1, 137, 1000, 5000])
def test_sample_size_is_exact(table, n):
    sample = split.sample_n(table, ["id"], n)
    assert sample.count() == min(n, 1000) == sample.select("id").distinct().count()


def test_subsample_keeps_class_shares(table):
    assert split.subsample_stratified(table, ["id"], "y", cap=10_000).count() == 1000
    small = counts(split.subsample_stratified(table, ["id"], "y", cap=100), "y")
    full = counts(table, "y")
    for key, n in full.items():
        assert abs(small[key] - n / 10) <= 0.5


def test_target_encoder(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 0)], "c string, y int")
    fitted = encode.fit_target_encoder(df, ["c"], "y")
    got = {r.category: r.value for r in fitted.collect()}
    assert got == {
        "a": pytest.approx((1 + 20 * 0.5) / 22),
        "b": pytest.approx((1 + 20 * 0.5) / 21),
        "unknown": pytest.approx((0 + 20 * 0.5) / 21),
    }
    new = spark.createDataFrame([(1, " a "), (2, "zz"), (3, None)], "id int, c string")
    encoded = encode.apply_target_encoder(new, fitted, ["c", "absent"])
    assert rows(encoded) == [(1, got["a"], 0.0), (2, 0.5, 0.0), (3, got["unknown"], 0.0)]
    # A column without an encoder becomes 0.
    assert encode.apply_target_encoder(new, fitted.filter("column = 'x'"), ["c"]).first().c == 0.0


def test_label_index(spark):
    train = spark.createDataFrame([("b",), ("a",), ("unknown",), (None,)], "c string")
    index = encode.fit_label_index(train, ["c"])
    assert rows(index, "category", "index") == [("None", 0), ("a", 1), ("b", 2), ("unknown", 3)]
    new = spark.createDataFrame([("a",), ("Z",), (" B ",)], "c string")
    assert rows(encode.label_encode(new, index, ["c"])) == [(-1,), (-1,), (1,)]
    assert rows(encode.label_encode(new, index, ["c"], "unknown")) == [(1,), (2,), (3,)]


def test_one_hot_pools_rare_values(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), ("d",)], "c string")
    fitted = encode.fit_one_hot(df, "c", max_categories=3)
    assert rows(fitted) == [("a", "a"), ("b", "b"), ("c", "infrequent"), ("d", "infrequent")]
    new = spark.createDataFrame([(1, "a"), (2, "d"), (3, "new")], "id int, c string")
    got = encode.one_hot_capped(new, fitted, "c")
    assert got.columns == ["id", "c=a", "c=b", "c=infrequent"]
    assert rows(got) == [(1, 1, 0, 0), (2, 0, 0, 1), (3, 0, 0, 0)]
    all_kept = encode.fit_one_hot(df, "c", max_categories=4)
    assert rows(all_kept, "slot") == [("a",), ("b",), ("c",), ("d",)]


def test_standardize_and_winsorize(spark):
    x = np.arange(100, dtype=float)
    df = spark.createDataFrame([(float(v), 3.0) for v in x], "x double, k double").coalesce(1)
    got = encode.standardize(df, ["x", "k"]).collect()
    assert np.allclose([r.x for r in got], (x - x.mean()) / x.std()) and {r.k for r in got} == {0.0}
    clipped = [r.x for r in encode.winsorize(df, ["x"], 0.05, 0.9).collect()]
    assert np.allclose(clipped, np.clip(x, np.quantile(x, 0.05), np.quantile(x, 0.9)))


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] + [(0,)] * 4, "y int")
    r = encode.class_weight(df, "y").first()
    assert (r.pos_weight, r.weight_1, r.weight_0) == (4.0, 2.5, 0.625)
