import numpy as np
import pytest
from helpers import in_order, rows
from pyspark.sql import functions as F

from funnelspark.operators import ordered


def test_running_totals_with_one_group_over_many_slices(spark):
    # Two thirds of the rows are in one group and cross every slice border.
    data = [("hot", i, i % 5) for i in range(400)] + [(f"g{i % 7}", i, 1) for i in range(200)]
    df = spark.createDataFrame(data, "g string, x int, w int").repartition(5)
    got = ordered.running_totals(
        df, ["x"], {"n": F.lit(1), "s": F.col("w")}, groups=["g"], slices=6
    )
    expected, n, s = [], {}, {}
    for g, x, w in sorted(data):
        n[g], s[g] = n.get(g, 0) + 1, s.get(g, 0) + w
        expected.append((g, x, w, n[g], s[g]))
    assert rows(got) == in_order(expected)


def test_row_numbers_with_tied_scores(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 1000).alias("p"))
    got = ordered.row_numbers(df, [F.desc("p"), "id"], "rn", slices=7).collect()
    order = [r.id for r in sorted(got, key=lambda r: (-r.p, r.id))]
    assert [r.id for r in sorted(got, key=lambda r: r.rn)] == order
    assert sorted(r.rn for r in got) == list(range(1, 1001))


@pytest.mark.parametrize("n", [1, 2, 5, 100])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n).round(2), rng.integers(0, 4, n).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    wanted = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99}
    got = {r.column: r for r in ordered.quantiles(df, ["x", "y"], wanted).collect()}
    for name, values in (("x", x), ("y", y)):
        assert got[name]["count"] == n
        for q, p in wanted.items():
            assert got[name][q] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantiles_skip_nulls_and_split_by_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 7.0)], "g string, x double")
    got = ordered.quantiles(df, ["x"], {"m": 0.5}, ["g"])
    assert rows(got, "g", "count", "m") == [("a", 2, 2.0), ("b", 1, 7.0)]


def test_running_totals_with_null_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, x int")
    got = ordered.running_totals(df, ["x"], {"n": F.lit(1)}, ["g"], slices=3)
    assert rows(got) == in_order([(None, 1, 1), (None, 2, 2), ("a", 1, 1)])
    assert ordered.row_numbers(df.limit(0), ["x"], "n").count() == 0


def test_running_totals_cross_arrow_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).select((F.col("id") % 3).alias("g"), "id")
        got = ordered.running_totals(df, ["id"], {"n": F.lit(1), "s": F.col("id")}, ["g"], slices=2)
        bad = got.filter(F.col("n") != F.floor(F.col("id") / 3) + 1)
        assert bad.isEmpty() and got.count() == 200
        assert got.groupBy("g").agg(F.max("s")).count() == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("window_rows", [1_000_000_000, 10])
def test_quantiles_of_a_large_column_move_few_values(spark, monkeypatch, window_rows):
    monkeypatch.setattr(ordered, "ACCURACY", 100)
    monkeypatch.setattr(ordered, "WINDOW_ROWS", window_rows)
    rng = np.random.default_rng(3)
    x = rng.normal(size=6000).round(3)
    x[::3] = 0.25  # a value that a third of the rows share
    y = np.concatenate([rng.normal(size=5000), np.full(600, np.inf), np.full(400, np.nan)])
    rng.shuffle(y)
    df = spark.createDataFrame([(int(i % 7 == 0) or None, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, x double, y double")
    wanted = {"q01": 0.01, "q50": 0.5, "q51": 0.51, "q99": 0.99, "least": 0.0, "most": 1.0}
    got = {r.column: r for r in ordered.quantiles(df, ["x", "y"], wanted).collect()}
    last = np.sort(y)
    for name, p in wanted.items():
        assert got["x"][name] == pytest.approx(np.quantile(x, p), abs=1e-12)
        if name not in ("q99", "most"):
            assert got["y"][name] == pytest.approx(np.quantile(last[:5000], p * 5999 / 4999), abs=1e-12)
    assert np.isnan(got["y"]["q99"]) and np.isnan(got["y"]["most"])
    split = {r.g: r for r in ordered.quantiles(df, ["x"], {"m": 0.5}, ["g"]).collect()}
    third = np.arange(6000) % 7 == 0
    assert split[1]["m"] == pytest.approx(np.median(x[third])) and split[None]["m"] == pytest.approx(np.median(x[~third]))
    long = df.select("x").unpivot([], ["x"], "column", "value")
    low, high = ordered._brackets(long, ["column"], [0.99]).select("_low", "_high").first()
    assert ((x >= low[0]) & (x <= high[0])).mean() < 0.1
