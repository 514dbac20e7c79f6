"""The steps from the event log to scored rows: no work done twice per row, none that the JVM cannot compile."""

import datetime as dt
import re

from funnelspark.operators import ordered, score
from funnelspark.operators.clean import dedup_events
from funnelspark.plans.testbed import clickstream
from funnelspark.schemas import ALL_FEATURES, CATEGORICAL_FEATURES
from helpers import at, in_order
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def feature_rows(spark):
    values = [F.lit("x" if c in CATEGORICAL_FEATURES else 0.5).alias(c) for c in ALL_FEATURES]
    return spark.range(3).select(F.col("id").alias("row_id"), *values)


def test_the_log_is_parsed_once_and_any_number_of_parts_is_no_shuffle(spark, tmp_path):
    ts = dt.datetime(2024, 1, 10, 12)
    events = [
        (1, ts, 7, "click", 2.0, '{"k": 13}'), (2, ts, 7, "view", 2.0, '{"k": -3}'), (17, ts, None, "view", 2.0, '{"k": 3}'),
        (50, None, 7, "error", 2.0, '{"k": 3}'), (3, ts, 7, "view", 2.0, "{}"), (4, ts, 7, "view", 2.0, None),
        (5, ts, 7, "view", 2.0, '{"k": 5}'), (101, ts, 7, "purchase", None, '{"k": 4}'),
    ]
    parts = [
        (3, "red Bolt", "Brand#1", "LARGE", 1), (-3, "x", "B", "SMALL", 3), (13, "no", "no", "no", 2),
        (4, None, None, "ECONOMY", 7), (None, "no", "no", "no", 2),
    ]
    spark.createDataFrame(
        events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame(
        parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = clickstream(spark, str(tmp_path))
        plan = plan_of(log)
        got = log.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("get_json_object") == 1 and "SortMergeJoin" not in plan
    red = (3, 1, "large.bolt", "brand#1")
    expected = [
        (ts, "cart", *red, 2.0, 7, "7-2024-01-08"),
        (ts, "view", -3, 3, "small", "b", 2.0, 7, "7-2024-01-08"),
        (ts, "view", *red[:3], None, 2.0, None, "2024-01-08"),
        (None, "remove_from_cart", *red, 2.0, 7, "7"),
        (None, "remove_from_cart", *red, 2.0, 7, "7"),
        (ts, "purchase", 4, 7, None, None, None, 7, "NULL"),
    ]
    assert in_order(tuple(r) for r in got) == in_order(expected)


def test_events_are_grouped_by_time_first(spark, events_of):
    log = events_of([(1, "view", 1, 1, "s"), (1, "view", 1, 1, "s"), (2, "view", 1, 1, "s")])
    found = dedup_events(log)
    assert re.search(r"SortAggregate\(key=\[event_time", plan_of(found))
    assert sorted(r.event_time for r in found.collect()) == [at(1), at(2)] and found.columns == log.columns


def test_rows_are_numbered_without_python(spark, monkeypatch):
    stored = []
    real = ordered.stage
    monkeypatch.setattr(ordered, "stage", lambda df, name: stored.append(plan_of(df)) or real(df, name))
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    got = ordered.row_numbers(df, ["x"], "n", slices=5).collect()
    assert all(r.n == r.x + 1 for r in got) and len(got) == 1000
    assert stored and "MapInArrow" not in stored[0]


def test_contributions_are_exploded_by_methods_the_jvm_compiles(spark, capsys):
    rows = score.contribution_rows(score.heuristic_contributions(feature_rows(spark)))
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        rows.select("*").explain("codegen")
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
    got = rows.filter("row_id = 1").orderBy("position").collect()
    assert [r.feature for r in got] == ALL_FEATURES
    assert {r.feature: r.contribution for r in got}["brand_purchase_rate"] == 0.125
    assert got[0].display_name == "Price" and got[0].contribution == 0.0


def test_rows_without_contributions_give_none(spark):
    made = score.heuristic_contributions(feature_rows(spark))
    some = made.withColumn("feature_contributions", F.when(F.col("row_id") > 0, F.col("feature_contributions")))
    assert score.contribution_rows(some).count() == 2 * len(ALL_FEATURES)


def test_methods_too_large_for_the_jvm_are_not_made(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
