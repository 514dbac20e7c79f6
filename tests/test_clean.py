import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from funnelspark.functions import columns as C
from funnelspark.operators import clean
from funnelspark.schemas import ALL_FEATURES, LITE_FEATURES


def test_dedup_keeps_one_row_per_key_whatever_the_number_of_copies(events_of):
    copy = (0, "cart", 1, 1, "s", 10.0, "acme", "a.b")
    events = events_of([copy] * 50 + [(0, "cart", 1, 1, "s", 9.0, None, None), (1, "cart", 1, 1, "s")])
    kept = clean.dedup_events(events)
    assert kept.columns == events.columns
    # The smallest by the other columns: a null category code comes first.
    assert rows(kept, "event_time", "price", "brand") == [(at(0), 9.0, None), (at(1), 10.0, "acme")]


def test_sessions_null_and_text_null_are_dropped(events_of):
    events = events_of([(0, "view", 1, 1, None), (0, "view", 1, 1, "NULL"), (0, "view", 1, 1, "s")])
    assert rows(clean.filter_sessions(events), "user_session") == [("s",)]


@pytest.mark.parametrize(
    "code, token, rest",
    [
        ("a", ("a", "unknown"), ("a", "unknown")),
        ("a.b", ("a", "b"), ("a", "b")),
        ("a.b.c", ("a", "b"), ("a", "b.c")),
        ("", ("", "unknown"), ("unknown", "unknown")),
        (None, ("unknown", "unknown"), ("unknown", "unknown")),
    ],
)
def test_category_levels(spark, code, token, rest):
    df = spark.createDataFrame([(code,)], "code string").withColumn("c", C.clean_category("code"))
    got = df.select(
        C.level1("c").alias("t1"), C.level2("c").alias("t2"),
        C.level1_rest("code").alias("r1"), C.level2_rest("code").alias("r2"),
    ).first()
    assert (got.t1, got.t2) == token
    assert (got.r1, got.r2) == rest


def test_rates_guard_their_denominator(spark):
    df = spark.createDataFrame([(3, 2), (3, 0), (0, 4)], "n long, d long")
    got = rows(df.select(C.guarded_rate("n", "d"), C.clipped_rate("n", "d"), C.ratio_or_one("n", "d")))
    assert got == sorted([(1.5, 1.0, 1.5), (0.0, 1.0, 1.0), (0.0, 0.0, 0.0)], key=str)


def test_coercion_takes_bad_text_to_the_default(spark):
    df = spark.createDataFrame([(" 7",), ("3.9",), ("x",), (None,), ("",)], "user_id string")
    got = [r[0] for r in clean.coerce_keys(df, ("user_id",)).collect()]
    assert got == [7, 3, 0, 0, 0]
    text = clean.coerce_with_default(df, texts={"user_id": "none"})
    assert [r[0] for r in text.collect()] == ["7", "3.9", "x", "none", "none"]


def test_labels_other_than_zero_and_one_are_null(spark):
    df = spark.createDataFrame([("1",), ("0.9",), ("2",), ("x",), (None,)], "label string")
    assert [r[0] for r in clean.resolve_label(df).select("actual_label").collect()] == [1, 0, None, None, None]
    assert clean.resolve_label(df.drop("label").withColumn("z", F.lit(1))).first().actual_label is None


def test_headers_and_dirty_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("﻿ A ", "Unnamed: 0", " ")
    assert clean.drop_dirty_columns(clean.normalize_headers(df)).columns == ["a", "unnamed: 0"]
    assert clean.drop_dirty_columns(df).columns == ["﻿ A "]
    with pytest.raises(ValueError, match="zz"):
        clean.require_columns(df, ["zz"])


def _lite(spark, **changes):
    row = dict(
        price=99.99, activity_count=5, event_weekday=1, event_hour=14, user_total_views=80,
        user_total_carts=15, product_total_views=800, product_total_carts=100,
        brand_purchase_rate=0.4, price_vs_user_avg=0.2, price_vs_category_avg=0.1,
        brand="apple", category_code_level1="electronics", category_code_level2="smartphone",
    )
    row.update(changes)
    return spark.createDataFrame([row])


@pytest.mark.parametrize(
    "change, broken",
    [
        ({}, []),
        ({"event_weekday": 7}, ["event_weekday"]),
        ({"event_hour": -1, "price": -0.5}, ["price", "event_hour"]),
        ({"brand_purchase_rate": 1.2}, ["brand_purchase_rate"]),
        ({"price_vs_user_avg": -3.0}, []),
    ],
)
def test_contract_names_the_broken_rules(spark, change, broken):
    df = _lite(spark, **change)
    assert clean.check_contract(df, LITE_FEATURES).first().violations == broken
    valid, quarantined = clean.split_contract(df, LITE_FEATURES)
    assert (valid.count(), quarantined.count()) == ((0, 1) if broken else (1, 0))


def test_feature_set_detection(spark):
    df = _lite(spark)
    assert clean.detect_feature_set(df) == "lite"
    full = df.select("*", *[F.lit(0.0).alias(c) for c in ALL_FEATURES if c not in df.columns])
    assert clean.detect_feature_set(full) == "full"
    with pytest.raises(ValueError, match="brand_purchase_rate"):
        clean.detect_feature_set(df.drop("brand_purchase_rate"))


def test_model_columns_leave_out_keys_times_and_target(spark, events_of):
    df = events_of([(0, "cart", 1, 1, "s")]).withColumn("is_purchased", F.lit(1))
    categorical, numeric = clean.select_model_columns(df)
    assert categorical == ["event_type", "category_code", "brand"]
    assert numeric == ["category_id", "price"]


def test_round_exact_agrees_with_decimal_rounding(spark):
    import random

    rng = random.Random(7)
    values = [rng.randint(0, 10**6) / 1e5 for _ in range(3000)] + [k / 64 for k in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    for digits in (1, 2, 4, 6):
        got = [r[0] for r in df.select(C.round_exact("x", digits)).collect()]
        assert got == [round(v, digits) for v in values]
