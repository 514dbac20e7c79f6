import datetime as dt
import random

import pytest
from helpers import at, in_order, rows
from pyspark.sql import functions as F

from funnelspark.operators import labels
from funnelspark.operators.clean import clean_events, filter_event_type

JOURNEY_TIMES = ["purchase_time", "cart_time", "earlier_carts"]


def credited(events):
    return rows(labels.label_last_cart(events), *JOURNEY_TIMES)


def test_two_purchases_of_one_cart_label_it_once(events_of):
    events = events_of([(0, "cart", 1, 1, "s"), (5, "purchase", 1, 1, "s"), (9, "purchase", 1, 1, "s")])
    credits = labels.label_last_cart(events)
    assert credits.count() == 2
    carts = filter_event_type(events, "cart")
    assert rows(labels.label_carts(carts, credits), "event_time", "is_purchased") == [(at(0), 1)]


def test_only_the_last_earlier_cart_is_credited(events_of):
    events = events_of([(0, "cart", 1, 1, "s"), (5, "cart", 1, 1, "s"), (9, "purchase", 1, 1, "s")])
    assert credited(events) == [(at(9), at(5), 2)]


def test_a_cart_of_the_same_instant_is_not_earlier(events_of):
    events = events_of([(5, "cart", 1, 1, "s"), (5, "purchase", 1, 1, "s")])
    assert credited(events) == []
    events = events_of([(1, "cart", 1, 1, "s"), (5, "cart", 1, 1, "s"), (5, "purchase", 1, 1, "s")])
    assert credited(events) == [(at(5), at(1), 1)]


def test_session_rules(events_of):
    events = events_of([(0, "cart", 1, 1, "s1"), (5, "purchase", 1, 1, "s2"), (6, "cart", 2, 1, "s1")])
    assert credited(events) == []
    assert rows(labels.label_same_session(events), "is_purchased") == [(0,), (0,)]
    later = labels.label_any_later(events)
    assert rows(later, "product_id", "is_purchased") == [(1, 1), (2, 0)]


def test_same_session_label_ignores_the_order(events_of):
    events = events_of([(5, "cart", 1, 1, "s"), (0, "purchase", 1, 1, "s"), (1, "purchase", 1, 1, "s")])
    assert rows(labels.label_same_session(events), "is_purchased") == [(1,)]


def brute_force_credits(data):
    out = []
    for m, kind, product, user, session in data:
        if kind != "purchase":
            continue
        earlier = [
            c[0] for c in data if c[1] == "cart" and c[2:] == (product, user, session) and c[0] < m
        ]
        if earlier:
            out.append((at(m), at(max(earlier)), len(earlier)))
    return in_order(out)


@pytest.mark.parametrize("slice_minutes", [1, 7, 60, 100_000])
def test_credits_match_brute_force_for_any_slice_length(events_of, slice_minutes):
    rng = random.Random(slice_minutes)
    # One journey holds most of the events, spread over many slices.
    data = {
        (rng.randrange(3000), rng.choice(["cart", "purchase", "view"]), 1, 1, "hot") for _ in range(300)
    } | {
        (rng.randrange(300), rng.choice(["cart", "purchase"]), rng.randrange(3), rng.randrange(3), "s")
        for _ in range(100)
    }
    data = sorted(data)
    got = labels.label_last_cart(events_of(data), slice_us=slice_minutes * 60_000_000)
    assert rows(got, *JOURNEY_TIMES) == brute_force_credits(data)


@pytest.mark.parametrize("slice_minutes", [1, 10, 100_000])
def test_activity_count_is_the_position_in_the_session(events_of, slice_minutes):
    rng = random.Random(3)
    data = sorted(
        {(rng.randrange(200), rng.choice(["cart", "view"]), rng.randrange(3), 1, rng.choice("ab")) for _ in range(200)}
    )
    got = labels.activity_count(events_of(data), slice_us=slice_minutes * 60_000_000)
    seen, expected = {}, []
    for m, kind, product, user, session in sorted(data, key=lambda r: (r[4], r[0], r[1], r[2])):
        seen[session] = seen.get(session, 0) + 1
        expected.append((session, at(m), kind, product, seen[session]))
    columns = ["user_session", "event_time", "event_type", "product_id", "activity_count"]
    assert rows(got, *columns) == in_order(expected)


def test_samples_keep_every_cart(events_of):
    rng = random.Random(5)
    data = [
        (rng.randrange(500), rng.choice(["cart", "purchase", "view"]), rng.randrange(4), rng.randrange(4), rng.choice(["a", "b", "NULL"]))
        for _ in range(300)
    ]
    clean = clean_events(events_of(data))
    samples = labels.cart_samples(clean)
    assert samples.count() == clean.filter("event_type = 'cart'").count()
    assert {r[0] for r in samples.select("is_purchased").distinct().collect()} <= {0, 1}


def test_latency_counts_every_pair_within_the_limit(events_of):
    rng = random.Random(11)
    data = [
        (rng.randrange(400) / 2, rng.choice(["cart", "purchase"]), rng.randrange(2), 1, "s") for _ in range(200)
    ]
    expected = {}
    for c in data:
        for p in data:
            if c[1] == "cart" and p[1] == "purchase" and c[2] == p[2] and 0 <= p[0] - c[0] <= 60:
                key = (c[2], at(c[0]), at(p[0]))
                expected[key] = expected.get(key, 0) + 1
    got = labels.cart_purchase_latency(events_of(data), 3600)
    assert {
        (r.product_id, r.cart_time, r.purchase_time): r.pairs for r in got.collect()
    } == expected


def test_latency_of_a_heavy_bucket_is_cut_into_cells(spark, events_of):
    rng = random.Random(3)
    data = [(rng.randrange(600) / 10, rng.choice(["cart", "purchase"]), 1, 1, "hot") for _ in range(900)]
    data += [(1, "cart", 2, 1, "s"), (2, "purchase", 2, 1, "s"), (3, "cart", 1, 1, None), (4, "purchase", 1, 1, None)]
    events = events_of(data)
    keys = ["user_session", "product_id", "cart_time", "purchase_time", "pairs"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in (old, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            whole = labels.cart_purchase_latency(events, 3600).select(*keys)
            cut = labels.cart_purchase_latency(events, 3600, cell=50).select(*keys)
            assert whole.count() == cut.count() > 10_000
            assert whole.exceptAll(cut).isEmpty()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Rows of a join key are about a cell, whatever the bucket holds.
    counted = events.filter("user_session = 'hot'").groupBy("user_session", "product_id", "event_type", "event_time").count()
    sides = [
        counted.filter(F.col("event_type") == k).select(
            "user_session", "product_id", F.col("event_time").alias(f"{k}_time"), F.lit(0).cast("bigint").alias("bucket")
        )
        for k in ("cart", "purchase")
    ]
    axes = ["user_session", "product_id", "bucket"]
    grid = labels._heavy_buckets(*sides, axes, 50)
    dealt = labels._dealt(sides[0], grid, axes, "cart_time", "_row", "_column")
    sizes = dealt.groupBy("_row", "_column").count().collect()
    assert len(sizes) > 16 and max(r["count"] for r in sizes) < 100


def test_missing_columns_are_added_only_where_absent(events_of):
    from funnelspark.operators.clean import fill_missing_columns

    events = events_of([(0, "cart", 1, 1, "s"), (1, "cart", 1, 1, "s")])
    filled = fill_missing_columns(events.withColumn("event_weekday", F.lit(9)))
    assert rows(filled, "event_weekday", "activity_count") == [(9, 1), (9, 2)]
    assert at(0).weekday() == 0 and isinstance(at(0), dt.datetime)
