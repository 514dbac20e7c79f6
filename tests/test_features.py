import datetime as dt

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from funnelspark.operators import features, labels, store
from funnelspark.operators.clean import clean_events
from funnelspark.schemas import FEATURE_TABLE_COLUMNS
from funnelspark.session import stage

CREATED = dt.datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def events(events_of):
    return events_of(
        [
            (0, "view", 1, 1, "s1", 10.0, "Acme", "home.lamp"),
            (1, "cart", 1, 1, "s1", 10.0, "Acme", "home.lamp"),
            (2, "purchase", 1, 1, "s1", 10.0, "Acme", "home.lamp"),
            (3, "cart", 2, 1, "s1", 30.0, None, None),
            (4, "cart", 1, 2, "s2", 10.0, "acme", "HOME.lamp"),
            (5, "purchase", 1, 3, "s3", 20.0, "acme", "home"),
        ]
    )


@pytest.fixture(scope="module")
def samples(events):
    return stage(labels.cart_samples(clean_events(events)), "samples")


@pytest.fixture(scope="module")
def table(events, samples):
    return stage(features.assemble_features_v2(samples, events, CREATED), "table")


def test_user_aggregates(events):
    got = {r.user_id: r for r in features.agg_user(events).collect()}
    one = got[1]
    assert (one.user_total_events, one.user_total_views, one.user_total_carts, one.user_total_purchases) == (4, 1, 2, 1)
    assert (one.user_view_to_cart_rate, one.user_cart_to_purchase_rate) == (2.0, 0.5)
    assert (one.user_unique_products, one.user_unique_categories) == (2, 2)
    # No purchase: mean price 0; no views or carts: rates 0.
    assert (got[2].user_avg_purchase_price, got[2].user_view_to_cart_rate) == (0.0, 0.0)
    assert got[3].user_cart_to_purchase_rate == 0.0


def test_product_buyers_differ_between_the_two_definitions(events):
    plain = {r.product_id: r.product_unique_buyers for r in features.agg_product(events).collect()}
    export = features.agg_product_clipped(features.export_events(events))
    clipped = {r.product_id: r.product_unique_buyers for r in export.collect()}
    assert plain == {1: 2, 2: 0} and clipped == {1: 3, 2: 1}


def test_feature_table(table):
    assert table.columns == FEATURE_TABLE_COLUMNS
    got = {(r.user_id, r.product_id): r for r in table.collect()}
    assert len(got) == 3
    first = got[(1, 1)]
    assert first.is_purchased == 1 and first.brand == "acme" and first.activity_count == 2
    assert first.price_vs_user_avg == 1.0 and first.price_vs_category_avg == pytest.approx(10 / 12)
    # A user without purchases counts as paying the average.
    assert got[(2, 1)].price_vs_user_avg == 1.0
    unknown = got[(1, 2)]
    assert (unknown.brand, unknown.category_code_level1, unknown.category_code_level2) == ("unknown",) * 3
    assert unknown.event_weekday == 0 and unknown.event_hour == 10


def test_clipped_feature_table(events):
    table = features.assemble_features_clipped(events)
    got = {(r.user_id, r.product_id): r for r in table.collect()}
    assert got[(1, 1)].is_purchased == 1 and got[(1, 1)].user_view_to_cart_rate == 1.0
    # No purchases: the ratio and the mean price are 0; activity is the product's event count.
    assert (got[(2, 1)].price_vs_user_avg, got[(2, 1)].user_avg_purchase_price) == (0.0, 0.0)
    assert got[(2, 1)].activity_count == 5 and got[(2, 1)].price_vs_category_avg == 1.0


def test_as_of_totals_look_at_earlier_events_only(events, samples):
    got = rows(
        features.assemble_as_of(samples, events),
        "user_id", "product_id", "user_total_events", "user_total_purchases", "product_total_events",
    )
    assert got == [(1, 1, 1, 0, 1), (1, 2, 3, 1, 0), (2, 1, 0, 0, 3)]


def test_as_of_features_equal_a_plain_walk_over_the_log(events_of):
    import random

    from funnelspark.schemas import ALL_FEATURES

    rng = random.Random(5)
    kinds = ["view", "view", "cart", "cart", "purchase"]
    data = [
        # Many events share an instant; some have no user, price or brand.
        (
            rng.randrange(60) * 2.5, rng.choice(kinds), rng.randrange(4), rng.choice([1, 2, 3, None]), "s",
            rng.choice([10.0, 2.5, None]), rng.choice(["Acme", "zeta", None]), rng.choice(["home.lamp", "Toys", None]),
        )
        for _ in range(250)
    ]
    events = events_of(data)
    carts = events.filter("event_type = 'cart'").select(
        "event_time", "user_id", "product_id", F.lower(F.coalesce("brand", F.lit("unknown"))).alias("brand"), "price",
        F.lower(F.coalesce(F.split("category_code", r"[.]")[0], F.lit("unknown"))).alias("category_code_level1"),
        F.lit("unknown").alias("category_code_level2"), F.lit(0).alias("event_weekday"), F.lit(1).alias("activity_count"),
    )
    got = features.assemble_as_of(carts, events)
    assert set(ALL_FEATURES) <= set(got.columns) and got.count() == carts.count()

    def mean(values):
        known = [v for v in values if v is not None]
        return sum(known) / len(known) if known else 0.0

    def plain(minutes, product, user, brand, code, price):
        past = [e for e in data if e[0] < minutes]
        of_user = [e for e in past if user is not None and e[3] == user]
        of_product = [e for e in past if e[2] == product]
        of_brand = [e for e in past if (e[6] or "unknown").lower() == brand]
        of_code = [e for e in past if (e[7] or "unknown").lower().split(".")[0] == code]
        bought = mean([e[5] for e in of_user if e[1] == "purchase"])
        usual = mean([e[5] for e in of_code])
        sold = sum(e[1] == "purchase" for e in of_brand), sum(e[1] == "cart" for e in of_brand)
        return (
            len(of_user), len({e[2] for e in of_user}), len({(e[7] or "unknown").lower().split(".")[0] for e in of_user}),
            bought, len(of_product), len({e[3] for e in of_product if e[1] == "purchase" and e[3] is not None}),
            sold[0] / sold[1] if sold[1] else 0.0,
            None if price is None and bought else price / bought if bought else 1.0,
            None if price is None and usual else price / usual if usual else 1.0,
        )

    for r in got.collect():
        minutes = (r.event_time - at(0)).total_seconds() / 60
        want = plain(minutes, r.product_id, r.user_id, r.brand, r.category_code_level1, r.price)
        seen = (
            r.user_total_events, r.user_unique_products, r.user_unique_categories, r.user_avg_purchase_price,
            r.product_total_events, r.product_unique_buyers, r.brand_purchase_rate, r.price_vs_user_avg,
            r.price_vs_category_avg,
        )
        assert seen == pytest.approx(want, nan_ok=True)


def test_as_of_features_of_no_samples(events, samples):
    assert features.assemble_as_of(samples.limit(0), events).count() == 0
    alone = features.assemble_as_of(samples, events.limit(0)).collect()
    assert len(alone) == 3 and {(r.user_unique_products, r.price_vs_user_avg) for r in alone} == {(0, 1.0)}


def test_product_lookup_takes_the_smallest_of_equal_modes(spark, table):
    users, products = store.build_lookup_tables(table)
    assert rows(products, "product_id", "price", "brand") == [(1, 10.0, "acme"), (2, 30.0, "unknown")]
    pairs = spark.createDataFrame(
        [("1", " 2 "), ("x", "1"), ("2", "99"), ("77", "99")], "user_id string, product_id string"
    )
    found, missing = store.lookup_features(pairs, users, products)
    got = {(r.user_id, r.product_id): r for r in found.collect()}
    assert rows(missing) == [("77", "99")]
    assert got[("x", "1")].event_hour == 12 and got[("x", "1")].user_total_events == 0
    assert got[("2", "99")].brand == "unknown" and got[("2", "99")].price == 0.0


def test_latest_rows_and_ttl(spark):
    table = spark.createDataFrame(
        [(1, 1, at(0), 5.0), (1, 1, at(9), 7.0), (2, 1, at(1), 3.0)],
        "user_id long, product_id long, event_timestamp timestamp, price double",
    )
    latest = store.materialize_latest(table)
    assert rows(latest, "user_id", "price") == [(1, 7.0), (2, 3.0)]
    cut = at(5) + dt.timedelta(days=3650)
    assert rows(store.ttl_filter(table, cut), "price") == [(7.0,)]


def test_published_tables_are_typed(spark):
    text = spark.createDataFrame(
        [("1", "x", "2024-01-01 00:00:00", "A", None, "9.5", "3")],
        "user_id string, product_id string, event_timestamp string, brand string, "
        "category_code_level1 string, price string, activity_count string",
    )
    out = store.publish_features_v2(text, CREATED)
    assert out.columns == [c for c in FEATURE_TABLE_COLUMNS if c in out.columns]
    r = out.first()
    assert (r.user_id, r.product_id, r.brand, r.category_code_level1, r.price, r.activity_count) == (
        1, 0, "a", "unknown", 9.5, 3,
    )
