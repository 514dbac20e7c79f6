"""User, product, brand and category features and their assembly.

Every aggregate is mergeable, so Spark combines rows on the map side and a hot user or product
costs one partial row per input partition. Assembling reads the log once: its counts by user, product,
event type, brand and category are stored, and all aggregates are taken from them. Feature joins broadcast a
side whose stored size allows it, and otherwise spread the rows of the heaviest keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import (
    ALL_FEATURES,
    CATEGORICAL_FEATURES,
    FEATURE_TABLE_COLUMNS,
    NUMERIC_FEATURES,
)
from ..session import stage
from .clean import dedup_feature_rows, fill_defaults
from .joins import spread_left_join
from .labels import label_same_session


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _weighted(events: DataFrame) -> DataFrame:
    """Events, or event counts, with ``_n`` events, ``_priced`` of them with a price and ``_sum`` of their prices."""
    if "_n" in events.columns:
        return events
    return events.withColumns(
        {"_n": F.lit(1).cast("bigint"), "_priced": F.col("price").isNotNull().cast("bigint"), "_sum": F.col("price")}
    )


def event_counts(events: DataFrame, *more: str) -> DataFrame:
    """The log counted by user, product, event type and the columns of ``more``, stored: one scan and one shuffle
    for all aggregates over it. They accept it in place of events."""
    keys = ["user_id", "product_id", "event_type", *more]
    counted = _weighted(events).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_n", "_priced", "_sum")])
    return stage(counted, "event-counts")


def _number(condition: Column) -> Column:
    """How many events fulfil a condition."""
    return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))


def _mean_price(condition: Column | None = None) -> Column:
    """Mean price of the events that fulfil a condition."""
    total, count = F.col("_sum"), F.col("_priced")
    if condition is not None:
        total, count = F.when(condition, total), F.when(condition, count)
    return F.try_divide(F.sum(total), F.sum(count))


def _totals(prefix: str) -> list[Column]:
    return [
        F.sum("_n").alias(f"{prefix}_total_events"),
        _number(_is("view")).alias(f"{prefix}_total_views"),
        _number(_is("cart")).alias(f"{prefix}_total_carts"),
        _number(_is("purchase")).alias(f"{prefix}_total_purchases"),
    ]


def _rates(prefix: str, rate) -> dict[str, Column]:
    views, carts, purchases = (
        f"{prefix}_total_{what}" for what in ("views", "carts", "purchases")
    )
    return {
        f"{prefix}_view_to_cart_rate": rate(carts, views),
        f"{prefix}_cart_to_purchase_rate": rate(purchases, carts),
    }


def _distinct(col: Column | str, approximate: bool) -> Column:
    return F.approx_count_distinct(col) if approximate else F.countDistinct(col)


def agg_user(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Per user over raw events. ``approximate`` swaps exact distinct counts for sketches."""
    level1 = F.lower(F.coalesce(C.level1("category_code"), F.lit(C.UNKNOWN)))
    return (
        _weighted(events)
        .groupBy("user_id")
        .agg(
            *_totals("user"),
            _mean_price(_is("purchase")).alias("user_avg_purchase_price"),
            _distinct("product_id", approximate).alias("user_unique_products"),
            _distinct(level1, approximate).alias("user_unique_categories"),
        )
        .withColumns(_rates("user", C.guarded_rate))
        .fillna({"user_avg_purchase_price": 0.0})
    )


def agg_product(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Per product over raw events; unique buyers count purchase events only."""
    buyer = F.when(_is("purchase"), F.col("user_id"))
    return (
        _weighted(events)
        .groupBy("product_id")
        .agg(*_totals("product"), _distinct(buyer, approximate).alias("product_unique_buyers"))
        .withColumns(_rates("product", C.guarded_rate))
    )


def agg_brand(events: DataFrame) -> DataFrame:
    """Per normalized brand: purchases, carts, mean price and purchase rate."""
    return (
        _weighted(events)
        .groupBy(C.clean_category("brand").alias("brand_clean"))
        .agg(
            _number(_is("purchase")).alias("brand_total_purchases"),
            _number(_is("cart")).alias("brand_total_carts"),
            _mean_price().alias("brand_avg_price"),
        )
        .withColumn(
            "brand_purchase_rate", C.guarded_rate("brand_total_purchases", "brand_total_carts")
        )
    )


def agg_category(events: DataFrame) -> DataFrame:
    """Per first category level: mean price and purchases."""
    return (
        _weighted(events)
        .groupBy(C.level1(C.clean_category("category_code")).alias("category_level1"))
        .agg(
            _mean_price().alias("category_avg_price"),
            _number(_is("purchase")).alias("category_total_purchases"),
        )
    )


def join_user_features(samples: DataFrame, user: DataFrame) -> DataFrame:
    """Left join by user."""
    return spread_left_join(samples, user, ["user_id"], "user_total_events")


def join_product_features(samples: DataFrame, product: DataFrame) -> DataFrame:
    """Left join by product."""
    return spread_left_join(samples, product, ["product_id"], "product_total_events")


def join_brand_features(samples: DataFrame, brand: DataFrame) -> DataFrame:
    """Left join by normalized brand."""
    side = brand.select("brand_clean", "brand_purchase_rate", "brand_avg_price", "brand_total_carts")
    keyed = samples.withColumn("brand_clean", C.clean_category("brand"))
    joined = spread_left_join(keyed, side, ["brand_clean"], "brand_total_carts")
    return joined.drop("brand_clean", "brand_total_carts")


def join_category_features(samples: DataFrame, category: DataFrame) -> DataFrame:
    """Left join by first category level."""
    side = category.withColumnRenamed("category_level1", "category_code_level1")
    joined = spread_left_join(samples, side, ["category_code_level1"], "category_total_purchases")
    return joined.drop("category_total_purchases")


def price_vs_user_avg() -> Column:
    """Price over the user's mean purchase price, 1 without one."""
    return C.ratio_or_one("price", "user_avg_purchase_price")


def price_vs_category_avg() -> Column:
    """Price over the category's mean price, 1 without one."""
    return C.ratio_or_one("price", "category_avg_price")


def final_feature_select(features: DataFrame) -> DataFrame:
    """The 31 columns of the feature table, in order."""
    return features.select(*FEATURE_TABLE_COLUMNS)


def assemble_features_v2(
    samples: DataFrame,
    events: DataFrame,
    created_at: dt.datetime,
    approximate: bool = False,
) -> DataFrame:
    """Feature table: cart samples joined with aggregates over raw events.

    Duplicate samples are dropped while rows are still narrow; the joined columns depend only on
    the sample, so the outcome is that of a drop at the end.
    """
    rows = dedup_feature_rows(samples.withColumnRenamed("event_time", "event_timestamp"))
    counts = event_counts(events, "brand", "category_code")
    joined = join_category_features(rows, agg_category(counts))
    joined = join_brand_features(joined, agg_brand(counts))
    joined = join_product_features(joined, agg_product(counts, approximate))
    joined = join_user_features(joined, agg_user(counts, approximate))
    derived = joined.withColumns(
        {
            "price_vs_user_avg": price_vs_user_avg(),
            "price_vs_category_avg": price_vs_category_avg(),
            "event_hour": C.hour("event_timestamp"),
            "created_timestamp": F.lit(created_at.isoformat(sep=" ")).cast("timestamp"),
        }
    )
    return final_feature_select(fill_defaults(derived))


def export_events(events: DataFrame) -> DataFrame:
    """Events with the export path's categories, brand, weekday and hour."""
    return events.withColumns(
        {
            "category_code_level1": C.level1_rest("category_code"),
            "category_code_level2": C.level2_rest("category_code"),
            "brand": C.clean_category("brand", trim=True),
            "event_weekday": C.weekday("event_time", default=0),
            "event_hour": C.hour("event_time", default=12),
        }
    )


def agg_user_clipped(events: DataFrame) -> DataFrame:
    """Per user of export events: capped rates; mean purchase price is null without purchases."""
    return (
        _weighted(events)
        .groupBy("user_id")
        .agg(
            *_totals("user"),
            F.countDistinct("product_id").alias("user_unique_products"),
            F.countDistinct("category_code_level1").alias("user_unique_categories"),
            _mean_price(_is("purchase")).alias("user_avg_purchase_price"),
        )
        .withColumns(_rates("user", C.clipped_rate))
    )


def agg_product_clipped(events: DataFrame) -> DataFrame:
    """Per product of export events: capped rates; unique buyers count every user."""
    return (
        _weighted(events)
        .groupBy("product_id")
        .agg(*_totals("product"), F.countDistinct("user_id").alias("product_unique_buyers"))
        .withColumns(_rates("product", C.clipped_rate))
    )


def agg_brand_clipped(events: DataFrame) -> DataFrame:
    """Per brand of export events: purchases, carts and the capped purchase rate."""
    return (
        _weighted(events)
        .groupBy("brand")
        .agg(
            _number(_is("purchase")).alias("brand_purchases"),
            _number(_is("cart")).alias("brand_carts"),
        )
        .withColumn("brand_purchase_rate", C.clipped_rate("brand_purchases", "brand_carts"))
    )


def assemble_features_clipped(events: DataFrame) -> DataFrame:
    """Export feature table: capped rates, same-session label, activity from the product."""
    ready = export_events(events)
    carts = label_same_session(ready)
    counts = event_counts(ready, "brand", "category_code_level1")
    joined = spread_left_join(carts, agg_brand_clipped(counts), ["brand"], "brand_carts")
    joined = join_product_features(joined, agg_product_clipped(counts))
    joined = join_user_features(joined, agg_user_clipped(counts))
    average = F.greatest(F.col("user_avg_purchase_price"), F.lit(0.01))
    derived = joined.withColumns(
        {
            "activity_count": F.col("product_total_events"),
            # greatest() skips nulls, so the missing average has to be ruled out first.
            "price_vs_user_avg": F.when(
                F.col("user_avg_purchase_price").isNotNull(), F.col("price") / average
            ),
            "price_vs_category_avg": F.lit(1.0),
        }
    )
    return derived.fillna(0, subset=NUMERIC_FEATURES).select(
        "user_id", "product_id", "user_session", "event_time", *ALL_FEATURES, "is_purchased"
    )


def agg_user_lookup(features: DataFrame) -> DataFrame:
    """One row per user: its constant columns, with hour and weekday of its earliest row."""
    constants = [
        c for c in FEATURE_TABLE_COLUMNS if c.startswith("user_") and c != "user_id"
    ]
    first = F.struct("event_timestamp", "product_id")
    return features.groupBy("user_id").agg(
        F.min_by("event_hour", first).alias("event_hour"),
        F.min_by("event_weekday", first).alias("event_weekday"),
        *[F.min_by(c, first).alias(c) for c in constants],
    )


def agg_product_lookup(features: DataFrame) -> DataFrame:
    """One row per product: mean price and activity, first constants, most frequent categories.

    Modes are taken from counts per (product, column, value): ties go to the smallest value, and a
    product with only nulls gets "unknown".
    """
    firsts = [
        c for c in FEATURE_TABLE_COLUMNS if c.startswith("product_") and c != "product_id"
    ] + ["brand_purchase_rate", "price_vs_user_avg", "price_vs_category_avg"]
    first = F.struct("event_timestamp", "user_id")
    main = features.groupBy("product_id").agg(
        F.avg("price").alias("price"),
        *[F.min_by(c, first).alias(c) for c in firsts],
        F.avg("activity_count").alias("activity_count"),
    )
    counts = (
        features.select("product_id", *CATEGORICAL_FEATURES)
        .unpivot(["product_id"], CATEGORICAL_FEATURES, "column", "value")
        .filter("value is not null")
        .groupBy("product_id", "column", "value")
        .agg(F.count("*").alias("n"))
    )
    rank = F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))
    modes = counts.groupBy("product_id").agg(
        *[
            F.min_by(
                F.when(F.col("column") == c, F.col("value")), F.when(F.col("column") == c, rank)
            ).alias(c)
            for c in CATEGORICAL_FEATURES
        ]
    )
    return main.join(modes, "product_id", "left").fillna(C.UNKNOWN, subset=CATEGORICAL_FEATURES)


# What the past of a sample is counted by: its user, product, brand and category.
PAST = ("user", "product", "brand", "category")


def _subjects(brand: Column, category: Column) -> Column:
    """(kind, key) of everything a row belongs to."""
    keys = dict(zip(PAST, (F.col("user_id"), F.col("product_id"), brand, category)))
    return F.array(
        *[F.struct(F.lit(k).alias("kind"), keys[k].cast("string").alias("key")) for k in PAST]
    )


def _first_seen(events: DataFrame) -> DataFrame:
    """Instants at which a user meets a new product or category, or a product a new buyer.

    The number of distinct values before some time is the number of first occurrences before it. They
    are mergeable minima, so copies collapse before the shuffle.
    """
    met = stage(
        events.groupBy(
            "user_id",
            "product_id",
            F.lower(F.coalesce(C.level1("category_code"), F.lit(C.UNKNOWN))).alias("level1"),
        ).agg(
            F.min("event_time").alias("seen"),
            F.min(F.when(_is("purchase"), F.col("event_time"))).alias("bought"),
        ),
        "first-seen",
    )
    out = None
    for kind, subject, value, when, name in (
        ("user", "user_id", "product_id", "seen", "products"),
        ("user", "user_id", "level1", "seen", "categories"),
        ("product", "product_id", "user_id", "bought", "buyers"),
    ):
        firsts = (
            met.filter(F.col(value).isNotNull())
            .groupBy(subject, value)
            .agg(F.min(when).alias("event_time"))
            .select(
                F.lit(kind).alias("kind"),
                F.col(subject).cast("string").alias("key"),
                "event_time",
                F.lit(1).cast("bigint").alias(name),
            )
        )
        out = firsts if out is None else out.unionByName(firsts, allowMissingColumns=True)
    return out


def _past_instants(samples: DataFrame, events: DataFrame) -> DataFrame:
    """One stored row per (kind, key, instant): what happens then, and whether a sample asks for its past."""
    names = ("events", "views", "carts", "purchases", "priced", "spent", "bought", "paid")
    priced = F.col("price").isNotNull()
    flags = dict(
        zip(
            names,
            (
                F.lit(True), _is("view"), _is("cart"), _is("purchase"),
                priced, priced, _is("purchase") & priced, _is("purchase") & priced,
            ),
        )
    )
    sums = {
        n: F.when(f, F.col("price") if n in ("spent", "paid") else F.lit(1).cast("bigint")) for n, f in flags.items()
    }
    happened = events.select(
        "event_time",
        *[c.alias(n) for n, c in sums.items()],
        F.inline(_subjects(C.clean_category("brand"), C.level1(C.clean_category("category_code")))),
    )
    asked = samples.select(
        "event_time",
        F.lit(1).alias("asked"),
        F.inline(_subjects(C.clean_category("brand"), F.col("category_code_level1"))),
    )
    steps = happened.unionByName(_first_seen(events), allowMissingColumns=True).unionByName(
        asked, allowMissingColumns=True
    )
    measures = [*names, "products", "categories", "buyers"]
    known = steps.filter(F.col("key").isNotNull() & F.col("event_time").isNotNull())
    return stage(
        known.groupBy("kind", "key", "event_time").agg(
            F.max("asked").alias("asked"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]
        ),
        "instants",
    )


def past_totals(instants: DataFrame, measures: list[str]) -> DataFrame:
    """(kind, key, event_time, measures): totals over strictly earlier instants, where a sample asks for them.

    Totals are first taken per (key, time slice) and accumulated over slices; an instant adds those of its
    own slice. So no window runs over the rows of a whole key.
    """
    from .ordered import time_slice

    cut = instants.withColumn("_slice", time_slice("event_time"))
    inside = (
        Window.partitionBy("kind", "key", "_slice")
        .orderBy("event_time")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        Window.partitionBy("kind", "key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    near = cut.withColumns({m: F.sum(m).over(inside) for m in measures}).filter("asked = 1")
    far = (
        cut.groupBy("kind", "key", "_slice")
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select("kind", "key", "_slice", *[F.sum(m).over(before).alias(f"_far_{m}") for m in measures])
    )
    return near.join(far, ["kind", "key", "_slice"], "left").select(
        "kind",
        "key",
        "event_time",
        *[(F.coalesce(m, F.lit(0)) + F.coalesce(f"_far_{m}", F.lit(0))).alias(m) for m in measures],
    )


# Columns of the feature table that come from the past of one kind, and the totals they are made of.
PAST_COLUMNS = {
    "user": {
        "events": "user_total_events", "views": "user_total_views", "carts": "user_total_carts",
        "purchases": "user_total_purchases", "bought": "_bought", "paid": "_paid",
        "products": "user_unique_products", "categories": "user_unique_categories",
    },
    "product": {
        "events": "product_total_events", "views": "product_total_views", "carts": "product_total_carts",
        "purchases": "product_total_purchases", "buyers": "product_unique_buyers",
    },
    "brand": {"carts": "_brand_carts", "purchases": "_brand_purchases"},
    "category": {"priced": "_category_priced", "spent": "_category_spent"},
}


def assemble_as_of(samples: DataFrame, events: DataFrame) -> DataFrame:
    """Samples with all model features, where every aggregate looks at strictly earlier events only (no leakage).

    The definitions are those of `assemble_features_v2`. Distinct products, categories and buyers are
    running totals of first occurrences. The log is read twice: for its counts by user, product, brand and
    category at once, and for first occurrences. A sample without time or key has no past: its totals are 0, its
    price ratios 1. Repeated samples stay.
    """
    measures = sorted({m for columns in PAST_COLUMNS.values() for m in columns})
    past = stage(past_totals(_past_instants(samples, events), measures), "past")
    keys = dict(
        zip(
            PAST,
            (F.col("user_id"), F.col("product_id"), C.clean_category("brand"), F.col("category_code_level1")),
        )
    )
    out = samples
    for kind, columns in PAST_COLUMNS.items():
        side = past.filter(F.col("kind") == kind).select(
            F.col("key").alias("_k"), F.col("event_time").alias("_t"),
            *[F.col(m).alias(c) for m, c in columns.items()],
        )
        same = (keys[kind].cast("string") == F.col("_k")) & (F.col("event_time") == F.col("_t"))
        out = out.join(side, same, "left").drop("_k", "_t").fillna(0, list(columns.values()))
    category_average = F.try_divide("_category_spent", "_category_priced")
    paid = F.coalesce(F.try_divide("_paid", "_bought"), F.lit(0.0))
    ready = out.withColumns({"user_avg_purchase_price": paid, "category_avg_price": category_average})
    derived = ready.withColumns(
        {
            **_rates("user", C.guarded_rate),
            **_rates("product", C.guarded_rate),
            "brand_purchase_rate": C.guarded_rate("_brand_purchases", "_brand_carts"),
            "price_vs_user_avg": price_vs_user_avg(),
            "price_vs_category_avg": price_vs_category_avg(),
            "event_hour": C.hour("event_time"),
        }
    )
    made = [c for c in ALL_FEATURES if c not in samples.columns]
    return derived.select(*samples.columns, *made)
