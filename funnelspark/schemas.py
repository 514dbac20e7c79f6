"""Schemas and column lists of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Event log fields.
EVENTS = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("category_code", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_session", T.StringType()),
    ]
)
EVENT_KEYS = ["user_id", "user_session", "event_time", "event_type", "product_id"]

# Columns of a labelled cart sample.
SAMPLE_COLUMNS = [
    "event_time", "user_id", "product_id", "category_code_level1", "category_code_level2",
    "brand", "event_weekday", "price", "activity_count", "is_purchased",
]

# Model features, in the order ties and vectors rely on.
NUMERIC_FEATURES = [
    "price", "activity_count", "event_weekday", "event_hour",
    "user_total_events", "user_total_views", "user_total_carts", "user_total_purchases",
    "user_view_to_cart_rate", "user_cart_to_purchase_rate", "user_avg_purchase_price",
    "user_unique_products", "user_unique_categories",
    "product_total_events", "product_total_views", "product_total_carts", "product_total_purchases",
    "product_view_to_cart_rate", "product_cart_to_purchase_rate", "product_unique_buyers",
    "brand_purchase_rate", "price_vs_user_avg", "price_vs_category_avg",
]
CATEGORICAL_FEATURES = ["brand", "category_code_level1", "category_code_level2"]
ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES

# The reduced scoring input.
LITE_FEATURES = [
    "price", "activity_count", "event_weekday", "event_hour", "user_total_views", "user_total_carts",
    "product_total_views", "product_total_carts", "brand_purchase_rate", "price_vs_user_avg",
    "price_vs_category_avg", "brand", "category_code_level1", "category_code_level2",
]

TARGET = "is_purchased"

# Integer and floating columns of the published feature table.
LONG_COLUMNS = [
    "event_weekday", "event_hour", "activity_count", "user_total_events", "user_total_views",
    "user_total_carts", "user_total_purchases", "user_unique_products", "user_unique_categories",
    "product_total_events", "product_total_views", "product_total_carts", "product_total_purchases",
    "product_unique_buyers", "is_purchased",
]
DOUBLE_COLUMNS = [
    "price", "user_view_to_cart_rate", "user_cart_to_purchase_rate", "user_avg_purchase_price",
    "product_view_to_cart_rate", "product_cart_to_purchase_rate", "brand_purchase_rate",
    "price_vs_user_avg", "price_vs_category_avg",
]

# The 31 published columns, in order.
FEATURE_TABLE_COLUMNS = [
    "user_id", "product_id", "event_timestamp", "created_timestamp",
    "category_code_level1", "category_code_level2", "brand", "event_weekday", "price",
    "activity_count", "event_hour",
    "user_total_events", "user_total_views", "user_total_carts", "user_total_purchases",
    "user_view_to_cart_rate", "user_cart_to_purchase_rate", "user_avg_purchase_price",
    "user_unique_products", "user_unique_categories",
    "product_total_events", "product_total_views", "product_total_carts", "product_total_purchases",
    "product_view_to_cart_rate", "product_cart_to_purchase_rate", "product_unique_buyers",
    "brand_purchase_rate", "price_vs_user_avg", "price_vs_category_avg", "is_purchased",
]

# 20 null replacements; an unknown price ratio means "like the average".
FEATURE_DEFAULTS = {
    "user_total_events": 0, "user_total_views": 0, "user_total_carts": 0, "user_total_purchases": 0,
    "user_view_to_cart_rate": 0.0, "user_cart_to_purchase_rate": 0.0, "user_avg_purchase_price": 0.0,
    "user_unique_products": 0, "user_unique_categories": 0,
    "product_total_events": 0, "product_total_views": 0, "product_total_carts": 0,
    "product_total_purchases": 0, "product_view_to_cart_rate": 0.0,
    "product_cart_to_purchase_rate": 0.0, "product_unique_buyers": 0,
    "brand_purchase_rate": 0.0, "brand_avg_price": 0.0,
    "price_vs_user_avg": 1.0, "price_vs_category_avg": 1.0,
}

# Decision constants.
DECISION_THRESHOLD = 0.525
DISPLAY_THRESHOLD = 0.5
HIGH_CONFIDENCE = 0.15
UNCERTAIN = 0.05
ENCODER_SMOOTHING = 20
ENCODER_FALLBACK = 0.26
FEATURE_TTL_DAYS = 3650

CONTRIBUTION = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("contribution", T.DoubleType()),
        T.StructField("display_name", T.StringType()),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("source_run_id", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
