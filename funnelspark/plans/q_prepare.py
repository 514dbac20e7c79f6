"""Queries: sources, cleaning, expressions, labels and event order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean as clean_ops
from ..operators import labels as label_ops
from ..operators import store as store_ops
from ..schemas import ALL_FEATURES, LITE_FEATURES, SAMPLE_COLUMNS
from ..session import staging_path
from ..sources import readers, writers
from . import tables
from .prelude import micros, rounded
from .registry import query
from .testbed import table

EVENT_COLUMNS_SQL = (
    f"{micros('event_time')}, event_type, product_id, category_id, category_code, brand, "
    f"{rounded('price', 'price')}, user_id, user_session"
)
SAMPLE_SQL = (
    f"{micros('event_time')}, user_id, product_id, category_code_level1, category_code_level2, brand, "
    f"event_weekday, {rounded('price', 'price')}, activity_count, is_purchased"
)


def _written_events(spark, sf):
    path = staging_path(spark, "events-csv")
    (
        tables.raw(spark, sf)
        .write.option("header", True)
        .option("compression", "gzip")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )
    return path


@query("read_events", f"SELECT {EVENT_COLUMNS_SQL} FROM raw")
def _(spark, sf):
    return readers.read_events(spark, _written_events(spark, sf), partitions=8)


@query(
    "read_table",
    f"SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, {rounded('c_acctbal', 'c_acctbal')}, c_mktsegment FROM customer",
)
def _(spark, sf):
    return readers.read_table(spark, f"{sf}/customer.parquet")


@query("read_feature_table", f"SELECT {SAMPLE_SQL} FROM samples")
def _(spark, sf):
    path = staging_path(spark, "feature-file")
    writers.write_parquet(tables.samples(spark, sf), path)
    return readers.read_feature_table(spark, path)


@query(
    "read_bounded_sample",
    f"""SELECT event_type, {rounded('price', 'price')}, user_id FROM clean
    ORDER BY CAST('0x' || substr(md5(concat_ws(':', user_id, epoch_us(event_time), '42')), 1, 8) AS BIGINT),
      user_id, epoch_us(event_time) LIMIT 500""",
)
def _(spark, sf):
    df = tables.clean(spark, sf).withColumn("at", F.unix_micros("event_time"))
    return readers.read_bounded_sample(df, ["event_type", "price", "user_id"], ["user_id", "at"], 500)


@query("normalize_headers", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, sf):
    messy = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("﻿O_OrderKey"),
        F.col("o_custkey").alias(" O_CUSTKEY "),
        F.col("o_orderstatus").alias("O_OrderStatus"),
    )
    return clean_ops.normalize_headers(messy)


@query("drop_dirty_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    messy = table(spark, sf, "orders").select(
        F.col("o_orderkey"),
        F.col("o_custkey").alias("Unnamed: 0"),
        F.col("o_orderpriority").alias(" "),
        "o_orderstatus",
    )
    return clean_ops.drop_dirty_columns(messy)


@query("require_columns", "SELECT user_id, product_id, event_type FROM raw")
def _(spark, sf):
    return clean_ops.require_columns(
        tables.raw(spark, sf), ["user_id", "product_id", "event_type"]
    )


@query("write_csv", f"SELECT {SAMPLE_SQL} FROM samples")
def _(spark, sf):
    df = tables.samples(spark, sf)
    flat = df.withColumn("event_time", F.unix_micros("event_time"))
    path = writers.write_csv(flat, staging_path(spark, "samples-csv"))
    return spark.read.schema(flat.schema).option("header", True).csv(path)


@query(
    "write_parquet",
    f"SELECT user_id, product_id, {micros('event_timestamp')}, is_purchased, "
    "strftime(event_timestamp, '%Y-%m-%d') AS event_date FROM features",
)
def _(spark, sf):
    path = staging_path(spark, "feature-table")
    writers.write_feature_table(tables.features(spark, sf), path)
    return spark.read.parquet(path).select(
        "user_id", "product_id", "event_timestamp", "is_purchased",
        F.col("event_date").cast("string").alias("event_date"),
    )


@query(
    "write_predictions",
    f"""SELECT count(*) AS rows, count(*) FILTER (score >= 7e-1) AS positives,
    {rounded('count(*) FILTER (score >= 7e-1) / count(*)::DOUBLE', 'positive_share')} FROM scored""",
)
def _(spark, sf):
    from ..operators.score import derive_full_from_lite, score_heuristic, threshold_predict

    rows = score_heuristic(derive_full_from_lite(tables.lite_batch(spark, sf)))
    scored = threshold_predict(rows, tables.BATCH_THRESHOLD)
    return writers.write_predictions(scored, staging_path(spark, "predictions-csv"))


@query(
    "dedup_events",
    f"""SELECT {EVENT_COLUMNS_SQL} FROM (SELECT DISTINCT ON (user_id, user_session, event_time, event_type, product_id) *
    FROM raw)""",
)
def _(spark, sf):
    return clean_ops.dedup_events(tables.raw(spark, sf))


@query("filter_sessions", f"SELECT {EVENT_COLUMNS_SQL} FROM raw WHERE user_session <> 'NULL'")
def _(spark, sf):
    return clean_ops.filter_sessions(tables.raw(spark, sf))


@query("filter_event_type", f"SELECT {EVENT_COLUMNS_SQL} FROM raw WHERE event_type = 'cart'")
def _(spark, sf):
    return clean_ops.filter_event_type(tables.raw(spark, sf), "cart")


@query(
    "normalize_categories",
    f"""SELECT {micros('event_time')}, user_id, coalesce(lower(brand), 'unknown') AS brand,
    coalesce(lower(category_code), 'unknown') AS category_code FROM raw""",
)
def _(spark, sf):
    df = clean_ops.normalize_categories(tables.raw(spark, sf))
    return df.select("event_time", "user_id", "brand", "category_code")


@query(
    "coerce_keys",
    """SELECT coalesce(CAST(trunc(try_cast(user_session AS DOUBLE)) AS BIGINT), 0) AS user_id,
    coalesce(CAST(trunc(try_cast(category_code AS DOUBLE)) AS BIGINT), 0) AS product_id, event_type
    FROM (SELECT event_type, category_code, CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR)
      ELSE user_session END AS user_session FROM raw)""",
)
def _(spark, sf):
    mixed = tables.raw(spark, sf).select(
        F.when(F.col("event_type") == "view", F.col("user_id").cast("string"))
        .otherwise(F.col("user_session"))
        .alias("user_id"),
        F.col("category_code").alias("product_id"),
        "event_type",
    )
    return clean_ops.coerce_keys(mixed)


@query(
    "coerce_numeric",
    f"""SELECT event_type, coalesce(CAST(trunc(try_cast(brand_text AS DOUBLE)) AS BIGINT), 0) AS activity_count,
    {rounded("coalesce(try_cast(price_text AS DOUBLE), 0.0)", 'price')}
    FROM (SELECT event_type, CASE WHEN event_type = 'cart' THEN CAST(price AS VARCHAR) ELSE brand END AS brand_text,
      CASE WHEN event_type = 'view' THEN 'n/a' ELSE CAST(price AS VARCHAR) END AS price_text FROM raw)""",
)
def _(spark, sf):
    text = F.col("price").cast("string")
    mixed = tables.raw(spark, sf).select(
        "event_type",
        F.when(F.col("event_type") == "cart", text).otherwise(F.col("brand")).alias("activity_count"),
        F.when(F.col("event_type") == "view", F.lit("n/a")).otherwise(text).alias("price"),
    )
    return clean_ops.coerce_numeric(mixed)


@query(
    "coerce_with_default",
    f"""SELECT coalesce(CAST(trunc(try_cast(brand AS DOUBLE)) AS BIGINT), 12) AS event_hour,
    {rounded('coalesce(try_cast(price AS DOUBLE), 1.5)', 'price')},
    coalesce(nullif(trim(category_code), ''), 'none') AS category_code
    FROM (SELECT brand, CASE WHEN event_type = 'view' THEN 'bad' ELSE CAST(price AS VARCHAR) END AS price,
      CASE WHEN event_type = 'cart' THEN '  ' ELSE category_code END AS category_code FROM raw)""",
)
def _(spark, sf):
    mixed = tables.raw(spark, sf).select(
        F.col("brand").alias("event_hour"),
        F.when(F.col("event_type") == "view", "bad").otherwise(F.col("price").cast("string")).alias("price"),
        F.when(F.col("event_type") == "cart", "  ").otherwise(F.col("category_code")).alias("category_code"),
    )
    return clean_ops.coerce_with_default(
        mixed, {"event_hour": 12}, {"price": 1.5}, {"category_code": "none"}
    )


@query(
    "resolve_label",
    """SELECT user_id, CASE WHEN CAST(trunc(price) AS BIGINT) IN (0, 1) THEN CAST(trunc(price) AS BIGINT) END AS actual_label
    FROM raw""",
)
def _(spark, sf):
    rows = tables.raw(spark, sf).select("user_id", F.col("price").cast("string").alias("label"))
    return clean_ops.resolve_label(rows).select("user_id", "actual_label")


@query(
    "fill_defaults",
    f"""SELECT user_id, coalesce(CASE WHEN event_type = 'cart' THEN product_id END, 0) AS user_total_events,
    {rounded("coalesce(CASE WHEN event_type = 'cart' THEN price END, 1.0)", 'price_vs_user_avg')} FROM raw""",
)
def _(spark, sf):
    is_cart = F.col("event_type") == "cart"
    return clean_ops.fill_defaults(
        tables.raw(spark, sf).select(
            "user_id",
            F.when(is_cart, F.col("product_id")).alias("user_total_events"),
            F.when(is_cart, F.col("price")).alias("price_vs_user_avg"),
        )
    )


@query("drop_null_rows", f"SELECT {EVENT_COLUMNS_SQL} FROM raw WHERE brand IS NOT NULL AND category_code IS NOT NULL")
def _(spark, sf):
    return clean_ops.drop_null_rows(tables.raw(spark, sf))


@query("drop_duplicate_rows", f"SELECT DISTINCT {EVENT_COLUMNS_SQL} FROM raw")
def _(spark, sf):
    return clean_ops.drop_duplicate_rows(tables.raw(spark, sf))


@query(
    "dedup_feature_rows",
    """SELECT user_id, product_id, epoch_us(date_trunc('day', event_time)) AS event_timestamp,
    floor(min(price) * 1e6 + 500001e-6) / 1e6 AS price FROM clean WHERE event_type = 'cart' GROUP BY ALL""",
)
def _(spark, sf):
    daily = tables.clean(spark, sf).filter("event_type = 'cart'").select(
        "user_id", "product_id", F.date_trunc("day", "event_time").alias("event_timestamp"), "price"
    )
    return clean_ops.dedup_feature_rows(daily)


@query("drop_columns", "SELECT event_type, product_id, brand FROM raw")
def _(spark, sf):
    return clean_ops.drop_columns(
        tables.raw(spark, sf),
        "user_id", "user_session", "event_time", "category_id", "category_code", "price", "absent",
    )


@query("rename_columns", "SELECT user_id, brand, event_weekday, is_purchased FROM samples")
def _(spark, sf):
    shown = tables.samples(spark, sf).select(
        "user_id",
        F.col("brand").alias("Brand"),
        F.col("event_weekday").alias("Event Weekday"),
        F.col("is_purchased").alias("Is Purchased"),
    )
    return clean_ops.rename_columns(shown)


@query(
    "fill_missing_columns",
    f"""SELECT {micros('event_time')}, user_session, product_id, isodow(event_time) - 1 AS event_weekday,
    row_number() OVER (PARTITION BY user_session ORDER BY event_time, product_id, user_id) AS activity_count
    FROM clean""",
)
def _(spark, sf):
    df = tables.clean(spark, sf).select("event_time", "user_session", "product_id", "user_id")
    return clean_ops.fill_missing_columns(df).drop("user_id")


@query(
    "select_model_columns",
    "SELECT c AS \"column\", CASE WHEN c IN ('brand', 'category_code_level1', 'category_code_level2') THEN 'categorical' "
    "ELSE 'numeric' END AS kind, count(*) AS present FROM features, (SELECT unnest("
    + str(sorted(ALL_FEATURES))
    + ") AS c) GROUP BY 1, 2",
)
def _(spark, sf):
    """Each selected column with its kind and its rows that have a value."""
    features = tables.features(spark, sf)
    categorical, numeric = clean_ops.select_model_columns(features)
    kinds = [(c, "categorical") for c in categorical] + [(c, "numeric") for c in numeric]
    counts = features.agg(*[F.count(c).alias(c) for c, _ in kinds])
    long = counts.unpivot([], [c for c, _ in kinds], "column", "present")
    kind = F.when(F.col("column").isin(categorical), "categorical").otherwise("numeric")
    return long.select("column", kind.alias("kind"), "present")


@query(
    "check_contract",
    f"""SELECT row_id, CASE WHEN brand_purchase_rate BETWEEN 0 AND 1 THEN '' ELSE 'brand_purchase_rate' END AS violations
    FROM lite""",
)
def _(spark, sf):
    checked = clean_ops.check_contract(tables.lite_batch(spark, sf), LITE_FEATURES)
    return checked.select("row_id", F.concat_ws(",", "violations").alias("violations"))


@query(
    "detect_feature_set",
    "SELECT count(*) AS rows, 'full' AS features, 'lite' AS batch FROM features",
)
def _(spark, sf):
    full = clean_ops.detect_feature_set(tables.features(spark, sf))
    lite = clean_ops.detect_feature_set(tables.lite_batch(spark, sf))
    rows = tables.features(spark, sf).agg(F.count("*").alias("rows"))
    return rows.select("rows", F.lit(full).alias("features"), F.lit(lite).alias("batch"))


@query(
    "category_levels",
    """SELECT category_code, string_split(category_code, '.')[1] AS level1,
    coalesce(string_split(category_code, '.')[2], 'unknown') AS level2 FROM clean""",
)
def _(spark, sf):
    return tables.clean(spark, sf).select(
        "category_code", C.level1("category_code").alias("level1"), C.level2("category_code").alias("level2")
    )


@query(
    "category_levels_rest",
    """SELECT full_code, CASE WHEN trim(coalesce(full_code, '')) = '' THEN 'unknown'
      WHEN strpos(full_code, '.') = 0 THEN full_code ELSE substr(full_code, 1, strpos(full_code, '.') - 1) END AS level1,
    CASE WHEN strpos(coalesce(full_code, ''), '.') = 0 THEN 'unknown'
      ELSE substr(full_code, strpos(full_code, '.') + 1) END AS level2
    FROM (SELECT CASE WHEN event_type = 'cart' THEN category_code || '.' || event_type ELSE category_code END AS full_code
      FROM raw)""",
)
def _(spark, sf):
    code = F.when(
        F.col("event_type") == "cart", F.concat("category_code", F.lit("."), "event_type")
    ).otherwise(F.col("category_code"))
    return tables.raw(spark, sf).select(code.alias("full_code")).select(
        "full_code", C.level1_rest("full_code").alias("level1"), C.level2_rest("full_code").alias("level2")
    )


@query("event_weekday", f"SELECT {micros('event_time')}, isodow(event_time) - 1 AS event_weekday FROM raw")
def _(spark, sf):
    return tables.raw(spark, sf).select("event_time", C.weekday("event_time", 0).alias("event_weekday"))


@query("event_hour", f"SELECT {micros('event_time')}, hour(event_time) AS event_hour FROM raw")
def _(spark, sf):
    return tables.raw(spark, sf).select("event_time", C.hour("event_time", 12).alias("event_hour"))


@query(
    "guarded_rate",
    f"""SELECT p_partkey, {rounded('CASE WHEN p_size % 5 > 0 THEN p_retailprice / (p_size % 5) ELSE 0 END', 'rate')}
    FROM part""",
)
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", C.guarded_rate(F.col("p_retailprice"), F.col("p_size") % 5).alias("rate")
    )


@query(
    "clipped_rate",
    f"""SELECT p_partkey, {rounded('least((p_size % 7) / greatest(p_size % 5, 1)::DOUBLE, 1)', 'rate')} FROM part""",
)
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", C.clipped_rate(F.col("p_size") % 7, F.col("p_size") % 5).alias("rate")
    )


@query(
    "label_last_cart",
    f"SELECT user_id, product_id, user_session, {micros('purchase_time')}, {micros('cart_time')} FROM credits",
)
def _(spark, sf):
    return label_ops.label_last_cart(tables.clean(spark, sf)).drop("earlier_carts")


@query(
    "label_carts",
    f"SELECT user_id, product_id, user_session, {micros('event_time')}, is_purchased FROM labelled",
)
def _(spark, sf):
    events = tables.clean(spark, sf)
    carts = clean_ops.filter_event_type(events, "cart").select(*label_ops.JOURNEY, "event_time")
    return label_ops.label_carts(carts, label_ops.label_last_cart(events))


@query(
    "label_same_session",
    f"""SELECT c.user_id, c.product_id, c.user_session, {micros('c.event_time', 'event_time')},
    CASE WHEN EXISTS (SELECT 1 FROM raw b WHERE b.event_type = 'purchase' AND b.user_id = c.user_id
      AND b.product_id = c.product_id AND b.user_session = c.user_session) THEN 1 ELSE 0 END::BIGINT AS is_purchased
    FROM raw c WHERE c.event_type = 'cart'""",
)
def _(spark, sf):
    return label_ops.label_same_session(tables.raw(spark, sf)).select(
        *label_ops.JOURNEY, "event_time", "is_purchased"
    )


@query(
    "label_any_later",
    f"""SELECT c.user_id, c.product_id, {micros('c.event_time', 'event_time')},
    CASE WHEN EXISTS (SELECT 1 FROM clean b WHERE b.event_type = 'purchase' AND b.user_id = c.user_id
      AND b.product_id = c.product_id AND b.event_time > c.event_time) THEN 1 ELSE 0 END::BIGINT AS is_purchased
    FROM clean c WHERE c.event_type = 'cart'""",
)
def _(spark, sf):
    return label_ops.label_any_later(tables.clean(spark, sf)).select(
        "user_id", "product_id", "event_time", "is_purchased"
    )


@query(
    "rank_cart_per_purchase",
    f"""SELECT user_id, product_id, user_session, {micros('purchase_time')}, {micros('cart_time')},
    1::BIGINT AS cart_rank, ranked AS ranked_carts FROM credits""",
)
def _(spark, sf):
    return label_ops.rank_cart_per_purchase(tables.clean(spark, sf))


@query(
    "activity_count",
    f"""SELECT user_session, {micros('event_time')}, event_type, product_id, activity_count FROM counted""",
)
def _(spark, sf):
    return label_ops.activity_count(tables.clean(spark, sf)).select(
        "user_session", "event_time", "event_type", "product_id", "activity_count"
    )


@query(
    "session_cumcount",
    f"""SELECT user_session, {micros('event_time')},
    row_number() OVER (PARTITION BY user_session ORDER BY event_time, product_id, user_id) AS session_position
    FROM clean""",
)
def _(spark, sf):
    df = tables.clean(spark, sf).select("user_session", "event_time", "product_id", "user_id")
    return label_ops.session_cumcount(df).select("user_session", "event_time", "session_position")


@query(
    "session_cumcount_null_session",
    f""", s AS (SELECT CASE WHEN user_id % 3 <> 0 THEN user_session END AS user_session, event_time, product_id, user_id
    FROM clean) SELECT user_session, {micros('event_time')}, product_id, user_id,
    row_number() OVER (PARTITION BY user_session ORDER BY event_time, product_id, user_id) AS session_position FROM s""",
)
def _(spark, sf):
    session = F.when(F.col("user_id") % 3 != 0, F.col("user_session"))
    df = tables.clean(spark, sf).select(
        session.alias("user_session"), "event_time", "product_id", "user_id"
    )
    return label_ops.session_cumcount(df)


@query(
    "label_last_cart_null_keys",
    f""", e AS (SELECT CASE WHEN user_id % 3 <> 0 THEN user_id END AS user_id,
      CASE WHEN product_id % 4 <> 0 THEN product_id END AS product_id, user_session, event_type, event_time FROM clean),
    p AS (SELECT user_id, product_id, user_session, p.event_time AS purchase_time, max(c.event_time) AS cart_time
      FROM e p JOIN e c USING (user_id, product_id, user_session)
      WHERE p.event_type = 'purchase' AND c.event_type = 'cart' AND c.event_time < p.event_time GROUP BY ALL)
    SELECT user_id, product_id, user_session, {micros('purchase_time')}, {micros('cart_time')} FROM p""",
)
def _(spark, sf):
    user = F.when(F.col("user_id") % 3 != 0, F.col("user_id"))
    product = F.when(F.col("product_id") % 4 != 0, F.col("product_id"))
    events = tables.clean(spark, sf).withColumns({"user_id": user, "product_id": product})
    return label_ops.label_last_cart(events).drop("earlier_carts")


@query("cart_samples", f"SELECT {SAMPLE_SQL} FROM samples")
def _(spark, sf):
    return label_ops.cart_samples(tables.clean(spark, sf)).select(*SAMPLE_COLUMNS)


@query(
    "cart_purchase_latency",
    f"""SELECT c.user_session, c.product_id, {micros('c.event_time', 'cart_time')},
    {micros('b.event_time', 'purchase_time')},
    {rounded('(epoch_us(b.event_time) - epoch_us(c.event_time)) / 1e6', 'latency_seconds')},
    {rounded('(epoch_us(b.event_time) - epoch_us(c.event_time)) / 1e6 / 60', 'latency_minutes')}, count(*) AS pairs
    FROM raw c JOIN raw b ON c.user_session = b.user_session AND c.product_id = b.product_id
    WHERE c.event_type = 'cart' AND b.event_type = 'purchase'
      AND epoch_us(b.event_time) - epoch_us(c.event_time) BETWEEN 0 AND 86400000000
    GROUP BY c.user_session, c.product_id, c.event_time, b.event_time""",
)
def _(spark, sf):
    # A day rather than the default hour, as the given events are hours apart.
    return label_ops.cart_purchase_latency(tables.raw(spark, sf), limit_seconds=86_400)


@query("sort_events", f"SELECT {EVENT_COLUMNS_SQL} FROM clean")
def _(spark, sf):
    # Rows are a set; the order only matters inside the files a writer produces.
    return clean_ops.sort_events(tables.clean(spark, sf))


@query(
    "publish_features_v1",
    f"""SELECT user_id, product_id, {micros('event_time', 'event_timestamp')},
    epoch_us(TIMESTAMP '2024-02-01') AS created_timestamp, category_code_level1, category_code_level2, brand,
    event_weekday, {rounded('price', 'price')}, activity_count, is_purchased FROM samples""",
)
def _(spark, sf):
    shown = tables.samples(spark, sf).withColumnRenamed("brand", "Brand")
    return store_ops.publish_features_v1(shown, tables.CREATED_AT)
