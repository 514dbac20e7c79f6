"""Queries: aggregates, feature joins and tables, windows, sets, lookups, splits, encoders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import clean as clean_ops
from ..operators import eda
from ..operators import encode
from ..operators import features as ops
from ..operators import labels as label_ops
from ..operators import profile
from ..operators import score as score_ops
from ..operators import split
from ..operators import store
from ..schemas import (
    ALL_FEATURES,
    CATEGORICAL_FEATURES,
    FEATURE_TABLE_COLUMNS,
)
from ..session import staging_path
from ..sources import writers
from . import tables
from .prelude import micros, rounded
from .registry import query
from .testbed import table

DOUBLES = {
    "price", "user_view_to_cart_rate", "user_cart_to_purchase_rate", "user_avg_purchase_price",
    "product_view_to_cart_rate", "product_cart_to_purchase_rate", "brand_purchase_rate",
    "price_vs_user_avg", "price_vs_category_avg", "brand_avg_price", "category_avg_price",
}
TIMES = {"event_timestamp", "created_timestamp", "event_time"}
KEYS = ["user_id", "product_id", "event_timestamp"]
HASH = (
    "CAST('0x' || substr(md5(concat_ws(':', user_id, product_id, "
    "strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f'), '42')), 1, 8) AS BIGINT)"
)


def listed(columns) -> str:
    """Select list of named columns in presented form."""
    out = []
    for c in columns:
        if c in DOUBLES:
            out.append(rounded(c, c))
        elif c in TIMES:
            out.append(micros(c))
        else:
            out.append(c)
    return ", ".join(out)


def keyed(df):
    """Feature rows with the time key as microsecond text, whose text form all engines share."""
    return df.withColumn(
        "event_timestamp", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def feature_rows(spark, sf):
    return keyed(tables.features(spark, sf))


USER = [c for c in FEATURE_TABLE_COLUMNS if c.startswith("user_")]
PRODUCT = [c for c in FEATURE_TABLE_COLUMNS if c.startswith("product_")]


@query("agg_user", f"SELECT {listed(USER)} FROM agg_user")
def _(spark, sf):
    return ops.agg_user(tables.raw(spark, sf)).select(*USER)


@query("agg_product", f"SELECT {listed(PRODUCT)} FROM agg_product")
def _(spark, sf):
    return ops.agg_product(tables.raw(spark, sf)).select(*PRODUCT)


@query(
    "agg_brand",
    f"SELECT {listed(['brand_clean', 'brand_total_purchases', 'brand_total_carts', 'brand_avg_price', 'brand_purchase_rate'])} FROM agg_brand",
)
def _(spark, sf):
    return ops.agg_brand(tables.raw(spark, sf))


@query(
    "agg_category",
    f"SELECT {listed(['category_level1', 'category_avg_price', 'category_total_purchases'])} FROM agg_category",
)
def _(spark, sf):
    return ops.agg_category(tables.raw(spark, sf))


SAMPLE_KEYS = ["event_time", "user_id", "product_id"]


@query(
    "join_user_features",
    f"""SELECT {micros('s.event_time', 'event_time')}, s.user_id, s.product_id, user_total_events,
    {rounded('user_view_to_cart_rate', 'user_view_to_cart_rate')}
    FROM samples s LEFT JOIN agg_user u ON s.user_id = u.user_id""",
)
def _(spark, sf):
    user = ops.agg_user(tables.raw(spark, sf))
    return ops.join_user_features(tables.samples(spark, sf), user).select(
        *SAMPLE_KEYS, "user_total_events", "user_view_to_cart_rate"
    )


@query(
    "join_product_features",
    f"""SELECT {micros('s.event_time', 'event_time')}, s.user_id, s.product_id, product_total_events, product_unique_buyers
    FROM samples s LEFT JOIN agg_product p ON s.product_id = p.product_id""",
)
def _(spark, sf):
    product = ops.agg_product(tables.raw(spark, sf))
    return ops.join_product_features(tables.samples(spark, sf), product).select(
        *SAMPLE_KEYS, "product_total_events", "product_unique_buyers"
    )


@query(
    "join_brand_features",
    f"""SELECT {micros('event_time')}, user_id, product_id, brand, {listed(['brand_purchase_rate', 'brand_avg_price'])}
    FROM samples s LEFT JOIN agg_brand b ON s.brand = b.brand_clean""",
)
def _(spark, sf):
    brand = ops.agg_brand(tables.raw(spark, sf))
    return ops.join_brand_features(tables.samples(spark, sf), brand).select(
        *SAMPLE_KEYS, "brand", "brand_purchase_rate", "brand_avg_price"
    )


@query(
    "join_category_features",
    f"""SELECT {micros('event_time')}, user_id, product_id, category_code_level1, {listed(['category_avg_price'])}
    FROM samples s LEFT JOIN agg_category c ON s.category_code_level1 = c.category_level1""",
)
def _(spark, sf):
    category = ops.agg_category(tables.raw(spark, sf))
    return ops.join_category_features(tables.samples(spark, sf), category).select(
        *SAMPLE_KEYS, "category_code_level1", "category_avg_price"
    )


@query("price_vs_user_avg", f"SELECT {listed([*KEYS, 'price_vs_user_avg'])} FROM features")
def _(spark, sf):
    rows = tables.features(spark, sf).withColumn("price_vs_user_avg", ops.price_vs_user_avg())
    return rows.select(*KEYS, "price_vs_user_avg")


@query("price_vs_category_avg", f"SELECT {listed([*KEYS, 'price_vs_category_avg'])} FROM features")
def _(spark, sf):
    joined = ops.join_category_features(
        tables.features(spark, sf), ops.agg_category(tables.raw(spark, sf))
    )
    out = joined.withColumn("price_vs_category_avg", ops.price_vs_category_avg())
    return out.select(*KEYS, "price_vs_category_avg")


@query("assemble_features_v2", f"SELECT {listed(FEATURE_TABLE_COLUMNS)} FROM features")
def _(spark, sf):
    return ops.assemble_features_v2(
        tables.samples(spark, sf), tables.raw(spark, sf), tables.CREATED_AT
    )


@query("final_feature_select", f"SELECT {listed(FEATURE_TABLE_COLUMNS)} FROM features")
def _(spark, sf):
    mixed = tables.features(spark, sf)
    return ops.final_feature_select(mixed.select(*reversed(mixed.columns), F.lit(1).alias("spare")))


CLIPPED = """, ex AS (
  SELECT event_time, event_type, product_id, price, user_id, user_session,
    coalesce(trim(lower(brand)), 'unknown') AS brand,
    CASE WHEN category_code IS NULL THEN 'unknown' ELSE string_split(category_code, '.')[1] END AS category_code_level1,
    CASE WHEN strpos(coalesce(category_code, ''), '.') = 0 THEN 'unknown'
      ELSE substr(category_code, strpos(category_code, '.') + 1) END AS category_code_level2,
    isodow(event_time) - 1 AS event_weekday, hour(event_time) AS event_hour
  FROM raw
), cu AS (
  SELECT user_id, count(*) AS user_total_events,
    count(*) FILTER (event_type = 'view') AS user_total_views,
    count(*) FILTER (event_type = 'cart') AS user_total_carts,
    count(*) FILTER (event_type = 'purchase') AS user_total_purchases,
    count(DISTINCT product_id) AS user_unique_products,
    count(DISTINCT category_code_level1) AS user_unique_categories,
    avg(price) FILTER (event_type = 'purchase') AS user_avg_purchase_price,
    least(count(*) FILTER (event_type = 'cart') / greatest(count(*) FILTER (event_type = 'view'), 1)::DOUBLE, 1e0) AS user_view_to_cart_rate,
    least(count(*) FILTER (event_type = 'purchase') / greatest(count(*) FILTER (event_type = 'cart'), 1)::DOUBLE, 1e0) AS user_cart_to_purchase_rate
  FROM ex GROUP BY user_id
), cp AS (
  SELECT product_id, count(*) AS product_total_events,
    count(*) FILTER (event_type = 'view') AS product_total_views,
    count(*) FILTER (event_type = 'cart') AS product_total_carts,
    count(*) FILTER (event_type = 'purchase') AS product_total_purchases,
    count(DISTINCT user_id) AS product_unique_buyers,
    least(count(*) FILTER (event_type = 'cart') / greatest(count(*) FILTER (event_type = 'view'), 1)::DOUBLE, 1e0) AS product_view_to_cart_rate,
    least(count(*) FILTER (event_type = 'purchase') / greatest(count(*) FILTER (event_type = 'cart'), 1)::DOUBLE, 1e0) AS product_cart_to_purchase_rate
  FROM ex GROUP BY product_id
), cb AS (
  SELECT brand, count(*) FILTER (event_type = 'purchase') AS brand_purchases,
    count(*) FILTER (event_type = 'cart') AS brand_carts,
    least(count(*) FILTER (event_type = 'purchase') / greatest(count(*) FILTER (event_type = 'cart'), 1)::DOUBLE, 1e0) AS brand_purchase_rate
  FROM ex GROUP BY brand
), clipped AS (
  SELECT x.user_id, x.product_id, x.user_session, x.event_time, coalesce(x.price, 0) AS price,
    product_total_events AS activity_count, event_weekday, event_hour, user_total_events, user_total_views,
    user_total_carts, user_total_purchases, user_view_to_cart_rate, user_cart_to_purchase_rate,
    coalesce(user_avg_purchase_price, 0e0) AS user_avg_purchase_price, user_unique_products, user_unique_categories,
    product_total_events, product_total_views, product_total_carts, product_total_purchases,
    product_view_to_cart_rate, product_cart_to_purchase_rate, product_unique_buyers, brand_purchase_rate,
    coalesce(x.price / CASE WHEN user_avg_purchase_price < 1e-2 THEN 1e-2 ELSE user_avg_purchase_price END, 0e0) AS price_vs_user_avg,
    1e0 AS price_vs_category_avg, x.brand, category_code_level1, category_code_level2,
    CASE WHEN EXISTS (SELECT 1 FROM ex b WHERE b.event_type = 'purchase' AND b.user_id = x.user_id
      AND b.product_id = x.product_id AND b.user_session = x.user_session) THEN 1 ELSE 0 END::BIGINT AS is_purchased
  FROM ex x LEFT JOIN cu ON x.user_id = cu.user_id LEFT JOIN cp ON x.product_id = cp.product_id
    LEFT JOIN cb ON x.brand = cb.brand
  WHERE x.event_type = 'cart'
)
"""


@query(
    "assemble_features_clipped",
    CLIPPED
    + f"SELECT {listed(['user_id', 'product_id', 'user_session', 'event_time', *ALL_FEATURES, 'is_purchased'])} FROM clipped",
)
def _(spark, sf):
    return ops.assemble_features_clipped(tables.raw(spark, sf))


@query("agg_user_clipped", CLIPPED + f"SELECT {listed(USER)} FROM cu")
def _(spark, sf):
    return ops.agg_user_clipped(ops.export_events(tables.raw(spark, sf)))


@query("agg_product_clipped", CLIPPED + f"SELECT {listed(PRODUCT)} FROM cp")
def _(spark, sf):
    return ops.agg_product_clipped(ops.export_events(tables.raw(spark, sf)))


@query("agg_brand_clipped", CLIPPED + f"SELECT {listed(['brand', 'brand_purchases', 'brand_carts', 'brand_purchase_rate'])} FROM cb")
def _(spark, sf):
    return ops.agg_brand_clipped(ops.export_events(tables.raw(spark, sf)))


AS_OF_SQL = """, at_user AS (
  SELECT s.user_id, s.event_time, count(r.event_time) AS user_total_events,
    count(*) FILTER (r.event_type = 'view') AS user_total_views,
    count(*) FILTER (r.event_type = 'cart') AS user_total_carts,
    count(*) FILTER (r.event_type = 'purchase') AS user_total_purchases,
    coalesce(avg(r.price) FILTER (r.event_type = 'purchase'), 0e0) AS user_avg_purchase_price,
    count(DISTINCT r.product_id) AS user_unique_products,
    count(DISTINCT CASE WHEN r.event_time IS NOT NULL THEN lower(coalesce(string_split(r.category_code, '.')[1], 'unknown')) END) AS user_unique_categories
  FROM (SELECT DISTINCT user_id, event_time FROM samples) s
    LEFT JOIN raw r ON r.user_id = s.user_id AND r.event_time < s.event_time GROUP BY ALL
), at_product AS (
  SELECT s.product_id, s.event_time, count(r.event_time) AS product_total_events,
    count(*) FILTER (r.event_type = 'view') AS product_total_views,
    count(*) FILTER (r.event_type = 'cart') AS product_total_carts,
    count(*) FILTER (r.event_type = 'purchase') AS product_total_purchases,
    count(DISTINCT r.user_id) FILTER (r.event_type = 'purchase') AS product_unique_buyers
  FROM (SELECT DISTINCT product_id, event_time FROM samples) s
    LEFT JOIN raw r ON r.product_id = s.product_id AND r.event_time < s.event_time GROUP BY ALL
), at_brand AS (
  SELECT s.brand, s.event_time, count(*) FILTER (r.event_type = 'cart') AS carts,
    count(*) FILTER (r.event_type = 'purchase') AS purchases
  FROM (SELECT DISTINCT brand, event_time FROM samples) s
    LEFT JOIN raw r ON coalesce(lower(r.brand), 'unknown') = s.brand AND r.event_time < s.event_time GROUP BY ALL
), at_category AS (
  SELECT s.category_code_level1, s.event_time, avg(r.price) AS price
  FROM (SELECT DISTINCT category_code_level1, event_time FROM samples) s
    LEFT JOIN raw r ON string_split(coalesce(lower(r.category_code), 'unknown'), '.')[1] = s.category_code_level1
      AND r.event_time < s.event_time GROUP BY ALL
), as_of AS (
  SELECT s.*, u.* EXCLUDE (user_id, event_time), p.* EXCLUDE (product_id, event_time),
    CASE WHEN user_total_views > 0 THEN user_total_carts / user_total_views::DOUBLE ELSE 0e0 END AS user_view_to_cart_rate,
    CASE WHEN user_total_carts > 0 THEN user_total_purchases / user_total_carts::DOUBLE ELSE 0e0 END AS user_cart_to_purchase_rate,
    CASE WHEN product_total_views > 0 THEN product_total_carts / product_total_views::DOUBLE ELSE 0e0 END AS product_view_to_cart_rate,
    CASE WHEN product_total_carts > 0 THEN product_total_purchases / product_total_carts::DOUBLE ELSE 0e0 END AS product_cart_to_purchase_rate,
    CASE WHEN b.carts > 0 THEN b.purchases / b.carts::DOUBLE ELSE 0e0 END AS brand_purchase_rate,
    CASE WHEN user_avg_purchase_price > 0 THEN s.price / user_avg_purchase_price ELSE 1e0 END AS price_vs_user_avg,
    CASE WHEN c.price > 0 THEN s.price / c.price ELSE 1e0 END AS price_vs_category_avg,
    CAST(hour(s.event_time) AS BIGINT) AS event_hour
  FROM samples s JOIN at_user u ON u.user_id = s.user_id AND u.event_time = s.event_time
    JOIN at_product p ON p.product_id = s.product_id AND p.event_time = s.event_time
    JOIN at_brand b ON b.brand = s.brand AND b.event_time = s.event_time
    JOIN at_category c ON c.category_code_level1 = s.category_code_level1 AND c.event_time = s.event_time
)
"""


@query(
    "assemble_as_of",
    AS_OF_SQL + f"SELECT {listed([*SAMPLE_KEYS, *ALL_FEATURES, 'is_purchased'])} FROM as_of",
)
def _(spark, sf):
    return ops.assemble_as_of(tables.samples(spark, sf), tables.raw(spark, sf)).select(
        *SAMPLE_KEYS, *ALL_FEATURES, "is_purchased"
    )


USER_LOOKUP = ["user_id", "event_hour", "event_weekday", *[c for c in USER if c != "user_id"]]
PRODUCT_FIRST = [c for c in PRODUCT if c != "product_id"] + [
    "brand_purchase_rate", "price_vs_user_avg", "price_vs_category_avg",
]


def _first(c: str, key: str, tie: str) -> str:
    return f"first({c} ORDER BY event_timestamp, {tie}) AS {c}"


USER_LOOKUP_SQL = f""", ul AS (
  SELECT user_id, {', '.join(_first(c, 'user_id', 'product_id') for c in USER_LOOKUP[1:])}
  FROM features GROUP BY user_id
)"""


def _mode(c: str) -> str:
    return (
        f"coalesce((SELECT x.{c} FROM features x WHERE x.product_id = f.product_id AND x.{c} IS NOT NULL "
        f"GROUP BY x.{c} ORDER BY count(*) DESC, x.{c} LIMIT 1), 'unknown') AS {c}"
    )


PRODUCT_LOOKUP_SQL = f""", pl AS (
  SELECT f.product_id, avg(price) AS price, avg(activity_count) AS activity_count,
    {', '.join(_first(c, 'product_id', 'user_id') for c in PRODUCT_FIRST)},
    {', '.join(_mode(c) for c in CATEGORICAL_FEATURES)}
  FROM features f GROUP BY f.product_id
)"""
PRODUCT_LOOKUP_LIST = (
    f"product_id, {rounded('activity_count', 'activity_count')}, "
    + listed(["price", *PRODUCT_FIRST, *CATEGORICAL_FEATURES])
)


@query("agg_user_lookup", USER_LOOKUP_SQL + f" SELECT {listed(USER_LOOKUP)} FROM ul")
def _(spark, sf):
    return ops.agg_user_lookup(tables.features(spark, sf))


@query("agg_product_lookup", PRODUCT_LOOKUP_SQL + f" SELECT {PRODUCT_LOOKUP_LIST} FROM pl")
def _(spark, sf):
    return ops.agg_product_lookup(tables.features(spark, sf))


@query(
    "build_lookup_tables",
    USER_LOOKUP_SQL + PRODUCT_LOOKUP_SQL
    + """ SELECT 'user' AS side, user_id AS id, user_total_events AS events FROM ul
    UNION ALL SELECT 'product', product_id, product_total_events FROM pl""",
)
def _(spark, sf):
    users, products = store.build_lookup_tables(tables.features(spark, sf))
    paths = [staging_path(spark, "lookup") for _ in range(2)]
    writers.write_parquet(users, paths[0])
    writers.write_parquet(products, paths[1])
    left = spark.read.parquet(paths[0]).select(
        F.lit("user").alias("side"), F.col("user_id").alias("id"), F.col("user_total_events").alias("events")
    )
    right = spark.read.parquet(paths[1]).select(
        F.lit("product").alias("side"), F.col("product_id").alias("id"), F.col("product_total_events").alias("events")
    )
    return split.union_parts(left, right)


def _pairs(spark, sf):
    """Text entity pairs from customers and parts, many of them unknown to the feature table."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("user_id"),
        (F.col("o_orderkey") % 20).cast("string").alias("product_id"),
    )
    return orders.distinct()


PAIRS_SQL = """, pairs AS (
  SELECT DISTINCT ' ' || o_custkey AS user_id, CAST(o_orderkey % 20 AS VARCHAR) AS product_id FROM orders
)"""
FOUND_SQL = (
    USER_LOOKUP_SQL + PRODUCT_LOOKUP_SQL + PAIRS_SQL + """, found AS (
  SELECT p.user_id, p.product_id, ul.user_id IS NOT NULL AS has_user, pl.product_id IS NOT NULL AS has_product,
    coalesce(event_weekday, 0) AS event_weekday, coalesce(event_hour, 12) AS event_hour,
    """
    + ", ".join(
        f"coalesce({c}, 0) AS {c}"
        for c in ALL_FEATURES
        if c not in ("event_weekday", "event_hour", *CATEGORICAL_FEATURES)
    )
    + ", " + ", ".join(f"coalesce({c}, 'unknown') AS {c}" for c in CATEGORICAL_FEATURES)
    + """ FROM pairs p LEFT JOIN ul ON try_cast(trim(p.user_id) AS BIGINT) = ul.user_id
    LEFT JOIN pl ON try_cast(trim(p.product_id) AS BIGINT) = pl.product_id
)"""
)


@query(
    "lookup_features",
    FOUND_SQL
    + f""" SELECT user_id, product_id, {rounded('activity_count', 'activity_count')},
    {listed([c for c in ALL_FEATURES if c != 'activity_count'])} FROM found WHERE has_user OR has_product""",
)
def _(spark, sf):
    users, products = tables.lookup_tables(spark, sf)
    return store.lookup_features(_pairs(spark, sf), users, products)[0]


@query(
    "lookup_not_found",
    FOUND_SQL + " SELECT user_id, product_id FROM found WHERE NOT (has_user OR has_product)",
)
def _(spark, sf):
    users, products = tables.lookup_tables(spark, sf)
    return store.lookup_features(_pairs(spark, sf), users, products)[1]


@query(
    "score_lookup_pairs",
    FOUND_SQL
    + f""" SELECT user_id, product_id, CAST(printf('%.4f', 35e-2 * user_cart_to_purchase_rate + 25e-2 * brand_purchase_rate
      + 2e-1 * product_cart_to_purchase_rate + 1e-1 * least(1e0, activity_count / 2e1) + 5e-2 * user_view_to_cart_rate
      + 5e-2 * greatest(0e0, 1e0 - greatest(0e0, price_vs_user_avg - 1e0))) AS DOUBLE) AS probability,
    1e2 AS quality, 'A' AS grade FROM found WHERE has_user OR has_product""",
)
def _(spark, sf):
    users, products = tables.lookup_tables(spark, sf)
    scored, _missing = score_ops.score_lookup_pairs(_pairs(spark, sf), users, products)
    return scored.select(
        "user_id", "product_id", "probability",
        F.col("feature_quality.score").alias("quality"),
        F.col("feature_quality.grade").alias("grade"),
    )


@query("publish_features_v2", f"SELECT {listed(FEATURE_TABLE_COLUMNS)} FROM features")
def _(spark, sf):
    text = tables.features(spark, sf).withColumns(
        {c: F.col(c).cast("string") for c in ("user_id", "product_id", "price", "activity_count")}
    )
    return store.publish_features_v2(text, tables.CREATED_AT)


LATEST_SQL = """, latest AS (
  SELECT * FROM features QUALIFY row_number() OVER (
    PARTITION BY user_id, product_id ORDER BY event_timestamp DESC) = 1
)"""


@query("materialize_latest", LATEST_SQL + f" SELECT {listed(FEATURE_TABLE_COLUMNS)} FROM latest")
def _(spark, sf):
    return store.materialize_latest(tables.features(spark, sf))


@query("latest_per_key", f"""SELECT user_id, {micros('max(event_time)', 'event_time')} FROM samples GROUP BY user_id""")
def _(spark, sf):
    rows = tables.samples(spark, sf).select("user_id", "event_time", "price")
    return store.latest_per_key(rows, ["user_id"], ["event_time"]).drop("price")


ONLINE = ["price", "activity_count", "user_total_events", "brand", "is_purchased"]


@query(
    "get_online_features",
    LATEST_SQL
    + f""" SELECT p.user_id, p.product_id, {listed(ONLINE)}
    FROM (SELECT DISTINCT o_custkey AS user_id, o_orderkey % 20 AS product_id FROM orders) p
    LEFT JOIN latest l ON p.user_id = l.user_id AND p.product_id = l.product_id""",
)
def _(spark, sf):
    pairs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 20).alias("product_id")
    )
    latest = tables.latest(spark, sf)
    online = store.get_online_features(pairs.distinct(), latest)
    return online.select("user_id", "product_id", *ONLINE)


@query(
    "lookup_features_batch",
    LATEST_SQL
    + f""" SELECT try_cast(trim(p.user_id) AS BIGINT) AS user_id, try_cast(trim(p.product_id) AS BIGINT) AS product_id,
    {listed(ONLINE)} FROM (SELECT DISTINCT ' ' || o_custkey AS user_id, CAST(o_orderkey % 20 AS VARCHAR) AS product_id FROM orders) p
    LEFT JOIN latest l ON try_cast(trim(p.user_id) AS BIGINT) = l.user_id AND try_cast(trim(p.product_id) AS BIGINT) = l.product_id""",
)
def _(spark, sf):
    latest = tables.latest(spark, sf)
    batch = store.lookup_features_batch(_pairs(spark, sf), latest)
    return batch.select("user_id", "product_id", *ONLINE)


@query(
    "ttl_filter",
    f"SELECT {listed(KEYS)} FROM features WHERE event_timestamp >= TIMESTAMP '2034-01-12' - INTERVAL 3650 DAY",
)
def _(spark, sf):
    return store.ttl_filter(tables.features(spark, sf), dt.datetime(2034, 1, 12)).select(*KEYS)


@query(
    "cumulative_share",
    f""", counts AS (SELECT brand, count(*) AS n FROM clean GROUP BY brand)
    SELECT brand, row_number() OVER (ORDER BY n DESC, brand) AS rank, n AS rows,
    {rounded('(sum(n) OVER (ORDER BY n DESC, brand ROWS UNBOUNDED PRECEDING))::DOUBLE / (SELECT sum(n) FROM counts)::DOUBLE * 100', 'cumulative_pct')}
    FROM counts""",
)
def _(spark, sf):
    return eda.cumulative_share(tables.clean(spark, sf))


@query(
    "long_tail",
    """, counts AS (SELECT user_id, count(*) AS n FROM clean GROUP BY user_id),
    shares AS (SELECT (sum(n) OVER (ORDER BY n DESC, user_id ROWS UNBOUNDED PRECEDING))::DOUBLE
      / (SELECT sum(n) FROM counts)::DOUBLE * 100 AS pct FROM counts)
    SELECT count(*) FILTER (pct <= 80) AS n_80, count(*) FILTER (pct <= 95) AS n_95, count(*) AS n_values FROM shares""",
)
def _(spark, sf):
    return eda.long_tail(tables.clean(spark, sf), "user_id")


@query(
    "semi_topk",
    f"""SELECT {listed(SAMPLE_KEYS)}, category_code_level2 FROM samples WHERE category_code_level2 IN (
    SELECT category_code_level2 FROM samples GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)""",
)
def _(spark, sf):
    top = eda.semi_topk(tables.samples(spark, sf), "category_code_level2", 3)
    return top.select(*SAMPLE_KEYS, "category_code_level2")


@query(
    "top_k",
    f"""SELECT brand_clean, brand_total_carts, {rounded('brand_avg_price', 'brand_avg_price')} FROM agg_brand
    ORDER BY brand_total_carts DESC, brand_clean LIMIT 3""",
)
def _(spark, sf):
    brands = ops.agg_brand(tables.raw(spark, sf))
    return profile.top_k(brands, "brand_total_carts", 3, ["brand_clean"]).select(
        "brand_clean", "brand_total_carts", "brand_avg_price"
    )


# Splits and samples -------------------------------------------------------------------------

SPLIT_SQL = f""", hashed AS (
  SELECT user_id, product_id, strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS event_timestamp,
    brand, category_code_level1, category_code_level2, is_purchased, {HASH} AS h FROM features
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY is_purchased ORDER BY h, user_id, product_id, event_timestamp) AS r,
    count(*) OVER (PARTITION BY is_purchased) AS n FROM hashed
)"""
SPLIT_COLUMNS = ["user_id", "product_id", "event_timestamp", "is_purchased"]


@query(
    "split_stratified",
    SPLIT_SQL
    + f""" SELECT {', '.join(SPLIT_COLUMNS)}, CASE WHEN r <= floor(n * 2e-1 + 5e-1) THEN 'test' ELSE 'train' END AS part
    FROM ranked""",
)
def _(spark, sf):
    rows = feature_rows(spark, sf).select(*SPLIT_COLUMNS)
    return split.split_stratified(rows, KEYS, "is_purchased")


@query(
    "split_threshold",
    SPLIT_SQL
    + f" SELECT {', '.join(SPLIT_COLUMNS)}, CASE WHEN h < {int(0.2 * 2**32)} THEN 'test' ELSE 'train' END AS part FROM hashed",
)
def _(spark, sf):
    return split.split_threshold(feature_rows(spark, sf).select(*SPLIT_COLUMNS), KEYS)


@query(
    "split_three_way",
    SPLIT_SQL
    + f""" SELECT {', '.join(SPLIT_COLUMNS)}, CASE WHEN r <= floor(n * 2e-1 + 5e-1) THEN 'test'
    WHEN r <= floor(n * 36e-2 + 5e-1) THEN 'val' ELSE 'train' END AS part FROM ranked""",
)
def _(spark, sf):
    rows = feature_rows(spark, sf).select(*SPLIT_COLUMNS)
    return split.split_three_way(rows, KEYS, "is_purchased")


COVERAGE_SQL = SPLIT_SQL + """, reserved AS (
  SELECT DISTINCT user_id, product_id, event_timestamp FROM (
    SELECT user_id, product_id, event_timestamp,
      row_number() OVER (PARTITION BY brand ORDER BY user_id, product_id, event_timestamp) AS b,
      row_number() OVER (PARTITION BY category_code_level1 ORDER BY user_id, product_id, event_timestamp) AS c1,
      row_number() OVER (PARTITION BY category_code_level2 ORDER BY user_id, product_id, event_timestamp) AS c2
    FROM hashed) WHERE b = 1 OR c1 = 1 OR c2 = 1
), remaining AS (
  SELECT h.*, row_number() OVER (PARTITION BY is_purchased ORDER BY h, user_id, product_id, event_timestamp) AS r,
    count(*) OVER (PARTITION BY is_purchased) AS n, count(*) OVER () AS n_all
  FROM hashed h ANTI JOIN reserved USING (user_id, product_id, event_timestamp)
), covered AS (
  SELECT user_id, product_id, event_timestamp, is_purchased, brand, category_code_level1, category_code_level2,
    CASE WHEN r <= floor(n * least(floor((SELECT count(*) FROM hashed) * 2e-1) / n_all, 5e-1) + 5e-1)
      THEN 'test' ELSE 'train' END AS part FROM remaining
  UNION ALL
  SELECT user_id, product_id, event_timestamp, is_purchased, brand, category_code_level1, category_code_level2, 'train'
  FROM hashed SEMI JOIN reserved USING (user_id, product_id, event_timestamp)
)"""


def _covered(spark, sf):
    rows = feature_rows(spark, sf).select(*SPLIT_COLUMNS, *CATEGORICAL_FEATURES)
    return split.split_with_coverage(rows, CATEGORICAL_FEATURES, "is_purchased", KEYS)


@query("split_with_coverage", COVERAGE_SQL + f" SELECT {', '.join(SPLIT_COLUMNS)}, part FROM covered")
def _(spark, sf):
    return _covered(spark, sf).select(*SPLIT_COLUMNS, "part")


@query(
    "anti_reserved",
    COVERAGE_SQL + f" SELECT {', '.join(SPLIT_COLUMNS)} FROM remaining",
)
def _(spark, sf):
    rows = feature_rows(spark, sf)
    reserved = split.reserved_rows(rows, CATEGORICAL_FEATURES, KEYS)
    return split.anti_reserved(rows, reserved, KEYS).select(*SPLIT_COLUMNS)


@query(
    "union_parts",
    f"""SELECT user_id, product_id, event_type, {rounded('price', 'price')} FROM clean WHERE event_type = 'cart'
    UNION ALL SELECT user_id, product_id, event_type, {rounded('price', 'price')} FROM clean WHERE event_type = 'purchase'""",
)
def _(spark, sf):
    rows = tables.clean(spark, sf).select("user_id", "product_id", "event_type", "price")
    return split.union_parts(
        clean_ops.filter_event_type(rows, "cart"), clean_ops.filter_event_type(rows, "purchase")
    )


@query(
    "validate_split",
    COVERAGE_SQL
    + "".join(
        f"""{' UNION ALL' if i else ''} SELECT '{c}' AS column,
        (SELECT count(*) FROM (SELECT {c} FROM covered WHERE part = 'test' EXCEPT SELECT {c} FROM covered WHERE part = 'train')) AS unseen,
        (SELECT count(*) FROM (SELECT {c} FROM covered WHERE part = 'test' EXCEPT SELECT {c} FROM covered WHERE part = 'train')) = 0 AS valid"""
        for i, c in enumerate(CATEGORICAL_FEATURES)
    ),
)
def _(spark, sf):
    return split.validate_split(_covered(spark, sf), CATEGORICAL_FEATURES)


@query(
    "class_shares",
    COVERAGE_SQL
    + f""" SELECT part, is_purchased, count(*) AS rows,
    {rounded('count(*) / (sum(count(*)) OVER (PARTITION BY part))::DOUBLE', 'share')} FROM covered GROUP BY part, is_purchased""",
)
def _(spark, sf):
    return split.class_shares(_covered(spark, sf), "is_purchased")


@query(
    "unseen_values",
    """SELECT 'user_id' AS "column", CAST(user_id AS VARCHAR) AS value FROM (
    SELECT user_id FROM clean WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM labelled WHERE is_purchased = 1)
    UNION ALL SELECT 'user_session', user_session FROM (SELECT user_session FROM clean WHERE event_type = 'purchase'
    EXCEPT SELECT user_session FROM labelled WHERE is_purchased = 1)""",
)
def _(spark, sf):
    events = tables.clean(spark, sf)
    credited = label_ops.label_last_cart(events)
    bought = clean_ops.filter_event_type(events, "purchase")
    return split.unseen_values(credited, bought, ["user_id", "user_session"])


@query(
    "stratified_folds",
    SPLIT_SQL + f" SELECT {', '.join(SPLIT_COLUMNS)}, (r - 1) % 5 AS fold FROM ranked",
)
def _(spark, sf):
    rows = feature_rows(spark, sf).select(*SPLIT_COLUMNS)
    return split.stratified_folds(rows, KEYS, "is_purchased")


@query(
    "sample_n",
    SPLIT_SQL
    + f" SELECT {', '.join(SPLIT_COLUMNS)} FROM hashed ORDER BY h, user_id, product_id, event_timestamp LIMIT 300",
)
def _(spark, sf):
    return split.sample_n(feature_rows(spark, sf).select(*SPLIT_COLUMNS), KEYS, 300)


@query(
    "subsample_stratified",
    SPLIT_SQL
    + f""" SELECT {', '.join(SPLIT_COLUMNS)} FROM ranked
    WHERE r <= floor(n * least(1e0, 5e2 / (SELECT count(*) FROM hashed)) + 5e-1)""",
)
def _(spark, sf):
    rows = feature_rows(spark, sf).select(*SPLIT_COLUMNS)
    return split.subsample_stratified(rows, KEYS, "is_purchased", cap=500)


# Encoders -----------------------------------------------------------------------------------

ENCODER_SQL = ", overall AS (SELECT avg(is_purchased) AS m FROM features), enc AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS category,
    (sum(is_purchased)::DOUBLE + 20 * (SELECT m FROM overall)) / (count(*) + 20) AS value,
    (SELECT m FROM overall) AS global_mean FROM features GROUP BY {c}"""
    for c in CATEGORICAL_FEATURES
) + ")"


@query(
    "fit_target_encoder",
    ENCODER_SQL + f' SELECT "column", category, {rounded("value", "value")}, {rounded("global_mean", "global_mean")} FROM enc',
)
def _(spark, sf):
    return encode.fit_target_encoder(tables.features(spark, sf))


@query(
    "write_encoders",
    ENCODER_SQL + f' SELECT "column", category, {rounded("value", "value")}, {rounded("global_mean", "global_mean")} FROM enc',
)
def _(spark, sf):
    path = staging_path(spark, "encoders")
    writers.write_encoders(encode.fit_target_encoder(tables.features(spark, sf)), path)
    return writers.read_encoders(spark, path)


@query(
    "read_encoders",
    ENCODER_SQL + """ SELECT "column", count(*) AS categories FROM enc GROUP BY "column\"""",
)
def _(spark, sf):
    path = staging_path(spark, "encoders")
    writers.write_encoders(encode.fit_target_encoder(tables.features(spark, sf)), path)
    return writers.read_encoders(spark, path).groupBy("column").agg(F.count("*").alias("categories"))


@query(
    "apply_target_encoder",
    ENCODER_SQL
    + f""" SELECT {', '.join(micros('f.' + k, k) if k == 'event_timestamp' else 'f.' + k for k in KEYS)},
    """
    + ", ".join(
        rounded(
            f"""coalesce((SELECT value FROM enc WHERE "column" = '{c}' AND category = CASE WHEN f.product_id = 3 THEN 'new' ELSE f.{c} END),
            (SELECT m FROM overall))""",
            c,
        )
        for c in CATEGORICAL_FEATURES
    )
    + " FROM features f",
)
def _(spark, sf):
    rows = tables.features(spark, sf)
    encoders = encode.fit_target_encoder(rows)
    # One product carries categories the encoder has not seen.
    fresh = rows.withColumns(
        {c: F.when(F.col("product_id") == 3, "new").otherwise(F.col(c)) for c in CATEGORICAL_FEATURES}
    )
    return encode.apply_target_encoder(fresh, encoders).select(*KEYS, *CATEGORICAL_FEATURES)


QUALITY_SQL = """, rated AS (
  SELECT d.doc_id, d.lang, d.source, CAST(l.quality AS BIGINT) AS quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def _rated(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    return docs.join(labels, "doc_id")


@query(
    "apply_encoding",
    QUALITY_SQL
    + f""" SELECT doc_id, {rounded('(s + 20 * g) / (n + 20)', 'lang')} FROM (
    SELECT doc_id, sum(quality) OVER (PARTITION BY lang) AS s, count(*) OVER (PARTITION BY lang) AS n,
      (SELECT avg(quality) FROM rated) AS g FROM rated)""",
)
def _(spark, sf):
    rated = _rated(spark, sf)
    encoders = encode.fit_target_encoder(rated, ["lang"], "quality")
    return encode.apply_encoding(rated, encoders, "lang").select("doc_id", "lang")


@query(
    "fit_label_index",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS category, row_number() OVER (ORDER BY {c}) - 1 AS "index"
        FROM (SELECT DISTINCT {c} FROM features)"""
        for c in CATEGORICAL_FEATURES
    ),
)
def _(spark, sf):
    return encode.fit_label_index(tables.features(spark, sf), CATEGORICAL_FEATURES)


INDEX_SQL = """, idx AS (SELECT brand AS category, row_number() OVER (ORDER BY brand) - 1 AS i
    FROM (SELECT DISTINCT brand FROM features WHERE is_purchased = 1 AND product_id <> 3))"""


def _indexed(spark, sf, rule):
    rows = tables.features(spark, sf)
    index = encode.fit_label_index(rows.filter("is_purchased = 1 and product_id <> 3"), ["brand"])
    return encode.label_encode(rows, index, ["brand"], rule).select(*KEYS, "brand")


@query(
    "label_encode",
    INDEX_SQL + f" SELECT {listed(KEYS)}, coalesce(i, -1) AS brand FROM features LEFT JOIN idx ON brand = category",
)
def _(spark, sf):
    return _indexed(spark, sf, "minus_one")


@query(
    "label_encode_unknown",
    INDEX_SQL
    + f""" SELECT {listed(KEYS)}, coalesce(i, (SELECT i FROM idx WHERE category = 'unknown'), 0) AS brand
    FROM features LEFT JOIN idx ON brand = category""",
)
def _(spark, sf):
    return _indexed(spark, sf, "unknown")


@query(
    "standardize",
    "SELECT " + listed(KEYS) + ", "
    + ", ".join(
        rounded(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c)
        for c in ("price", "activity_count", "user_total_events")
    )
    + " FROM features",
)
def _(spark, sf):
    columns = ["price", "activity_count", "user_total_events"]
    return encode.standardize(tables.features(spark, sf), columns).select(*KEYS, *columns)


@query(
    "one_hot_capped",
    """, counts AS (SELECT user_id, count(*) AS n FROM features GROUP BY user_id),
    top AS (SELECT user_id FROM counts ORDER BY n DESC, CAST(user_id AS VARCHAR) LIMIT 9)
    SELECT CASE WHEN user_id IN (SELECT user_id FROM top) THEN CAST(user_id AS VARCHAR)
      WHEN (SELECT count(*) FROM counts) <= 10 THEN CAST(user_id AS VARCHAR) ELSE 'infrequent' END AS slot,
    count(*) AS rows FROM features GROUP BY 1""",
)
def _(spark, sf):
    rows = tables.features(spark, sf).select("user_id")
    fitted = encode.fit_one_hot(rows, "user_id", max_categories=10)
    hot = encode.one_hot_capped(rows, fitted, "user_id")
    total = hot.agg(*[F.sum(F.col(f"`{c}`")).alias(c.removeprefix("user_id=")) for c in hot.columns])
    return total.unpivot([], total.columns, "slot", "rows")


@query(
    "winsorize",
    f"""SELECT {listed(KEYS)}, {rounded('least(greatest(price, (SELECT quantile_cont(price, 1e-2) FROM features)), (SELECT quantile_cont(price, 99e-2) FROM features))', 'price')}
    FROM features""",
)
def _(spark, sf):
    return encode.winsorize(tables.features(spark, sf), ["price"], 0.01, 0.99).select(*KEYS, "price")


@query(
    "class_weight",
    "SELECT "
    + rounded("count(*) FILTER (is_purchased = 0) / (count(*) FILTER (is_purchased = 1))::DOUBLE", "pos_weight")
    + ", " + rounded("count(*) / (2 * count(*) FILTER (is_purchased = 1))::DOUBLE", "weight_1")
    + ", " + rounded("count(*) / (2 * count(*) FILTER (is_purchased = 0))::DOUBLE", "weight_0")
    + " FROM features",
)
def _(spark, sf):
    return encode.class_weight(tables.features(spark, sf))


