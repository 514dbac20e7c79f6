"""Feature tables: publishing, latest rows, point lookups."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import (
    ALL_FEATURES,
    CATEGORICAL_FEATURES,
    FEATURE_TABLE_COLUMNS,
    FEATURE_TTL_DAYS,
    TARGET,
)
from ..session import staging_path
from .clean import (
    available_columns,
    coerce_keys,
    coerce_numeric,
    entity_key,
    fill_missing_columns,
    rename_columns,
)
from .features import agg_product_lookup, agg_user_lookup
from .joins import keyed_left_join

USER_SIDE = [
    "event_weekday", "event_hour", "user_total_events", "user_total_views", "user_total_carts",
    "user_total_purchases", "user_view_to_cart_rate", "user_cart_to_purchase_rate",
    "user_avg_purchase_price", "user_unique_products", "user_unique_categories",
]
PRODUCT_SIDE = [c for c in ALL_FEATURES if c not in USER_SIDE]
LOOKUP_DEFAULTS = {"event_hour": 12, "event_weekday": 0}


@dataclass(frozen=True)
class FeatureView:
    """A named feature table: its keys, time column, features and time to live."""

    name: str = "cart_features"
    keys: tuple[str, ...] = ("user_id", "product_id")
    timestamp: str = "event_timestamp"
    ttl: dt.timedelta = dt.timedelta(days=FEATURE_TTL_DAYS)
    features: tuple[str, ...] = field(
        default=tuple(
            c
            for c in FEATURE_TABLE_COLUMNS
            if c not in ("user_id", "product_id", "event_timestamp", "created_timestamp")
        )
    )


PROPENSITY = FeatureView()


def _now(created_at: dt.datetime):
    return F.lit(created_at.isoformat(sep=" ")).cast("timestamp")


def publish_features_v1(samples: DataFrame, created_at: dt.datetime) -> DataFrame:
    """Typed 11-column table from cart samples, display headings accepted."""
    df = fill_missing_columns(coerce_keys(rename_columns(samples)))
    return df.withColumns(
        {
            "event_timestamp": F.col("event_time").cast("timestamp"),
            "created_timestamp": _now(created_at),
            **{c: C.clean_category(c) for c in CATEGORICAL_FEATURES},
        }
    ).select(
        "user_id", "product_id", "event_timestamp", "created_timestamp", "category_code_level1",
        "category_code_level2", "brand", "event_weekday", "price", "activity_count", TARGET,
    )


def publish_features_v2(features: DataFrame, created_at: dt.datetime) -> DataFrame:
    """Typed feature table; of the 31 columns those present, in order."""
    df = coerce_numeric(coerce_keys(features)).withColumn("created_timestamp", _now(created_at))
    if "event_timestamp" in df.columns:
        df = df.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    present = [c for c in CATEGORICAL_FEATURES if c in df.columns]
    df = df.withColumns({c: C.clean_category(c) for c in present})
    return available_columns(df, FEATURE_TABLE_COLUMNS)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by the order columns, then by the remaining columns.

    A mergeable maximum, so a key with many versions shrinks before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_newest"))
    return newest.select(*[c if c in keys else F.col("_newest")[c].alias(c) for c in df.columns])


def materialize_latest(features: DataFrame, view: FeatureView = PROPENSITY) -> DataFrame:
    """The newest row per entity pair: what an online store would hold."""
    return latest_per_key(features, list(view.keys), [view.timestamp])


def ttl_filter(
    features: DataFrame, as_of: dt.datetime, view: FeatureView = PROPENSITY
) -> DataFrame:
    """Rows no older than the view's time to live at ``as_of``."""
    oldest = F.lit((as_of - view.ttl).isoformat(sep=" ")).cast("timestamp")
    return features.filter(F.col(view.timestamp) >= oldest)


def text_key(*columns: str) -> Column:
    """One text for the key columns; null where one of them is."""
    parts = [F.col(c).cast("string") for c in columns]
    for k in range(len(parts) - 1, 0, -1):
        parts.insert(k, F.lit("/"))
    return F.concat(*parts)


def stored_by_key(df: DataFrame, name: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """A stored copy with a text key ``_key`` (of ``keys``, one row each), bucketed and sorted by it.

    Joins on the key read it without shuffling or sorting it. The number of buckets is that of shuffle partitions unless
    given; rows without a key are left out, as nothing finds them.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = staging_path(spark, name)
    table = f"{name}_{path.rsplit('-', 1)[1]}"
    keyed = df.withColumn("_key", text_key(*keys)).filter("_key is not null")
    # Dealt out as the buckets are, so each bucket is one file.
    writer = keyed.repartition(n, "_key").write.bucketBy(n, "_key").sortBy("_key")
    writer.format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def _with_key(table: DataFrame, keys: list[str]) -> DataFrame:
    return table if "_key" in table.columns else table.withColumn("_key", text_key(*keys))


def get_online_features(
    pairs: DataFrame, latest: DataFrame, view: FeatureView = PROPENSITY
) -> DataFrame:
    """The view's features for each entity pair, null where the pair is unknown.

    ``latest`` may come from ``stored_by_key``: then only the pairs are shuffled.
    """
    table = _with_key(latest, list(view.keys))
    return keyed_left_join(pairs, text_key(*view.keys), table, list(view.features))


def build_lookup_tables(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user table, product table)."""
    return agg_user_lookup(features), agg_product_lookup(features)


def lookup_features(
    pairs: DataFrame, users: DataFrame, products: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(found, not_found) for text entity pairs.

    A pair is found when either side is known; the missing side gets 0, hour 12 or "unknown". The tables may come
    from ``stored_by_key``: then only the pairs are shuffled. A product that very many pairs ask for is answered
    by a broadcast of its row.
    """
    user = _with_key(users, ["user_id"]).withColumn("_has_user", F.lit(1))
    product = _with_key(products, ["product_id"]).withColumn("_has_product", F.lit(1))
    joined = keyed_left_join(pairs, entity_key("user_id"), user, ["_has_user", *USER_SIDE])
    joined = keyed_left_join(joined, entity_key("product_id"), product, ["_has_product", *PRODUCT_SIDE], pairs)
    known = F.col("_has_user").isNotNull() | F.col("_has_product").isNotNull()
    filled = joined.fillna(
        {
            c: LOOKUP_DEFAULTS.get(c, C.UNKNOWN if c in CATEGORICAL_FEATURES else 0)
            for c in ALL_FEATURES
        }
    )
    found = filled.filter(known).select(*pairs.columns, *ALL_FEATURES)
    return found, joined.filter(~known).select(*pairs.columns)


def lookup_features_batch(
    pairs: DataFrame, latest: DataFrame, view: FeatureView = PROPENSITY
) -> DataFrame:
    """Online features for a table of text entity pairs; keys are trimmed and read as numbers."""
    typed = pairs.withColumns(
        {k: F.trim(F.col(k).cast("string")).try_cast("bigint") for k in view.keys}
    )
    return get_online_features(typed, latest, view)
