"""Cleaning, filtering, coercion and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schemas import (
    ALL_FEATURES,
    DOUBLE_COLUMNS,
    EVENT_KEYS,
    FEATURE_DEFAULTS,
    LITE_FEATURES,
    LONG_COLUMNS,
)

LABEL_NAMES = ["actual_label", "label", "target", "y_true"]

# Display headings and the column names they stand for.
DISPLAY_NAMES = {
    "Category Code Level 1": "category_code_level1",
    "Category Code Level 2": "category_code_level2",
    "Brand": "brand",
    "Event Weekday": "event_weekday",
    "Price": "price",
    "Activity Count": "activity_count",
    "Is Purchased": "is_purchased",
}


def keep_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the smallest by all other columns.

    A mergeable minimum rather than a window: copies collapse before the shuffle, so a key that
    holds a large part of the table costs one row per input partition.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    # Spark sorts by the keys in this order: times differ most and are compared as numbers, texts cost most.
    kinds = dict(df.dtypes)
    keys = sorted(keys, key=lambda c: (not kinds[c].startswith("timestamp"), kinds[c] == "string"))
    kept = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_kept"))
    return kept.select(*[c if c in keys else F.col("_kept")[c].alias(c) for c in df.columns])


def dedup_events(events: DataFrame) -> DataFrame:
    """One event per (user, session, time, type, product)."""
    return keep_one(events, EVENT_KEYS)


def dedup_feature_rows(features: DataFrame, ts: str = "event_timestamp") -> DataFrame:
    """One feature row per (user, product, time)."""
    return keep_one(features, ["user_id", "product_id", ts])


def filter_sessions(events: DataFrame) -> DataFrame:
    """Rows with a session that is neither null nor the text "NULL"."""
    return events.filter(F.col("user_session").isNotNull() & (F.col("user_session") != "NULL"))


def filter_event_type(events: DataFrame, *types: str) -> DataFrame:
    """Rows of the given event types."""
    return events.filter(F.col("event_type").isin(*types))


def normalize_categories(
    df: DataFrame, columns: tuple[str, ...] = ("brand", "category_code"), trim: bool = False
) -> DataFrame:
    """Lower-case the columns, null as "unknown"."""
    return df.withColumns({c: C.clean_category(c, trim) for c in columns})


def clean_events(events: DataFrame) -> DataFrame:
    """Deduplicated, in a session, with normalized brand and category. Filters run first."""
    return normalize_categories(dedup_events(filter_sessions(events)))


def coerce_keys(df: DataFrame, columns: tuple[str, ...] = ("user_id", "product_id")) -> DataFrame:
    """Keys as whole numbers, unreadable as 0."""
    return df.withColumns({c: C.long_or(c) for c in columns})


def entity_key(col: Column | str) -> Column:
    """Lookup key: trimmed text, leading zeros and a plus sign gone where it is a whole number."""
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    return F.coalesce(text.try_cast("bigint").cast("string"), text)


def coerce_numeric(
    df: DataFrame,
    longs: list[str] = LONG_COLUMNS,
    doubles: list[str] = DOUBLE_COLUMNS,
) -> DataFrame:
    """Listed columns as bigint / double, unreadable and null as 0. Absent names are skipped."""
    have = set(df.columns)
    casts = {c: C.long_or(c) for c in longs if c in have}
    casts |= {c: C.double_or(c) for c in doubles if c in have}
    return df.withColumns(casts)


def coerce_with_default(
    df: DataFrame,
    longs: dict[str, int] | None = None,
    doubles: dict[str, float] | None = None,
    texts: dict[str, str] | None = None,
) -> DataFrame:
    """Typed columns with a default of their own."""
    casts = {c: C.long_or(c, d) for c, d in (longs or {}).items()}
    casts |= {c: C.double_or(c, d) for c, d in (doubles or {}).items()}
    casts |= {c: C.text_or(c, d) for c, d in (texts or {}).items()}
    return df.withColumns(casts)


def resolve_label(df: DataFrame, out: str = "actual_label") -> DataFrame:
    """0/1 label from the first label column present, null when there is none or it is not 0/1."""
    name = next((n for n in LABEL_NAMES if n in df.columns), None)
    value = C.binary_label(name) if name else F.lit(None).cast("bigint")
    return df.withColumn(out, value)


def fill_defaults(df: DataFrame) -> DataFrame:
    """Null features as 0, null price ratios as 1."""
    return df.fillna({c: v for c, v in FEATURE_DEFAULTS.items() if c in df.columns})


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (listed) column."""
    return df.na.drop(subset=subset)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Drop fully identical rows."""
    return df.distinct()


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; absent names are ignored."""
    return df.drop(*names)


def rename_columns(df: DataFrame, names: dict[str, str] = DISPLAY_NAMES) -> DataFrame:
    """Display headings to column names."""
    return df.withColumnsRenamed(names)


# What events are sorted by unless told otherwise.
SORT_ORDER = ["user_id", "product_id", "event_time"]


def normalize_headers(df: DataFrame) -> DataFrame:
    """Column names without byte-order mark, trimmed and lower-cased."""
    return df.toDF(*[c.replace("\ufeff", "").strip().lower() for c in df.columns])


def drop_dirty_columns(df: DataFrame) -> DataFrame:
    """Drop columns with a blank name or one holding "Unnamed"."""
    return df.select(*[f"`{c}`" for c in df.columns if c.strip() and "Unnamed" not in c])


def sort_events(
    events: DataFrame, order: list[str] = SORT_ORDER, partitions: int | None = None
) -> DataFrame:
    """Events in a total order over the whole table: by user, product and time, then by all other columns.

    Rows are range-partitioned by the order and sorted inside, so files written from the result follow each
    other in order. Nulls come first; rows that are equal in every column are interchangeable. A user
    with many events is cut at products and times.
    """
    ties = [c for c in events.columns if c not in order]
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartitionByRange(n, *order, *ties).sortWithinPartitions(*order, *ties)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Project the names; an error lists the absent ones."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.select(*names)


def fill_missing_columns(events: DataFrame, ts: str = "event_time") -> DataFrame:
    """Add event_weekday and activity_count only where absent."""
    from .labels import session_cumcount

    out = events
    if "event_weekday" not in out.columns:
        out = out.withColumn("event_weekday", C.weekday(ts))
    if "activity_count" not in out.columns:
        out = session_cumcount(out, ts=ts, out="activity_count")
    return out


def available_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[n for n in names if n in df.columns])


def select_model_columns(
    df: DataFrame,
    target: str = "is_purchased",
    drop: tuple[str, ...] = (
        "user_id", "product_id", "user_session", "event_time", "event_timestamp",
        "created_timestamp", "row_id",
    ),
) -> tuple[list[str], list[str]]:
    """(categorical, numeric) feature columns by type; ids, times and the target are left out."""
    categorical, numeric = [], []
    for field in df.schema.fields:
        if field.name == target or field.name in drop:
            continue
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            continue
        if isinstance(field.dataType, T.StringType):
            categorical.append(field.name)
        elif isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            numeric.append(field.name)
    return categorical, numeric


# Accepted ranges of scoring inputs (None is open).
RATE_COLUMNS = [
    "user_view_to_cart_rate", "user_cart_to_purchase_rate", "product_view_to_cart_rate",
    "product_cart_to_purchase_rate", "brand_purchase_rate",
]
OPEN_COLUMNS = ["price_vs_user_avg", "price_vs_category_avg"]


def contract_rules(names: list[str]) -> dict[str, Column]:
    """Rule name -> condition that a valid row meets."""
    rules: dict[str, Column] = {}
    for name in names:
        if name in ("brand", "category_code_level1", "category_code_level2"):
            rules[name] = F.col(name).isNotNull()
            continue
        value = F.col(name).try_cast("double")
        readable = value.isNotNull() & ~F.isnan(value)
        if name in OPEN_COLUMNS:
            rules[name] = readable
        elif name in RATE_COLUMNS:
            rules[name] = readable & value.between(0.0, 1.0)
        elif name == "event_weekday":
            rules[name] = readable & value.between(0, 6) & (value == F.floor(value))
        elif name == "event_hour":
            rules[name] = readable & value.between(0, 23) & (value == F.floor(value))
        else:
            rules[name] = readable & (value >= 0)
    return rules


def check_contract(df: DataFrame, names: list[str] = ALL_FEATURES) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks, in feature order."""
    broken = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
        for name, ok in contract_rules(names).items()
    ]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_contract(df: DataFrame, names: list[str] = ALL_FEATURES) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    checked = check_contract(df, names)
    bad = F.size("violations") > 0
    return checked.filter(~bad).drop("violations"), checked.filter(bad)


def detect_feature_set(df: DataFrame) -> str:
    """"full" or "lite" by the columns present; an error names what is missing."""
    have = set(df.columns)
    missing_full = [c for c in ALL_FEATURES if c not in have]
    missing_lite = [c for c in LITE_FEATURES if c not in have]
    if not missing_full:
        return "full"
    if not missing_lite:
        return "lite"
    raise ValueError(
        f"need the full or the lite feature set; full lacks {missing_full}, "
        f"lite lacks {missing_lite}, found {sorted(have)}"
    )
