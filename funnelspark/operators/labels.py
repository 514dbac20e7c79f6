"""Attributing purchases to carts, and the order of events inside a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import SAMPLE_COLUMNS
from ..session import stage
from .clean import filter_event_type
from .joins import spread_left_join
from .ordered import SLICE_US, running_count, time_slice

JOURNEY = ["user_id", "product_id", "user_session"]


def label_last_cart(events: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """Per purchase, the nearest strictly earlier cart of the same user, product and session.

    Columns: the journey keys, purchase_time, cart_time and earlier_carts (how many carts came
    before). Purchases without an earlier cart are left out.

    An as-of join without pairs: a window carries the last cart forward inside a time slice, and
    the last cart of earlier slices comes from a table with one row per journey and slice. A
    journey that holds a large part of the log is therefore spread over its time slices.
    """
    is_cart = F.col("event_type") == "cart"
    named = filter_event_type(events, "cart", "purchase").dropna(subset=JOURNEY)
    steps = named.select(
        *JOURNEY,
        "event_time",
        time_slice("event_time", slice_us).alias("_slice"),
        # Purchases sort ahead of carts of the same instant, so those are not "earlier".
        is_cart.cast("int").alias("_is_cart"),
        F.when(is_cart, F.col("event_time")).alias("_cart"),
    )
    inside = (
        Window.partitionBy(*JOURNEY, "_slice")
        .orderBy("event_time", "_is_cart")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    before = (
        Window.partitionBy(*JOURNEY)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    purchases = (
        steps.withColumn("_near", F.max("_cart").over(inside))
        .withColumn("_near_n", F.count("_cart").over(inside))
        .filter(F.col("_is_cart") == 0)
        .select(*JOURNEY, "_slice", F.col("event_time").alias("purchase_time"), "_near", "_near_n")
    )
    carry = (
        steps.groupBy(*JOURNEY, "_slice")
        .agg(F.max("_cart").alias("_last"), F.count("_cart").alias("_n"))
        .select(
            *JOURNEY,
            "_slice",
            F.max("_last").over(before).alias("_far"),
            F.sum("_n").over(before).alias("_far_n"),
        )
        .filter(F.col("_far").isNotNull())
    )
    cart_time = F.coalesce("_near", "_far")
    return (
        purchases.join(carry, [*JOURNEY, "_slice"], "left")
        .filter(cart_time.isNotNull())
        .select(
            *JOURNEY,
            "purchase_time",
            cart_time.alias("cart_time"),
            (F.col("_near_n") + F.coalesce("_far_n", F.lit(0))).alias("earlier_carts"),
        )
    )


def label_carts(carts: DataFrame, credits: DataFrame) -> DataFrame:
    """Carts with is_purchased: 1 where some purchase credits that cart.

    Credits are made distinct first, so two purchases of one cart do not repeat the cart.
    """
    credited = credits.select(*JOURNEY, F.col("cart_time").alias("event_time")).distinct()
    return carts.join(
        credited.withColumn("_hit", F.lit(1)), [*JOURNEY, "event_time"], "left"
    ).select(*carts.columns, F.coalesce("_hit", F.lit(0)).cast("bigint").alias("is_purchased"))


def label_same_session(events: DataFrame) -> DataFrame:
    """Carts with is_purchased: 1 where the user bought the product in that session, in any order."""
    carts, journeys = _carts_and_history(events, JOURNEY)
    joined = spread_left_join(carts, journeys, JOURNEY, "_carts")
    return joined.withColumn(
        "is_purchased", F.col("_last").isNotNull().cast("bigint")
    ).drop("_last", "_carts")


def label_any_later(events: DataFrame) -> DataFrame:
    """Carts with is_purchased: 1 where the user buys the product later, in any session."""
    keys = ["user_id", "product_id"]
    carts, history = _carts_and_history(events, keys)
    joined = spread_left_join(carts, history, keys, "_carts")
    later = F.coalesce(F.col("_last") > F.col("event_time"), F.lit(False))
    return joined.withColumn("is_purchased", later.cast("bigint")).drop("_last", "_carts")


def _carts_and_history(events: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Carts, and per key its last purchase (or null) and its number of carts.

    Keys without a purchase are there as well, so that the heavy ones among them are known.
    """
    kind = F.col("event_type")
    history = (
        filter_event_type(events, "cart", "purchase")
        .groupBy(*keys)
        .agg(
            F.max(F.when(kind == "purchase", F.col("event_time"))).alias("_last"),
            F.count_if(kind == "cart").alias("_carts"),
        )
        .filter(F.col("_carts") > 0)
    )
    return filter_event_type(events, "cart"), history


def rank_cart_per_purchase(events: DataFrame) -> DataFrame:
    """Per purchase its rank-1 cart and the number of ranked carts, without forming the pairs."""
    return label_last_cart(events).select(
        *JOURNEY,
        "purchase_time",
        "cart_time",
        F.lit(1).cast("bigint").alias("cart_rank"),
        F.col("earlier_carts").alias("ranked_carts"),
    )


def activity_count(events: DataFrame, slice_us: int = SLICE_US) -> DataFrame:
    """Add activity_count: events of the session up to and including this one.

    Events of one instant are ordered by type, product and user, which with the session and time
    identify a deduplicated event.
    """
    return running_count(
        events,
        ["user_session"],
        "event_time",
        ["event_type", "product_id", "user_id"],
        "activity_count",
        slice_us,
    )


def session_cumcount(
    df: DataFrame, ts: str = "event_time", out: str = "session_position"
) -> DataFrame:
    """1-based position in the session for tables without event types."""
    ties = [c for c in ("product_id", "user_id", "price") if c in df.columns]
    return running_count(df, ["user_session"], ts, ties, out)


def cart_samples(clean: DataFrame) -> DataFrame:
    """Labelled carts with category levels, weekday and activity count."""
    carts = filter_event_type(activity_count(clean), "cart")
    return (
        label_carts(carts, label_last_cart(clean))
        .withColumns(
            {
                "category_code_level1": C.level1("category_code"),
                "category_code_level2": C.level2("category_code"),
                "event_weekday": C.weekday("event_time"),
            }
        )
        .select(*SAMPLE_COLUMNS)
    )


# A bucket with more instants of a kind than this is cut into cells.
CELL = 1000


def cart_purchase_latency(
    events: DataFrame, limit_seconds: int = 3600, cell: int = CELL
) -> DataFrame:
    """Cart-to-purchase delays of at most the limit, same session and product.

    One row per distinct (cart instant, purchase instant) with ``pairs``, the number of event
    pairs it stands for. Events are counted per instant before the join, and the join key holds a
    time bucket of the length of the limit, so a long session only meets its neighbouring bucket.

    A bucket with many carts or purchases is a grid: its carts are dealt into rows and its purchases into columns
    of about ``cell`` instants, and each cell is a join key of its own. Copies made for that are about
    2 / ``cell`` of the pairs. Events without time, session or product make no pair.
    """
    keys = ["user_session", "product_id"]
    seconds = F.unix_micros("event_time") / F.lit(1_000_000)
    counted = stage(
        filter_event_type(events, "cart", "purchase")
        .dropna(subset=[*keys, "event_time"])
        .groupBy(*keys, "event_type", "event_time")
        .agg(F.count("*").alias("n"))
        .withColumn("bucket", F.floor(seconds / limit_seconds)),
        "instants",
    )
    carts = counted.filter("event_type = 'cart'").select(
        *keys,
        F.col("event_time").alias("cart_time"),
        F.col("n").alias("cart_n"),
        F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"),
    )
    purchases = counted.filter("event_type = 'purchase'").select(
        *keys, "bucket", F.col("event_time").alias("purchase_time"), F.col("n").alias("purchase_n")
    )
    grid = _heavy_buckets(carts, purchases, [*keys, "bucket"], cell)
    carts = _dealt(carts, grid, [*keys, "bucket"], "cart_time", "_row", "_column")
    purchases = _dealt(purchases, grid, [*keys, "bucket"], "purchase_time", "_column", "_row")
    delay = (F.unix_micros("purchase_time") - F.unix_micros("cart_time")) / F.lit(1_000_000)
    return (
        carts.join(purchases, [*keys, "bucket", "_row", "_column"])
        .withColumn("latency_seconds", delay)
        .filter(F.col("latency_seconds").between(0, limit_seconds))
        .select(
            *keys,
            "cart_time",
            "purchase_time",
            "latency_seconds",
            (F.col("latency_seconds") / 60).alias("latency_minutes"),
            (F.col("cart_n") * F.col("purchase_n")).alias("pairs"),
        )
    )


def _heavy_buckets(carts: DataFrame, purchases: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Buckets with more than ``cell`` carts or purchases, and some of either: their weight and grid, stored."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sizes = (
        carts.select(*keys, one.alias("c"), none.alias("p"))
        .unionByName(purchases.select(*keys, none.alias("c"), one.alias("p")))
        .groupBy(*keys)
        .agg(F.sum("c").alias("c"), F.sum("p").alias("p"))
        .filter((F.greatest("c", "p") > cell) & (F.least("c", "p") > 0))
    )
    return stage(
        sizes.select(
            *keys,
            (F.col("c") + F.col("p")).alias("_weight"),
            F.ceil(F.col("c") / cell).cast("int").alias("_row_parts"),
            F.ceil(F.col("p") / cell).cast("int").alias("_column_parts"),
        ),
        "grid",
    )


def _dealt(
    side: DataFrame, grid: DataFrame, keys: list[str], instant: str, own: str, other: str
) -> DataFrame:
    """One side of the join: dealt by its instants over its own axis, copied along the other one."""
    joined = spread_left_join(side, grid, keys, "_weight")
    parts, copies = (F.coalesce(f"{axis}_parts", F.lit(1)) for axis in (own, other))
    return joined.withColumns(
        {
            own: F.pmod(F.xxhash64(instant), parts).cast("int"),
            other: F.explode(F.sequence(F.lit(0), copies - 1)),
        }
    ).drop("_weight", "_row_parts", "_column_parts")
