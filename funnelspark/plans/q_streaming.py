"""Queries: streaming forms, fed with the event log as a series of files in time order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import agg_user
from ..session import staging_path
from ..streaming import streams
from . import tables
from .prelude import micros, rounded
from .q_prepare import EVENT_COLUMNS_SQL
from .registry import query

WEEKS = 5


def event_files(spark, sf, clean: bool = False) -> str:
    """Folder with the whole log, one write per week of the month, oldest first."""
    path = staging_path(spark, "event-files")
    source = tables.clean(spark, sf) if clean else tables.raw(spark, sf)
    week = F.floor((F.dayofmonth("event_time") - 1) / 7)
    sliced = source.withColumn("_week", week)
    for i in range(WEEKS):
        # One file per micro-batch: within a week the rows arrive in any order.
        # All tasks read the log, one writes.
        part = sliced.filter(F.col("_week") == i).drop("_week").repartition(1)
        part.write.mode("append").parquet(path)
    return path


def _stream(spark, sf, clean: bool = False):
    return streams.stream_events(spark, event_files(spark, sf, clean), files_per_trigger=1)


def _out(spark, stream, mode):
    path = staging_path(spark, "stream-out")
    streams.run_available(stream, path, mode)
    return spark.read.parquet(path)


@query("stream_events", f"SELECT {EVENT_COLUMNS_SQL} FROM raw")
def _(spark, sf):
    return _out(spark, _stream(spark, sf), "append")


@query(
    "stream_dedup",
    f"""SELECT {EVENT_COLUMNS_SQL} FROM (SELECT DISTINCT ON (user_id, user_session, event_time, event_type, product_id) *
    FROM raw)""",
)
def _(spark, sf):
    return _out(spark, streams.stream_dedup(_stream(spark, sf), "8 days"), "append")


def _funnel_sql(length: str, starts: str) -> str:
    return f"""SELECT epoch_us(s) AS window_start, epoch_us(s + INTERVAL {length}) AS window_end,
    count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'cart') AS carts,
    count(*) FILTER (event_type = 'purchase') AS purchases FROM (SELECT event_type, {starts} AS s FROM raw) GROUP BY s"""


@query("stream_funnel", _funnel_sql("1 DAY", "date_trunc('day', event_time)"))
def _(spark, sf):
    return _out(spark, streams.stream_funnel(_stream(spark, sf)), "complete")


@query(
    "stream_funnel_sliding",
    _funnel_sql(
        "2 DAY", "unnest([date_trunc('day', event_time), date_trunc('day', event_time) - INTERVAL 1 DAY])"
    ),
)
def _(spark, sf):
    funnel = streams.stream_funnel(_stream(spark, sf), "2 days", "1 day")
    return _out(spark, funnel, "complete")


@query(
    "stream_session_windows",
    """, marked AS (SELECT user_session, event_time, CASE WHEN event_time < lag(event_time) OVER (
      PARTITION BY user_session ORDER BY event_time) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM raw),
    burst AS (SELECT *, sum(fresh) OVER (PARTITION BY user_session ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS b FROM marked)
    SELECT user_session, epoch_us(min(event_time)) AS window_start, epoch_us(max(event_time) + INTERVAL 30 MINUTE) AS window_end,
    count(*) AS events FROM burst GROUP BY user_session, b""",
)
def _(spark, sf):
    return _out(spark, streams.stream_session_windows(_stream(spark, sf)), "complete")


@query(
    "stream_session_activity",
    f"SELECT user_session, {micros('event_time')}, event_type, product_id, user_id, activity_count FROM counted",
)
def _(spark, sf):
    counter = streams.StreamActivityCount(spark, staging_path(spark, "activity"))
    return counter.run(_stream(spark, sf, clean=True)).select(
        "user_session", "event_time", "event_type", "product_id", "user_id", "activity_count"
    )


@query(
    "stream_cart_label",
    f"""SELECT user_id, product_id, user_session, {micros('purchase_time')}, {micros('cart_time')} FROM credits""",
)
def _(spark, sf):
    labels = streams.StreamCartLabel(spark, staging_path(spark, "credits"))
    return labels.run(_stream(spark, sf, clean=True))


@query(
    "stream_user_features",
    f"""SELECT user_id, user_total_events, user_total_views, user_total_carts, user_total_purchases,
    {rounded('user_avg_purchase_price', 'user_avg_purchase_price')}, user_unique_products, user_unique_categories,
    {rounded('user_view_to_cart_rate', 'user_view_to_cart_rate')},
    {rounded('user_cart_to_purchase_rate', 'user_cart_to_purchase_rate')} FROM agg_user""",
)
def _(spark, sf):
    # So few products and categories per user are still exact in a sketch.
    totals = streams.StreamUserFeatures(spark, staging_path(spark, "user-totals"))
    return totals.run(_stream(spark, sf)).select(agg_user(tables.raw(spark, sf)).columns)


@query("stream_score", f"SELECT row_id, {rounded('score', 'probability')} FROM scored")
def _(spark, sf):
    from ..operators.score import derive_full_from_lite

    path = staging_path(spark, "lite-files")
    rows = derive_full_from_lite(tables.lite_batch(spark, sf))
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    return _out(spark, streams.stream_score(stream).select("row_id", "probability"), "append")
