"""The clickstream the registered queries run on, mapped from the events and part tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENTS
from ..session import tune

# Fixed value: events name a product by a number, taken modulo this.
PRODUCTS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw event log with null brands, "NULL" sessions and exact copies, as real logs have."""
    events = table(spark, sf_dir, "events")
    # Product numbers are remainders, so only these parts can be met: few keys, however many parts there are.
    reach = F.col("p_partkey").between(1 - PRODUCTS, PRODUCTS - 1)
    head = F.lower("p_type")
    tail = F.lower(F.substring_index("p_name", " ", -1))
    part = table(spark, sf_dir, "part").filter(reach).select(
        "p_partkey",
        F.col("p_size").cast("bigint").alias("category_id"),
        F.when(F.col("p_size") % 7 == 0, F.lit(None))
        .when(F.col("p_size") % 3 == 0, head)
        .otherwise(F.concat_ws(".", head, tail))
        .alias("category_code"),
        F.lower("p_brand").alias("p_brand"),
    )
    kind = (
        F.when(F.col("event_type") == "signup", "view")
        .when(F.col("event_type") == "click", "cart")
        .when(F.col("event_type") == "error", "remove_from_cart")
        .otherwise(F.col("event_type"))
    )
    keyed = events.withColumn(
        "product_id", F.get_json_object("props", "$.k").cast("bigint") % F.lit(PRODUCTS)
    )
    week = F.trunc(F.col("ts").cast("timestamp").cast("date"), "week").cast("string")
    # Part keys are not null. Null-safe equality implies no filter, which would parse the text of every row twice.
    mapped = keyed.join(F.broadcast(part), F.col("product_id").eqNullSafe(F.col("p_partkey"))).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        kind.alias("event_type"),
        "product_id",
        "category_id",
        "category_code",
        F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("brand"),
        F.col("value").alias("price"),
        "user_id",
        F.when(F.col("event_id") % 101 == 0, F.lit("NULL"))
        .otherwise(F.concat_ws("-", F.col("user_id").cast("string"), week))
        .alias("user_session"),
    )
    # Exact copies of some rows, emitted in the same pass rather than by a second scan.
    copies = F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return mapped.withColumn("_copy", F.explode(copies)).select(*EVENTS.fieldNames())
