"""Registry of named queries, each with its independent SQL where one can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def six_places(col: Column) -> Column:
    """Six places. The cut lies just below the half, where exact fractions do not fall, so sums
    added up in another order round alike."""
    return F.floor(col * 1e6 + 0.500001) / F.lit(1e6)


def present(df: DataFrame) -> DataFrame:
    """Comparable output: whole numbers as bigint, doubles to 6 places, times as microseconds."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            col = col.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            col = six_places(col.cast("double"))
        elif isinstance(f.dataType, T.TimestampType):
            col = F.unix_micros(col)
        out.append(col.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the body of its SQL (the prelude is added later)."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add
