"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.split import sample_n
from ..schemas import EVENTS

FORMATS = {".csv": "csv", ".csv.gz": "csv", ".parquet": "parquet", ".pq": "parquet"}


def read_events(
    spark: SparkSession, path: str, partitions: int | None = None, keep_corrupt: bool = False
) -> DataFrame:
    """Headered CSV event log (plain or gzip) with the fixed schema.

    A gzip file is one split however large, so its rows are spread over ``partitions`` before any
    further work. Unreadable fields become null; ``keep_corrupt`` also keeps the raw line.
    """
    extra = [T.StructField("_corrupt_record", T.StringType())] if keep_corrupt else []
    schema = T.StructType(EVENTS.fields + extra)
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.repartition(partitions) if partitions else df


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV or Parquet by suffix; any other suffix is an error."""
    suffix = next((s for s in sorted(FORMATS, key=len, reverse=True) if path.endswith(s)), None)
    if suffix is None:
        raise ValueError(f"unsupported file type: {path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if FORMATS[suffix] == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.format(FORMATS[suffix]).load(path)


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet feature table with time columns as timestamps, whatever unit they were written in."""
    df = spark.read.parquet(path)
    casts = {
        name: F.col(name).cast("timestamp")
        for name, kind in df.dtypes
        if kind == "timestamp_ntz"
    }
    # Nanosecond times arrive as whole numbers when the session reads them so.
    casts |= {
        name: F.timestamp_micros(F.floor(F.col(name) / 1000).cast("bigint"))
        for name, kind in df.dtypes
        if kind == "bigint" and (name.endswith("_timestamp") or name == "event_time")
    }
    return df.withColumns(casts) if casts else df


def read_bounded_sample(
    df: DataFrame, columns: list[str], keys: list[str], n: int, seed: int = 42
) -> DataFrame:
    """n rows of the listed columns, chosen by a hash of the keys: repeatable on any layout.

    Only the listed columns and the keys are scanned. Rows are counted per hash bucket and only the
    bucket that holds the cut is ranked, so no task gathers the n rows.
    """
    named = df.select(*columns, *[F.col(k).alias(f"_k_{k}") for k in keys])
    return sample_n(named, [f"_k_{k}" for k in keys], n, seed).select(*columns)
