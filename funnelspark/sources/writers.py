"""Writers. Nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> str:
    """Headered CSV folder, one file per task."""
    writer = df.write.mode("overwrite").option("header", True)
    if quote_all:
        writer = writer.option("quoteAll", True).option("escape", '"')
    writer.csv(path)
    return path


def write_parquet(
    df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int = 5_000_000
) -> str:
    """Parquet folder, optionally partitioned.

    For a partitioned table rows are rebalanced on the partition columns first: adaptive execution
    merges small partitions and splits large ones, so a hot day becomes several files of its own.
    """
    writer = df.hint("rebalance", *partition_by) if partition_by else df
    out = writer.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return path


def write_feature_table(features: DataFrame, path: str, ts: str = "event_timestamp") -> str:
    """Feature table partitioned by event date."""
    return write_parquet(features.withColumn("event_date", F.to_date(ts)), path, ["event_date"])


def write_encoders(encoders: DataFrame, path: str) -> str:
    """Encoder table (column, category, value, global_mean)."""
    return write_parquet(encoders, path)


def read_encoders(spark, path: str) -> DataFrame:
    """Encoder table written by ``write_encoders``."""
    return spark.read.schema(
        "column string, category string, value double, global_mean double"
    ).parquet(path)


def write_predictions(scored: DataFrame, path: str) -> DataFrame:
    """Write scored rows as CSV and return a one-row log: rows, positives and their share.

    The log is computed from the written file, so the scoring is not run twice.
    """
    flat = scored.select(
        *[n for n, t in scored.dtypes if not t.startswith(("array", "struct", "map"))]
    )
    write_csv(flat, path)
    written = scored.sparkSession.read.schema(flat.schema).option("header", True).csv(path)
    positives = F.count_if(F.col("prediction") == 1)
    return written.agg(
        F.count("*").alias("rows"),
        positives.alias("positives"),
        F.when(F.count("*") > 0, positives / F.count("*")).otherwise(0.0).alias("positive_share"),
    )
