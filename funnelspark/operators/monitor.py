"""Counters over a prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_exact


def prediction_stats(log: DataFrame) -> DataFrame:
    """Total, successes, failures and success percent per model, and overall (model "all")."""
    ok = F.count_if(F.col("success"))
    n = F.count("*")
    stats = log.rollup("model").agg(
        F.grouping("model").alias("_all"),
        n.alias("total"),
        ok.alias("success"),
        (n - ok).alias("failed"),
    )
    rate = F.when(F.col("total") > 0, round_exact(F.col("success") / F.col("total") * 100, 1))
    return stats.select(
        F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("model")).alias("model"),
        "total",
        "success",
        "failed",
        rate.otherwise(0.0).alias("success_rate"),
    )


def fallback_ratio(log: DataFrame) -> DataFrame:
    """Mean fallback ratio and sample size, zeros for an empty log."""
    ratio = F.col("feature_quality.fallback_ratio")
    return log.agg(
        F.coalesce(F.avg(ratio), F.lit(0.0)).alias("fallback_ratio"),
        F.count(ratio).alias("sample_size"),
    )
