"""Run history: search, best run, latest evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric(name: str) -> Column:
    """A run's metric, null where it was not logged."""
    return F.try_element_at("metrics", F.lit(name))


def tag(name: str) -> Column:
    """A run's tag, null where it was not set."""
    return F.try_element_at("tags", F.lit(name))


def search_runs(
    runs: DataFrame,
    where: Column | None = None,
    order_metric: str | None = None,
    ascending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Runs that meet the condition, by a metric (runs without it last) or else newest first.

    All of them, unless a limit is given.
    """
    out = runs if where is None else runs.filter(where)
    if order_metric is None:
        first = F.desc_nulls_last("start_time")
    else:
        value = metric(order_metric)
        first = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    found = out.orderBy(first, "run_id")
    return found if limit is None else found.limit(limit)


def best_run(runs: DataFrame, name: str, ascending: bool = False) -> DataFrame:
    """The run with the best metric; no row where there are no runs."""
    return search_runs(runs, None, name, ascending, 1)


def latest_eval_metric(runs: DataFrame, name: str) -> DataFrame:
    """Per source run, the metric of its newest finished evaluation (null if not logged)."""
    finished = runs.filter(F.col("source_run_id").isNotNull() & (F.col("status") == "FINISHED"))
    newest = F.struct("end_time", "run_id")
    return finished.groupBy("source_run_id").agg(
        F.max_by("run_id", newest).alias("eval_run_id"),
        F.max_by(F.struct(metric(name).alias("v")), newest)["v"].alias(name),
    )
