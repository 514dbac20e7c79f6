"""Exploratory analysis as result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hour, share
from ..schemas import TARGET
from .encode import winsorize
from .labels import cart_purchase_latency
from .ordered import quantiles, running_totals
from .profile import _long, _widened, histogram_bins, value_counts

# Features whose class means are compared.
COMPARED = [
    "price", "activity_count", "event_hour", "user_total_events", "user_total_carts",
    "user_total_purchases", "user_view_to_cart_rate", "user_cart_to_purchase_rate",
    "product_total_events", "product_total_carts", "product_total_purchases",
    "product_view_to_cart_rate", "product_cart_to_purchase_rate", "product_unique_buyers",
    "brand_purchase_rate", "price_vs_user_avg", "price_vs_category_avg",
]


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    long = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], columns, "column", "x")
    )
    basic = long.groupBy("column").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    cuts = quantiles(df, columns, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("count")
    return basic.join(F.broadcast(cuts), "column", "left")


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, distinct values, most frequent value (smallest among equals) and its count."""
    counts = (
        _long(df, columns)
        .filter("value is not null")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    rank = F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count("*").alias("unique"),
        F.min_by("value", rank).alias("top"),
        F.max("n").alias("freq"),
    )


def histogram(
    df: DataFrame, column: str, bins: int = 50, clip_high: float | None = None, density: bool = False
) -> DataFrame:
    """Equal-width bins of a column, optionally clipped to a quantile first, counts or density."""
    source = df.select(column)
    if clip_high is not None:
        source = winsorize(source, [column], None, clip_high)
    binned = histogram_bins(source, [column], bins).drop("column")
    if not density:
        return binned
    total = binned.agg(F.sum("count")).scalar()
    return binned.withColumn("density", F.col("count") / (total * (F.col("high") - F.col("low"))))


def histogram_by_class(
    df: DataFrame, column: str, bins: int = 50, target: str = TARGET
) -> DataFrame:
    """Counts and density of a column per class, over the same bins for every class."""
    binned = histogram_bins(df.select(column, target), [column], bins, [target]).drop("column")
    totals = binned.groupBy(target).agg(F.sum("count").alias("total"))
    return binned.join(totals, target).select(
        target, "bin", "low", "high", "count",
        share(F.col("count"), F.col("total") * (F.col("high") - F.col("low"))).alias("density"),
    )


def box_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles and the 1 and 99 percent clip bounds per column."""
    wanted = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q99": 0.99}
    return quantiles(df, columns, wanted).drop("count")


def median_by_class(df: DataFrame, column: str = "price", target: str = TARGET) -> DataFrame:
    """Median of a column per class."""
    return quantiles(df, [column], {"median": 0.5}, [target]).select(target, "median")


def rate_by_dimension(df: DataFrame, dim: str, target: str = TARGET) -> DataFrame:
    """Mean target and rows per value of a dimension."""
    return df.groupBy(dim).agg(F.avg(target).alias("rate"), F.count("*").alias("rows"))


def semi_topk(df: DataFrame, column: str, k: int) -> DataFrame:
    """Rows whose value is among the k most frequent; the k values are a bounded broadcast."""
    present = df.filter(F.col(column).isNotNull())
    return df.join(F.broadcast(value_counts(present, column, k).select(column)), column, "left_semi")


def rate_by_topk(df: DataFrame, dim: str, k: int = 20, target: str = TARGET) -> DataFrame:
    """Mean target and rows for the k most frequent values of a dimension."""
    return rate_by_dimension(semi_topk(df, dim, k), dim, target)


def avg_price_by_category(df: DataFrame, dim: str = "category_code_level1") -> DataFrame:
    """Mean price per category."""
    return df.groupBy(dim).agg(F.avg("price").alias("avg_price"))


def rate_pivot(
    df: DataFrame, row: str, col: str, k: int | None = None, target: str = TARGET
) -> DataFrame:
    """Mean target per (row value, column value) in long form, for the k most frequent of both."""
    out = df
    if k is not None:
        rows, cols = value_counts(df, row, k).select(row), value_counts(df, col, k).select(col)
        out = df.join(F.broadcast(rows), row, "left_semi").join(F.broadcast(cols), col, "left_semi")
    return out.groupBy(row, col).agg(F.avg(target).alias("rate"))


def rate_pivot_wide(
    df: DataFrame, row: str, col: str, values: list, target: str = TARGET
) -> DataFrame:
    """Mean target per row value with one column per listed column value."""
    return df.groupBy(row).pivot(col, values).agg(F.avg(target))


MOMENTS = "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double"


def _pair_moments(batches):
    """Moments of every column pair over the rows of one task, skipping nulls per pair."""
    import numpy as np
    import pandas as pd

    total = None
    for batch in batches:
        x = batch.to_numpy(dtype=float, na_value=np.nan)
        seen = ~np.isnan(x)
        x, m = np.where(seen, x, 0.0), seen.astype(float)
        part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        total = part if total is None else total + part
    if total is not None:
        a, b = np.tril_indices(total.shape[1], -1)
        names = ["n", "sa", "sb", "saa", "sbb", "sab"]
        yield pd.DataFrame({"a": a, "b": b, **{k: total[i][a, b] for i, k in enumerate(names)}})


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns (lower triangle).

    Null where a column is constant; rows with a null in either column of a pair are skipped. Each
    task reduces its rows to one small matrix product per moment (Arrow batches), so hundreds of
    pairs cost one pass and the shuffle carries one row per pair and task.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)])).scalar()
    centred = df.select(
        *[(F.col(c).cast("double") - means[f"m{i}"]).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    sums = centred.mapInPandas(_pair_moments, MOMENTS).groupBy("a", "b").agg(
        *[F.sum(k).alias(k) for k in ("n", "sa", "sb", "saa", "sbb", "sab")]
    )
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    va, vb = n * F.col("saa") - sa * sa, n * F.col("sbb") - sb * sb
    # Columns are centred, so a variance that cancels out this far is rounding of a constant.
    varies = (va > n * F.col("saa") * 1e-12) & (vb > n * F.col("sbb") * 1e-12)
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.get(names, F.col("a")).alias("a"),
        F.get(names, F.col("b")).alias("b"),
        F.when(varies, (n * F.col("sab") - sa * sb) / F.sqrt(va * vb)).alias("corr"),
    )


def target_correlation(
    df: DataFrame, columns: list[str], target: str = TARGET, n: int | None = None
) -> DataFrame:
    """Correlation of each column with the target; with n, the n highest and n lowest."""
    features = [c for c in columns if c != target]
    pairs = correlation_matrix(df, [*features, target])
    out = pairs.filter((F.col("a") == target) & F.col("corr").isNotNull()).select(
        F.col("b").alias("feature"), "corr"
    )
    if n is None:
        return out
    high = out.orderBy(F.desc("corr"), "feature").limit(n).withColumn("side", F.lit("top"))
    low = out.orderBy("corr", "feature").limit(n).withColumn("side", F.lit("bottom"))
    return high.unionByName(low)


def collinear_pairs(df: DataFrame, columns: list[str], limit: float = 0.9) -> DataFrame:
    """Column pairs with an absolute correlation above the limit."""
    return correlation_matrix(df, columns).filter(F.abs("corr") > limit)


def mean_ratio_by_class(
    df: DataFrame, columns: list[str] = COMPARED, target: str = TARGET
) -> DataFrame:
    """Mean of each feature in class 1 and class 0, and their ratio."""
    hit = F.col(target) == 1
    wide = df.agg(
        *[
            F.struct(
                F.avg(F.when(hit, F.col(c))).alias("mean_1"),
                F.avg(F.when(F.col(target) == 0, F.col(c))).alias("mean_0"),
            ).alias(c)
            for c in columns
        ]
    )
    long = wide.unpivot([], columns, "feature", "m")
    one, zero = F.col("m.mean_1"), F.col("m.mean_0")
    return long.select(
        "feature", one.alias("mean_1"), zero.alias("mean_0"),
        F.when(zero != 0, one / zero).alias("ratio"),
    )


def entity_funnel(df: DataFrame, entity: str = "user") -> DataFrame:
    """Mean views, carts and purchases over rows, and the step percents."""
    v, c, p = (F.avg(f"{entity}_total_{what}") for what in ("views", "carts", "purchases"))
    return df.agg(
        F.lit(entity).alias("entity"),
        v.alias("views"),
        c.alias("carts"),
        p.alias("purchases"),
        share(c, v, 100.0).alias("view_to_cart_pct"),
        share(p, c, 100.0).alias("cart_to_purchase_pct"),
        share(p, v, 100.0).alias("view_to_purchase_pct"),
    )


def cumulative_share(df: DataFrame, column: str = "brand") -> DataFrame:
    """Values by falling count with their rank and cumulative percent of rows."""
    counts = value_counts(df.filter(F.col(column).isNotNull()), column)
    order = [F.desc("rows"), column]
    ranked = running_totals(counts, order, {"upto": F.col("rows"), "rank": F.lit(1)})
    total = counts.agg(F.sum("rows")).scalar()
    return ranked.select(
        column, "rank", "rows", (F.col("upto") / total * 100).alias("cumulative_pct")
    )


def long_tail(df: DataFrame, column: str = "brand") -> DataFrame:
    """How many of the most frequent values stay within 80 and 95 percent of the rows."""
    return cumulative_share(df, column).agg(
        F.count_if(F.col("cumulative_pct") <= 80).alias("n_80"),
        F.count_if(F.col("cumulative_pct") <= 95).alias("n_95"),
        F.count("*").alias("n_values"),
    )


def hourly_conversion(df: DataFrame, ts: str = "event_time", target: str = TARGET) -> DataFrame:
    """Percent converted per hour, with the peak hour marked.

    Without a target column a purchase event counts as converted.
    """
    hit = F.col(target) if target in df.columns else (F.col("event_type") == "purchase").cast("int")
    hours = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(hour(ts).alias("hour"))
        .agg((F.avg(hit) * 100).alias("rate_pct"))
    )
    peak = hours.agg(F.min_by("hour", F.struct((-F.col("rate_pct")).alias("r"), F.col("hour").alias("h")))).scalar()
    return hours.withColumn("is_peak", F.col("hour") == peak)


def latency_histogram(latency: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram of the delays in minutes, each pair of events counted.

    Where all delays are equal, the bins span half a minute to either side.
    """
    lo, hi = _widened(F.min("latency_minutes"), F.max("latency_minutes"))
    facts = latency.agg(F.struct(lo.alias("lo"), hi.alias("hi"))).scalar()
    x, step = F.col("latency_minutes"), (facts["hi"] - facts["lo"]) / bins
    at = F.least(F.lit(bins - 1), F.floor((x - facts["lo"]) / step))
    counted = latency.groupBy(at.cast("bigint").alias("id")).agg(F.sum("pairs").alias("n"))
    return latency.sparkSession.range(bins).join(counted, "id", "left").select(
        F.col("id").alias("bin"),
        (facts["lo"] + F.col("id") * step).alias("low"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def latency_stats(events: DataFrame, limit_seconds: int = 3600, fast: float = 5.0) -> DataFrame:
    """Pairs, mean and median minutes from cart to purchase, percent within the fast limit."""
    latency = cart_purchase_latency(events, limit_seconds)
    counts = latency.groupBy("latency_minutes").agg(F.sum("pairs").alias("n"))
    ranked = running_totals(counts, ["latency_minutes"], {"upto": F.col("n")})
    total = counts.agg(F.sum("n")).scalar()
    position = (total - 1) / 2
    x = F.col("latency_minutes")
    lower = F.min(F.when(F.col("upto") > F.floor(position), x))
    upper = F.min(F.when(F.col("upto") > F.ceil(position), x))
    return ranked.agg(
        F.sum("n").alias("pairs"),
        (F.sum(x * F.col("n")) / F.sum("n")).alias("mean_minutes"),
        ((lower + upper) / 2).alias("median_minutes"),
        share(F.sum(F.when(x <= fast, F.col("n")).otherwise(0)), F.sum("n"), 100.0).alias("within_fast_pct"),
    )
