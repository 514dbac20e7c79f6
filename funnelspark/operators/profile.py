"""Dataset profile, quality and conversion reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import round_exact, share
from ..schemas import TARGET
from .ordered import quantiles
from .results import WEEKDAYS

QUALITY_CATEGORIES = ["brand", "category_code_level1", "category_code_level2", "event_weekday"]


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _total(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def event_distribution(df: DataFrame) -> DataFrame:
    """Events and percent of all events per type."""
    counts = df.groupBy("event_type").agg(F.count("*").alias("events"))
    return counts.select(
        "event_type", "events", (F.col("events") / _total(df) * 100).alias("percent")
    )


def null_counts(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Nulls and null percent per column, from one pass."""
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    out = counted.unpivot(["_rows"], df.columns, "column", "nulls").select(
        "column", "nulls", share(F.col("nulls"), F.col("_rows"), 100.0).alias("percent")
    )
    return out.filter("nulls > 0") if only_missing else out


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def _long(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    texts = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot(keep, columns, "column", "value")


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values per column."""
    distinct = _long(df, columns).filter("value is not null").distinct()
    return distinct.groupBy("column").agg(F.count("*").alias("distinct_values"))


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per value, most frequent first (equal counts by value), the first k or all."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows"))
    return counts if k is None else counts.orderBy(F.desc("rows"), column).limit(k)


def target_distribution(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows and share per class, and the ratio of the larger class to the smaller."""
    counts = df.groupBy(target).agg(F.count("*").alias("rows"))
    sizes = counts.agg(
        F.struct(F.sum("rows").alias("n"), F.max("rows").alias("hi"), F.min("rows").alias("lo"))
    ).scalar()
    return counts.select(
        target,
        "rows",
        (F.col("rows") / sizes["n"]).alias("share"),
        (sizes["hi"] / sizes["lo"]).alias("imbalance"),
    )


def label_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows, positives, negatives and the positive share."""
    n, pos = F.count("*"), F.coalesce(F.sum(target), F.lit(0))
    return df.agg(
        n.alias("rows"),
        pos.alias("positives"),
        (n - pos).alias("negatives"),
        F.avg(target).alias("positive_share"),
    )


def top_k(df: DataFrame, measure: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows with the largest measure."""
    return df.orderBy(F.desc(measure), *ties).limit(k)


def column_profiles(df: DataFrame) -> DataFrame:
    """Type, missing count and missing percent per column."""
    types = F.create_map(*[F.lit(x) for name, kind in df.dtypes for x in (name, kind)])
    return null_counts(df).select(
        "column",
        types[F.col("column")].alias("dtype"),
        F.col("nulls").alias("missing_count"),
        F.col("percent").alias("missing_percent"),
    )


def dataset_profile(
    df: DataFrame, target: str = TARGET, updated_at: dt.datetime | None = None
) -> DataFrame:
    """One row: size, missing percent, duplicates, column kinds, target."""
    numeric = len(numeric_columns(df))
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + F.count_if(F.col(c).isNull())
    cells = F.count("*") * len(df.columns)
    duplicates = duplicate_count(df).scalar()
    stamp = updated_at.isoformat(sep=" ") if updated_at else None
    return df.agg(F.count("*").alias("rows"), share(missing, cells, 100.0).alias("missing_percent")).select(
        "rows",
        F.lit(len(df.columns)).alias("cols"),
        "missing_percent",
        duplicates.alias("duplicate_rows"),
        F.lit(numeric).alias("numeric_columns"),
        F.lit(len(df.columns) - numeric).alias("categorical_columns"),
        F.lit(target).alias("target_column"),
        F.lit(stamp).cast("timestamp").alias("last_updated_at"),
    )


def equal_width_bin(x: Column, lo: Column, hi: Column, n: Column) -> Column:
    """Bin of x among n equal bins of lo..hi, the last one closed, settled by the bin edges."""
    step = (hi - lo) / n
    guess = F.floor((x - lo) / (hi - lo) * n)
    down = (x < lo + guess * step).cast("bigint")
    up = (x >= lo + (guess + 1) * step).cast("bigint")
    return F.greatest(F.lit(0), F.least(n - 1, guess - down + up)).cast("bigint")


def _widened(lo: Column, hi: Column) -> tuple[Column, Column]:
    flat = lo == hi
    return F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)


def histogram_bins(
    df: DataFrame,
    columns: list[str],
    bins: int,
    groups: list[str] | None = None,
    limit_to_distinct: bool = False,
) -> DataFrame:
    """(column, groups, bin, low, high, count): equal-width histograms of several columns.

    Bounds are taken over all groups. All columns are binned in one pass; empty bins are kept.
    """
    groups = groups or []
    long = (
        df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(groups, columns, "column", "x")
        .filter("x is not null and not isnan(x)")
    )
    distinct = F.countDistinct("x") if limit_to_distinct else F.lit(bins)
    lo, hi = _widened(F.min("x"), F.max("x"))
    bounds = long.groupBy("column").agg(
        lo.alias("lo"), hi.alias("hi"), F.least(F.lit(bins), distinct).cast("bigint").alias("n")
    )
    # One row per column: a size fixed by the call.
    counted = (
        long.join(F.broadcast(bounds), "column")
        .groupBy("column", *groups, equal_width_bin(*[F.col(c) for c in ("x", "lo", "hi", "n")]).alias("bin"))
        .agg(F.count("*").alias("c"))
    )
    frame = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    step = (F.col("hi") - F.col("lo")) / F.col("n")
    if groups:
        values = counted.select("column", *groups).distinct()
        frame = frame.join(values, "column")
    return frame.join(counted, ["column", *groups, "bin"], "left").select(
        "column",
        *groups,
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("high"),
        F.coalesce("c", F.lit(0)).alias("count"),
    )


def numeric_distribution(
    df: DataFrame, columns: list[str] | None = None, bins: int = 8
) -> DataFrame:
    """Mean, median, minimum, maximum and histogram of the given, or else all, numeric columns.

    One row per bin; there are no more bins than distinct values. Unreadable values are dropped.
    """
    columns = columns or numeric_columns(df)
    read = df.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    facts = (
        read.unpivot([], columns, "column", "x")
        .filter("x is not null and not isnan(x)")
        .groupBy("column")
        .agg(F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    )
    medians = quantiles(read, columns, {"median": 0.5}).select("column", "median")
    spread = histogram_bins(read, columns, bins, limit_to_distinct=True)
    return (
        spread.join(F.broadcast(facts), "column")
        .join(F.broadcast(medians), "column")
        .select(
            "column", "mean", "median", "min", "max", "bin",
            F.format_string("%.2f-%.2f", round_exact("low", 2), round_exact("high", 2)).alias("label"),
            "count",
        )
    )


def categorical_distribution(
    df: DataFrame, columns: list[str] | None = None, limit: int | None = 6
) -> DataFrame:
    """Distinct count and the ``limit`` (None: all) most frequent values of categorical columns, null as "<missing>"."""
    columns = columns or [c for c in QUALITY_CATEGORIES if c in df.columns]
    counts = (
        _long(df, columns)
        .groupBy("column", F.coalesce("value", F.lit("<missing>")).alias("label"))
        .agg(F.count("*").alias("count"))
    )
    sizes = counts.groupBy("column").agg(F.count("*").alias("unique_count"))
    # The rank filter is applied per task before rows move, so few rows per column are shuffled.
    by_count = Window.partitionBy("column").orderBy(F.desc("count"), "label")
    top = counts.withColumn("rank", F.row_number().over(by_count))
    top = top if limit is None else top.filter(F.col("rank") <= limit)
    return top.join(F.broadcast(sizes), "column").select(
        "column", "unique_count", "rank", "label", "count"
    )


def drift_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drift status without a reference table: what would be monitored, nothing drifted.

    Monitored are the given, or else all, numeric columns and the reported categories.
    """
    numeric = numeric_columns(df) if columns is None else columns
    monitored = len({*numeric, *[c for c in QUALITY_CATEGORIES if c in df.columns]})
    return df.agg(F.lit("not_configured").alias("status")).select(
        "status",
        F.lit(monitored).cast("bigint").alias("monitored_columns"),
        F.lit(0).cast("bigint").alias("drifted_columns"),
    )


def psi(df: DataFrame, reference: DataFrame, columns: list[str], floor: float = 1e-4) -> DataFrame:
    """Population stability index per categorical column; empty shares count as ``floor``."""

    def shares(side: DataFrame, name: str) -> DataFrame:
        counts = (
            _long(side, columns)
            .groupBy("column", F.coalesce("value", F.lit("<missing>")).alias("value"))
            .agg(F.count("*").alias("n"))
        )
        sizes = counts.groupBy("column").agg(F.sum("n").alias("total"))
        return counts.join(F.broadcast(sizes), "column").select(
            "column", "value", (F.col("n") / F.col("total")).alias(name)
        )

    both = shares(df, "a").join(shares(reference, "b"), ["column", "value"], "full_outer")
    a, b = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)) for c in ("a", "b"))
    return both.groupBy("column").agg(F.sum((a - b) * F.log(a / b)).alias("psi"))


def psi_numeric(
    df: DataFrame, reference: DataFrame, columns: list[str], bins: int = 10, floor: float = 1e-4
) -> DataFrame:
    """Population stability index per numeric column, over equal bins of the reference table.

    Values beyond the reference's range count in its first and last bin; empty shares count as
    ``floor``, nulls and NaN not at all. A column without a value on either side has no row.
    """

    def values(side: DataFrame) -> DataFrame:
        read = side.select(*[F.col(c).try_cast("double").alias(c) for c in columns])
        return read.unpivot([], columns, "column", "x").filter("x is not null and not isnan(x)")

    lo, hi = _widened(F.min("x"), F.max("x"))
    bounds = values(reference).groupBy("column").agg(lo.alias("lo"), hi.alias("hi"))

    def shares(side: DataFrame, name: str) -> DataFrame:
        # One row per column of the call.
        at = equal_width_bin(F.col("x"), F.col("lo"), F.col("hi"), F.lit(bins))
        counts = (
            values(side).join(F.broadcast(bounds), "column").groupBy("column", at.alias("bin"))
            .agg(F.count("*").alias("n"))
        )
        sizes = counts.groupBy("column").agg(F.sum("n").alias("total"))
        return counts.join(F.broadcast(sizes), "column").select(
            "column", "bin", (F.col("n") / F.col("total")).alias(name)
        )

    left, right = shares(df, "a"), shares(reference, "b")
    all_bins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")))
    frame = bounds.select("column", all_bins.alias("bin"))
    present = left.select("column").distinct()
    both = frame.join(F.broadcast(present), "column", "left_semi").join(
        left, ["column", "bin"], "left"
    ).join(right, ["column", "bin"], "left")
    a, b = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)) for c in ("a", "b"))
    return both.groupBy("column").agg(F.sum((a - b) * F.log(a / b)).alias("psi"))


def dataset_quality(
    df: DataFrame, worst: int = 8, values: int = 6, columns: list[str] | None = None
) -> dict[str, DataFrame]:
    """Duplicates, the ``worst`` columns by missing values, distributions with the ``values`` most
    frequent categories, and drift; numeric parts over the given, or else all, numeric columns."""
    total = _total(df)
    duplicates = duplicate_count(df).withColumn(
        "duplicate_percent", share(F.col("duplicates"), total, 100.0)
    )
    return {
        "duplicates": duplicates,
        "top_missing": column_profiles(df).orderBy(F.desc("missing_percent"), "column").limit(worst),
        "numeric": numeric_distribution(df, columns),
        "categorical": categorical_distribution(df, limit=values),
        "drift": drift_summary(df, columns),
    }


def conversion_counts(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Views, carts and purchases, from event types or else from feature columns."""
    if "event_type" in df.columns:
        kind = F.trim(F.lower(F.col("event_type")))
        return df.agg(
            F.count_if(kind == "view").alias("views"),
            F.count_if(kind == "cart").alias("carts"),
            F.count_if(kind == "purchase").alias("purchases"),
        )

    def total(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0).cast("bigint")
        value = F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))
        return F.coalesce(F.sum(value), F.lit(0.0)).cast("bigint")

    if target in df.columns:
        purchases = F.count_if(F.coalesce(F.col(target).try_cast("double"), F.lit(0.0)) > 0)
    else:
        purchases = total("product_total_purchases")
    return df.agg(
        total("product_total_views").alias("views"),
        F.count("*").alias("carts"),
        purchases.alias("purchases"),
    )


def brand_conversion(df: DataFrame, n: int = 10, target: str = TARGET) -> DataFrame:
    """Carts, purchases and conversion rate of the n brands with most carts.

    Without a target, purchases are carts times the mean brand rate, rounded half to even.
    """
    if target in df.columns:
        purchases = F.count_if(F.coalesce(F.col(target).try_cast("double"), F.lit(0.0)) > 0)
    elif "brand_purchase_rate" in df.columns:
        rate = F.avg(F.coalesce(F.col("brand_purchase_rate").try_cast("double"), F.lit(0.0)))
        purchases = F.rint(F.count("*") * rate).cast("bigint")
    else:
        purchases = F.lit(0).cast("bigint")
    return (
        df.groupBy(F.coalesce(F.col("brand").cast("string"), F.lit("unknown")).alias("brand"))
        .agg(F.count("*").alias("carts"), purchases.alias("purchases"))
        .withColumn("conversion_rate", share(F.col("purchases"), F.col("carts")))
        .orderBy(F.desc("carts"), "brand")
        .limit(n)
    )


def funnel_stages(counts: DataFrame) -> DataFrame:
    """View, Add to Cart, Purchase: value, rate against the step before, percent of views."""
    v, c, p = F.col("views"), F.col("carts"), F.col("purchases")

    def stage(i: int, name: str, value: Column, rate: Column) -> Column:
        return F.struct(
            F.lit(i).alias("step"),
            F.lit(name).alias("stage"),
            value.alias("value"),
            rate.cast("double").alias("rate"),
            share(value, v, 100.0).alias("pct_of_view"),
        )

    return counts.select(
        F.inline(
            F.array(
                stage(1, "View", v, F.lit(1.0)),
                stage(2, "Add to Cart", c, share(c, v)),
                stage(3, "Purchase", p, share(p, c)),
            )
        )
    )


def brand_share(conversion: DataFrame, n: int = 5) -> DataFrame:
    """The n brands with most carts: rate, volume and share of the listed brands' carts."""
    total = conversion.agg(F.sum("carts")).scalar()
    return conversion.orderBy(F.desc("carts"), "brand").limit(n).select(
        F.col("brand").alias("name"),
        F.col("conversion_rate").alias("rate"),
        F.col("carts").alias("volume"),
        "purchases",
        share(F.col("carts"), total).alias("share"),
    )


def bin_weighted_median(binned: DataFrame) -> DataFrame:
    """First minute whose cumulative volume reaches half of the total; 0 for an empty table.

    ``binned`` is (minute, volume) with one row per bin, so its size is the number of bins.
    """
    total = binned.agg(F.sum("volume")).scalar()
    upto = F.sum("volume").over(Window.orderBy("minute"))
    running = binned.select("minute", upto.alias("upto"))
    return running.agg(
        F.coalesce(F.min(F.when(F.col("upto") >= total / 2, F.col("minute"))), F.lit(0.0)).alias("median")
    )


def histogram_stats(binned: DataFrame, fast: float = 5.0) -> DataFrame:
    """Weighted mean, percent within the fast limit, weighted median, mean volume per bin."""
    volume = F.sum("volume")
    within = F.sum(F.when(F.col("minute") <= fast, F.col("volume")).otherwise(0))
    return binned.agg(
        F.coalesce(share(F.sum(F.col("minute") * F.col("volume")), volume), F.lit(0.0)).alias("mean"),
        F.coalesce(share(within, volume, 100.0), F.lit(0.0)).alias("within_fast_pct"),
        F.coalesce(F.avg("volume"), F.lit(0.0)).alias("mean_volume"),
    ).withColumn("median", bin_weighted_median(binned).scalar())


def best_bin(df: DataFrame, dim: str, measure: str) -> DataFrame:
    """The row with the largest measure, the first by the dimension among equals."""
    return df.orderBy(F.desc(measure), dim).limit(1)


def dense_weekdays(df: DataFrame, column: str = "event_weekday") -> DataFrame:
    """Rows per weekday, Monday first, 0 for absent days."""
    counts = df.groupBy(F.col(column).cast("bigint").alias("id")).agg(F.count("*").alias("n"))
    days = df.sparkSession.range(7)
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return days.join(counts, "id", "left").select(
        F.col("id").alias("weekday"),
        F.get(names, F.col("id").cast("int")).alias("day"),
        F.coalesce("n", F.lit(0)).alias("value"),
    )
