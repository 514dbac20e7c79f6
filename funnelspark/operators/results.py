"""Analytics over a table of predictions.

Input columns: row_id, is_purchased, probability, actual_label, decision_threshold and the cohort
columns. ``simulated`` replaces every row's own threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import share
from ..schemas import DISPLAY_THRESHOLD, HIGH_CONFIDENCE, UNCERTAIN
from ..session import staging_path
from .ordered import row_numbers

# Weekday headings, Monday first; names of segments and bands.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
SEGMENTS = ["drop", "hesitant", "converters", "unknown"]
BANDS = ["High-conf negative", "Near threshold", "Moderate confidence", "High-conf positive"]


def effective_threshold(simulated: float | None = None) -> Column:
    """The simulated threshold, else the row's own within 0..1 (0.5 where missing)."""
    if simulated is not None:
        return F.lit(float(simulated))
    own = F.col("decision_threshold")
    known = F.when(~F.isnan(own), own)
    return F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), F.coalesce(known, F.lit(DISPLAY_THRESHOLD)))
    )


def effective_prediction(simulated: float | None = None) -> Column:
    """1 where the probability reaches the threshold; the stored label without a probability."""
    p = F.col("probability")
    reached = (p >= effective_threshold(simulated)).cast("bigint")
    return F.when(p.isNull(), F.col("is_purchased").cast("bigint")).otherwise(reached)


def threshold_gap(simulated: float | None = None) -> Column:
    """Probability minus threshold, null without a probability."""
    return F.col("probability") - effective_threshold(simulated)


def high_confidence(simulated: float | None = None) -> Column:
    """Whether the gap is at least the confidence margin either way."""
    return F.coalesce(F.abs(threshold_gap(simulated)) >= HIGH_CONFIDENCE, F.lit(False))


def _summary_columns(simulated: float | None) -> list[Column]:
    total = F.count("*")
    purchased = F.count_if(effective_prediction(simulated) == 1)
    return [
        total.alias("total"),
        purchased.alias("purchased"),
        (total - purchased).alias("not_purchased"),
        share(purchased, total).alias("purchase_rate"),
        F.coalesce(F.avg("probability"), F.lit(0.0)).alias("average_probability"),
        F.count_if(high_confidence(simulated)).alias("high_confidence"),
    ]


def batch_summary(df: DataFrame, simulated: float | None = None) -> DataFrame:
    """Totals, rate, mean probability and high-confidence count."""
    return df.agg(*_summary_columns(simulated))


def batch_vs_previous(
    df: DataFrame, current: str, previous: str, simulated: float | None = None
) -> DataFrame:
    """Totals of two batches (by ``batch_id``) side by side."""
    now, then = F.col("batch_id") == current, F.col("batch_id") == previous
    hit = effective_prediction(simulated) == 1
    sides = {"": now, "previous_": then}
    return df.filter(F.col("batch_id").isin(current, previous)).agg(
        F.lit(current).alias("batch_id"),
        *[
            column
            for prefix, side in sides.items()
            for column in (
                F.count_if(side).alias(f"{prefix}total"),
                F.count_if(side & hit).alias(f"{prefix}purchased"),
                F.count_if(side & ~hit).alias(f"{prefix}not_purchased"),
            )
        ],
    )


def threshold_flip_count(df: DataFrame, simulated: float | None) -> DataFrame:
    """Rows whose prediction differs from the stored one under the simulated threshold."""
    if simulated is None:
        return df.agg(F.lit(0).cast("bigint").alias("flips"))
    changed = F.col("probability").isNotNull() & (
        effective_prediction(simulated) != F.col("is_purchased")
    )
    return df.agg(F.count_if(changed).alias("flips"))


def _bin_of_ten() -> Column:
    return F.least(F.lit(9), F.floor(F.col("probability") * 10)).cast("bigint")


def _ten_bins(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(10).withColumnRenamed("id", "bin")


def probability_histogram(df: DataFrame) -> DataFrame:
    """Ten probability bins, the last one closed; empty bins are kept."""
    counts = df.filter("probability is not null").groupBy(_bin_of_ten().alias("bin")).agg(
        F.count("*").alias("n")
    )
    low = (F.col("bin") * 10).cast("string")
    high = ((F.col("bin") + 1) * 10).cast("string")
    return _ten_bins(df).join(counts, "bin", "left").select(
        "bin",
        F.concat(low, F.lit("-"), high, F.lit("%")).alias("label"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def band(simulated: float | None = None) -> Column:
    """Number of the confidence band of a row, in the order of BANDS."""
    gap = threshold_gap(simulated)
    return (
        F.when(gap <= -HIGH_CONFIDENCE, 0)
        .when(F.abs(gap) < UNCERTAIN, 1)
        .when(gap >= HIGH_CONFIDENCE, 3)
        .when(gap.isNotNull(), 2)
    )


def threshold_bands(df: DataFrame, simulated: float | None = None) -> DataFrame:
    """Row count of each confidence band."""
    at = band(simulated)
    counted = df.agg(*[F.count_if(at == i).alias(name) for i, name in enumerate(BANDS)])
    return counted.unpivot([], BANDS, "band", "count")


def band_insights(df: DataFrame, simulated: float | None = None) -> DataFrame:
    """Percent of rows near the threshold and percent confidently positive."""
    at = band(simulated)
    total = F.count(at)
    return df.agg(
        share(F.count_if(at == 1), total, 100.0).alias("near_threshold_pct"),
        share(F.count_if(at == 3), total, 100.0).alias("high_positive_pct"),
    )


def score_deciles(df: DataFrame) -> DataFrame:
    """Rows with a probability, with their rank and score decile (1 is the highest scores).

    Every decile but the last few holds ceil(n / 10) rows.
    """
    scored = df.filter("probability is not null")
    size = F.greatest(F.lit(1), F.ceil(scored.agg(F.count("*")).scalar() / 10))
    ranked = row_numbers(scored, [F.desc("probability"), "row_id"], "rank")
    return ranked.withColumn("decile", (F.floor((F.col("rank") - 1) / size) + 1).cast("bigint"))


def decile_performance(df: DataFrame, simulated: float | None = None) -> DataFrame:
    """Percent predicted to purchase in each score decile."""
    slim = df.select("row_id", "probability", "decision_threshold", "is_purchased")
    hit = effective_prediction(simulated) == 1
    return (
        score_deciles(slim)
        .groupBy("decile")
        .agg(F.count("*").alias("rows"), share(F.count_if(hit), F.count("*"), 100.0).alias("purchase_rate"))
        .select(F.concat(F.lit("D"), F.col("decile").cast("string")).alias("decile"), "rows", "purchase_rate")
    )


def labelled(df: DataFrame) -> DataFrame:
    """Rows with a probability and a 0/1 label."""
    return df.filter(F.col("probability").isNotNull() & F.col("actual_label").isin(0, 1))


def calibration(df: DataFrame) -> DataFrame:
    """Per probability bin: its midpoint in percent, the actual percent and the row count."""
    bins = labelled(df).groupBy(_bin_of_ten().alias("bin")).agg(
        F.count("*").alias("n"), F.sum("actual_label").alias("positive")
    )
    return _ten_bins(df).join(bins, "bin", "left").select(
        F.concat(F.lit("B"), (F.col("bin") + 1).cast("string")).alias("bin"),
        (F.col("bin") * 10 + 5).alias("predicted_rate"),
        F.when(F.col("n") > 0, F.col("positive") / F.col("n") * 100).otherwise(0.0).alias("actual_rate"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def confusion_at_threshold(df: DataFrame, simulated: float | None = None) -> DataFrame:
    """Confusion counts, precision, recall, and each cell relative to the largest."""
    hit = F.col("probability") >= effective_threshold(simulated)
    positive = F.col("actual_label") == 1
    cells = labelled(df).agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"),
        F.count_if(~hit & positive).alias("fn"),
    )
    top = F.greatest(F.lit(1), "tp", "fp", "tn", "fn")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select(
        "*",
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        *[(F.col(c) / top).alias(f"{c}_intensity") for c in ("tp", "fp", "tn", "fn")],
    )


def row_contributions() -> Column:
    """A row's contributions, its top signals where the list is missing, else an empty list."""
    own = F.col("feature_contributions")
    return F.when(F.size(own) > 0, own).otherwise(
        F.coalesce(F.col("explainability.top_signals"), F.slice(own, 1, 0))
    )


def global_importance(df: DataFrame, n: int = 10) -> DataFrame:
    """The n features with the largest mean absolute contribution over rows that carry them."""
    entries = df.select(F.explode(row_contributions()).alias("e"))
    return (
        entries.groupBy(F.col("e.feature").alias("feature"))
        .agg(
            F.min("e.display_name").alias("label"),
            F.avg(F.abs("e.contribution")).alias("mean_abs_contribution"),
        )
        .orderBy(F.desc("mean_abs_contribution"), "feature")
        .limit(n)
    )


def row_waterfall(df: DataFrame, row_id: int, n: int | None = None) -> DataFrame:
    """One row's contributions by absolute size, the first n or all."""
    picked = df.filter(F.col("row_id") == row_id).select(
        F.posexplode(row_contributions()).alias("position", "e")
    )
    out = picked.orderBy(F.desc(F.abs("e.contribution")), "position")
    out = out if n is None else out.limit(n)
    return out.select("e.feature", F.col("e.display_name").alias("label"), "e.contribution")


def compare_contributions(df: DataFrame, selected: int, pinned: int, n: int = 8) -> DataFrame:
    """Contributions of two rows side by side, the n largest differences."""

    def side(row: int, name: str) -> DataFrame:
        return df.filter(F.col("row_id") == row).select(
            F.explode(row_contributions()).alias("e")
        ).select(
            F.col("e.feature").alias("feature"),
            F.col("e.display_name").alias(f"{name}_label"),
            F.col("e.contribution").alias(name),
        )

    both = side(selected, "selected").join(side(pinned, "pinned"), "feature", "full_outer")
    return (
        both.select(
            "feature",
            F.coalesce("selected_label", "pinned_label").alias("label"),
            F.coalesce("selected", F.lit(0.0)).alias("selected"),
            F.coalesce("pinned", F.lit(0.0)).alias("pinned"),
        )
        .withColumn("delta", F.abs(F.col("selected") - F.col("pinned")))
        .orderBy(F.desc("delta"), "feature")
        .limit(n)
    )


def feature_key_union(df: DataFrame, selected: int, pinned: int) -> DataFrame:
    """Feature names carried by either of two rows."""
    return (
        df.filter(F.col("row_id").isin(selected, pinned))
        .select(F.explode(row_contributions()).alias("e"))
        .select("e.feature")
        .distinct()
    )


def explanation_coverage(df: DataFrame) -> DataFrame:
    """Rows with more than three contributions, rows with only top signals, and both shares."""
    count = F.coalesce(F.size("feature_contributions"), F.lit(0))
    signals = F.coalesce(F.size("explainability.top_signals"), F.lit(0))
    total = F.count("*")
    fallback = F.count_if((count <= 3) & (signals > 0))
    covered = F.count_if((count > 0) | (signals > 0))
    return df.agg(
        F.count_if(count > 3).alias("rows_with_full"),
        fallback.alias("rows_with_top_only"),
        share(covered, total, 100.0).alias("coverage_pct"),
        share(fallback, total, 100.0).alias("fallback_pct"),
    )


def predicted_rate(df: DataFrame, simulated: float | None = None) -> DataFrame:
    """Percent predicted positive among rows with a probability."""
    valid = F.col("probability").isNotNull()
    hits = F.count_if(valid & (effective_prediction(simulated) == 1))
    return df.agg(share(hits, F.count_if(valid), 100.0).alias("predicted_rate"))


def weekday_label(key: Column, zero_based: Column) -> Column:
    """Mon..Sun for a whole number in range (0-based or 1-based), else the text unchanged."""
    number = F.trim(key).try_cast("int")
    index = F.when(zero_based, number).otherwise(number - 1)
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return F.when(index.between(0, 6), F.get(names, index)).otherwise(key)


def cohort_breakdown(
    df: DataFrame, field: str, simulated: float | None = None, limit: int | None = 8
) -> DataFrame:
    """Count, predicted percent and mean probability percent per cohort.

    Blank cohorts are "Unknown". More than ``limit`` cohorts become one less and "Others"; None
    keeps all of them.
    Weekday cohorts are ordered and named by day, others by count. Cohorts are ranked by a
    distributed sort of the grouped table, so a column with many values is no single-task sort.
    """
    raw = F.col(field).cast("string")
    key = F.when(F.length(F.trim(raw)) > 0, raw).otherwise("Unknown")
    grouped = df.groupBy(key.alias("cohort")).agg(
        F.count("*").alias("count"),
        F.sum(effective_prediction(simulated)).alias("purchased"),
        F.coalesce(F.sum("probability"), F.lit(0.0)).alias("p_sum"),
        F.count("probability").alias("p_count"),
    )
    order: list[Column | str] = [F.desc("count"), "cohort"]
    if field == "event_weekday":
        number = F.trim("cohort").try_cast("int")
        order = [F.asc_nulls_last(number), *order]
    ranked = row_numbers(grouped, order, "rank")
    facts = ranked.agg(
        F.struct(
            F.count("*").alias("n"), F.max((F.trim("cohort") == "0").cast("int")).alias("zero")
        )
    ).scalar()
    name = F.col("cohort")
    if field == "event_weekday":
        name = weekday_label(name, facts["zero"] == 1)
    most = F.lit(limit).cast("bigint")
    kept = most.isNull() | (facts["n"] <= most) | (F.col("rank") < most)
    # The mean of "Others" weighs each cohort's own mean by its row count, nulls included.
    mean = F.when(F.col("p_count") > 0, F.col("p_sum") / F.col("p_count")).otherwise(0.0)
    return (
        ranked.select(
            F.when(kept, F.col("rank")).otherwise(most).alias("position"),
            F.when(kept, name).otherwise("Others").alias("cohort"),
            "count",
            "purchased",
            (mean * F.col("count")).alias("weighted"),
        )
        .groupBy("position", "cohort")
        .agg(
            F.sum("count").alias("count"),
            (F.sum("purchased") / F.sum("count") * 100).alias("predicted_rate"),
            (F.sum("weighted") / F.sum("count") * 100).alias("avg_probability"),
        )
    )


def segment_condition(segment: str, simulated: float | None = None) -> Column:
    """Membership of an action segment; segments overlap."""
    gap = threshold_gap(simulated)
    return {
        "drop": gap <= -HIGH_CONFIDENCE,
        "hesitant": (gap >= 0) & (gap < HIGH_CONFIDENCE),
        "converters": gap >= HIGH_CONFIDENCE,
        "unknown": F.abs(gap) < UNCERTAIN,
    }[segment]


def action_segments(df: DataFrame, simulated: float | None = None) -> DataFrame:
    """Row count of each action segment."""
    counted = df.agg(
        *[F.count_if(segment_condition(s, simulated)).alias(s) for s in SEGMENTS]
    )
    return counted.unpivot([], SEGMENTS, "segment", "count")


def filter_results(
    df: DataFrame,
    show: str = "all",
    low: float | None = None,
    high: float | None = None,
    row_text: str | None = None,
    rows: DataFrame | None = None,
    simulated: float | None = None,
) -> DataFrame:
    """Rows by predicted class or confidence, probability bounds, row-number text and a row set."""
    if low is not None and high is not None:
        low, high = min(low, high), max(low, high)
    out = df
    if show == "purchased":
        out = out.filter(effective_prediction(simulated) == 1)
    elif show == "not_purchased":
        out = out.filter(effective_prediction(simulated) == 0)
    elif show == "high_confidence":
        out = out.filter(high_confidence(simulated))
    elif show != "all":
        raise ValueError(f"unknown filter {show!r}")
    if low is not None:
        out = out.filter(F.col("probability") >= low)
    if high is not None:
        out = out.filter(F.col("probability") <= high)
    if row_text:
        out = out.filter(F.col("row_id").cast("string").contains(row_text.lower()))
    if rows is not None:
        out = out.join(rows.select("row_id").distinct(), "row_id", "left_semi")
    return out


# Up to this row a page is read by a plain limit; later ones ask for an index.
LIMIT_ROWS = 10_000


@dataclass(frozen=True)
class PageIndex:
    """Sorted rows stored in slices, with the number of rows before each slice.

    ``before`` has one number per slice and one for the end, so its size is the number of slices.
    """

    rows: DataFrame
    order: list[Column | str]
    before: list[int]

    def page(self, page: int = 1, size: int = 10) -> DataFrame:
        """One page, in order. Reads the slices it lies in (folders of the stored table) and of
        these only keeps the rows at its positions."""
        total = self.before[-1]
        first = min(max((page - 1) * size, 0), total)
        last = min(first + size, total)
        # Slices without rows hold no page.
        held = [i for i in range(len(self.before) - 1) if self.before[i] < last and self.before[i + 1] > first]
        inside = F.lit(False)
        if held:
            lo, hi = held[0], held[-1]
            at = F.col("_metadata.row_index")
            inside = F.col("_slice").between(lo, hi)
            inside = inside & ((F.col("_slice") > lo) | (at >= first - self.before[lo]))
            inside = inside & ((F.col("_slice") < hi) | (at < last - self.before[hi]))
        return self.rows.filter(inside).drop("_slice").orderBy(*self.order).limit(size)


def _total_order(df: DataFrame, order: list[Column | str], ties: list[str] | None) -> list[Column | str]:
    if ties is None:
        ties = ["row_id"] if "row_id" in df.columns else df.columns
    return [*order, *ties]


def index_results(
    df: DataFrame, order: list[Column | str], ties: list[str] | None = None, slices: int | None = None
) -> PageIndex:
    """Rows sorted once and stored, so that any page costs one or two slices.

    ``ties`` make the order unique: ``row_id``, or all columns where there is none. Rows are
    range-partitioned, and each range is one sorted file in a folder of its own.
    """
    spark, whole = df.sparkSession, _total_order(df, order, ties)
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *whole).withColumn("_slice", F.spark_partition_id())
    path = staging_path(spark, "pages")
    placed.sortWithinPartitions("_slice", *whole).write.option("maxRecordsPerFile", 0).partitionBy("_slice").parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField("_slice", T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path)
    counts = {r["_slice"]: r["count"] for r in stored.groupBy("_slice").count().collect()}
    before = [0]
    for i in range(n):
        before.append(before[-1] + counts.get(i, 0))
    return PageIndex(stored, whole, before)


def page_results(
    df: DataFrame, order: list[Column | str], page: int = 1, size: int = 10, ties: list[str] | None = None
) -> DataFrame:
    """One page of the sorted rows, pages counted from 1; ``ties`` as for `index_results`.

    A page near the start is a limit, which keeps that many rows per task. A later one goes through an index; to read
    several such pages, build it once.
    """
    if page * size <= LIMIT_ROWS:
        return df.orderBy(*_total_order(df, order, ties)).offset((page - 1) * size).limit(size)
    return index_results(df, order, ties).page(page, size)


def export_segment(df: DataFrame, segment: str, simulated: float | None = None) -> DataFrame:
    """Rows of a segment as exported: 1-based row number, stored prediction, probability."""
    return df.filter(segment_condition(segment, simulated)).select(
        F.col("row_id").alias("row"), "is_purchased", "probability"
    )


def export_filtered(df: DataFrame, simulated: float | None = None, **filters) -> DataFrame:
    """Filtered rows as exported, with the simulated prediction and the threshold applied."""
    return filter_results(df, simulated=simulated, **filters).select(
        F.col("row_id").alias("row"),
        F.col("is_purchased").alias("original_is_purchased"),
        effective_prediction(simulated).alias("simulated_is_purchased"),
        "probability",
        F.format_string("%.4f", effective_threshold(simulated)).alias("threshold_applied"),
    )


