"""Running totals that never put a whole group, or the whole table, into one task.

Two techniques are used.

* Time slices: a group is cut by a fixed length of time. A window runs inside each slice, and the
  totals of earlier slices (one small row per group and slice) are joined back. Lazy, one plan.
* Order slices: rows are range-partitioned by the full sort order, added up per slice, written down
  with the slice number, and the totals of earlier slices are added. For orders without a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

# Five minutes: a session that holds a third of a month of events is still cut into thousands.
SLICE_US = 300_000_000


def time_slice(ts: Column | str, slice_us: int = SLICE_US) -> Column:
    """Number of the time slice a timestamp falls into."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col) / F.lit(slice_us)).cast("bigint")


def running_count(
    df: DataFrame, keys: list[str], ts: str, ties: list[str], out: str, slice_us: int = SLICE_US
) -> DataFrame:
    """1-based position of each row inside its group, ordered by time and then the tie columns."""
    cut = df.withColumn("_slice", time_slice(ts, slice_us))
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts, *ties)
    before = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        cut.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(before))
        .filter(F.col("_before") > 0)
        .select(*[F.col(k).alias(f"_c_{k}") for k in [*keys, "_slice"]], "_before")
    )
    # Null keys are a group of their own, as in the window.
    same = F.lit(True)
    for k in [*keys, "_slice"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return (
        cut.withColumn("_rn", F.row_number().over(inside).cast("bigint"))
        .join(carry, same, "left")
        .withColumn(out, F.col("_rn") + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, out)
    )


def _accumulate(names: list[str], kept: list[str], grouped: bool):
    """Function that adds running sums to the sorted Arrow batches of one task."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        carry, last = dict.fromkeys(names, 0), None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            starts = np.zeros(n, dtype=np.int64)
            continues = True
            if grouped:
                g = batch.column("_g").to_numpy()
                starts[1:] = np.where(g[1:] != g[:-1], np.arange(1, n), 0)
                starts = np.maximum.accumulate(starts)
                continues, last = last is not None and g[0] == last, g[-1]
            sums = []
            for name in names:
                upto = np.cumsum(batch.column(f"_m_{name}").to_numpy())
                before = np.where(starts > 0, upto[starts - 1], -carry[name] if continues else 0)
                upto = upto - before
                carry[name] = int(upto[-1])
                sums.append(pa.array(upto))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *sums], names=[*kept, *names])

    return add


def running_totals(
    df: DataFrame,
    order: list[Column | str],
    totals: dict[str, Column],
    groups: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Inclusive running sums of counts (never negative) in a total order, optionally inside groups.

    One shuffle: rows are range-partitioned and sorted, each task adds up its own rows (Arrow
    batches, constant memory), and the result is stored with its slice number. The totals of
    earlier slices are then added from a table with at most one row per slice: in sorted order
    only the first group of a slice can have rows in an earlier one, so broadcasting that table
    is bounded by ``slices``.
    """
    groups = groups or []
    names = list(totals)
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    measures = {f"_m_{k}": F.coalesce(v.cast("bigint"), F.lit(0)) for k, v in totals.items()}
    if groups:
        measures["_g"] = F.xxhash64(*groups)
    kept = [*df.columns, "_slice"]
    schema = T.StructType(
        df.schema.fields
        + [T.StructField("_slice", T.IntegerType())]
        + [T.StructField(k, T.LongType()) for k in names]
    )
    placed = stage(
        df.withColumns(measures)
        .repartitionByRange(n, *groups, *order)
        .sortWithinPartitions(*groups, *order)
        .withColumn("_slice", F.spark_partition_id())
        .mapInArrow(_accumulate(names, kept, bool(groups)), schema),
        "ordered",
    )
    earlier = (
        Window.partitionBy(*groups)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        placed.groupBy(*groups, "_slice")
        .agg(*[F.max(k).alias(f"_t_{k}") for k in names])
        .select(
            *[F.col(g).alias(f"_g_{g}") for g in groups],
            F.col("_slice").alias("_at"),
            F.count("_slice").over(earlier).alias("_earlier"),
            *[F.sum(f"_t_{k}").over(earlier).alias(f"_b_{k}") for k in names],
        )
        .filter(F.col("_earlier") > 0)
        .drop("_earlier")
    )
    match = F.col("_slice") == F.col("_at")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return placed.join(F.broadcast(carry), match, "left").select(
        *df.columns,
        *[(F.col(k) + F.coalesce(F.col(f"_b_{k}"), F.lit(0))).alias(k) for k in names],
    )


def row_numbers(
    df: DataFrame, order: list[Column | str], out: str, slices: int | None = None
) -> DataFrame:
    """1-based position of every row in a total order.

    As `running_totals` with a count of 1, but rows are numbered by Spark itself: the id it gives a row holds the
    partition in its upper bits and the position inside in its lower 33. Rows never pass through Python.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()),
        "ordered",
    )
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    earlier = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        placed.groupBy(part.alias("_at"))
        .agg(F.count("*").alias("_n"))
        .select("_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return placed.join(F.broadcast(carry), part == F.col("_at"), "left").select(
        *df.columns, (inside + 1 + F.coalesce("_before", F.lit(0))).alias(out)
    )


# Accuracy of the sketch that says where a quantile lies: ranks are off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
# Columns (and groups) with up to this many rows are ranked by one window; a larger one by range partitions.
WINDOW_ROWS = 1_000_000_000


def _brackets(long: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """Per (keys) the number of rows, and for each probability values between which its ranks surely lie.

    The sketch is mergeable: tasks send summaries, not values. Its error and the distance of the bounds from the
    quantile leave at least eight rows on either side; where there are too few rows for that, the
    bounds are infinite.
    """
    margin = 3 / ACCURACY
    bounds = [p - margin for p in probabilities] + [p + margin for p in probabilities]
    # NaN sorts behind infinity, which stands for it here.
    number = F.when(F.isnan("value"), F.lit(float("inf"))).otherwise(F.col("value"))
    found = long.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.percentile_approx(number, [min(max(b, 0.0), 1.0) for b in bounds], ACCURACY).alias("_at"),
    )
    few, least, most = F.col("total") < 4 * ACCURACY, F.lit(float("-inf")), F.lit(float("nan"))

    def bound(i: int) -> Column:
        at = F.col("_at")[i]
        if bounds[i] <= 0:
            return least
        if bounds[i] >= 1:
            return most
        if i < len(probabilities):
            return F.when(few, least).otherwise(at)
        return F.when(few | (at == float("inf")), most).otherwise(at)

    k = len(probabilities)
    return found.select(
        *keys,
        "total",
        F.array(*[bound(i) for i in range(k)]).alias("_low"),
        F.array(*[bound(k + i) for i in range(k)]).alias("_high"),
    )


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: dict[str, float],
    groups: list[str] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per (groups, column).

    A sketch brackets each quantile. Then values inside a bracket are counted one by one and all others by the
    interval between brackets they fall into, both before the shuffle, so a small fraction of a column moves.
    Its ranks are exact.
    """
    groups = groups or []
    # Null-safe keys of groups; the columns of the call are never null.
    long = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        groups, columns, "column", "value"
    ).filter("value is not null")
    keys = [*groups, "column"]
    brackets = stage(_brackets(long, keys, list(probabilities.values())), "brackets")
    side = brackets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_low", "_high")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # Without groups there is one row per column of the call.
    beside = long.join(side if groups else F.broadcast(side), same)
    value, inside, passed = F.col("value"), F.lit(False), F.lit(0)
    for i in range(len(probabilities)):
        inside = inside | ((value >= F.col("_low")[i]) & (value <= F.col("_high")[i]))
        passed = passed + (value > F.col("_high")[i]).cast("int")
    counts = (
        beside.groupBy(*keys, passed.alias("_passed"), F.when(inside, value).alias("_one"))
        .agg(F.count("*").alias("n"), F.min("value").alias("value"))
        .drop("_passed", "_one")
    )
    if (brackets.agg(F.max("total")).first()[0] or 0) > WINDOW_ROWS:
        ranked = running_totals(counts, ["value"], {"upto": F.col("n")}, groups=keys)
    else:
        upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("upto", F.sum("n").over(upto))
    sizes = brackets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "total")
    placed = ranked.join(sizes if groups else F.broadcast(sizes), same)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("value")))

    parts, finish = [], []
    for name, p in probabilities.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        parts += [at(F.floor(pos)).alias(f"_{name}_lo"), at(F.ceil(pos)).alias(f"_{name}_hi")]
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        finish.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    picked = placed.groupBy(*keys, "total").agg(*parts)
    return picked.select(*keys, F.col("total").alias("count"), *finish)
