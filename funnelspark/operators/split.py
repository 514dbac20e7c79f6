"""Splits and samples by a repeatable hash of the row key.

Exact sizes are reached without sorting the table: rows are counted per hash bucket, the bucket
holding the cut is found from those counts, and only the rows of that bucket are ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash32
from ..session import stage

BUCKET_BITS = 16
# Up to this many classes their cuts are sent to all tasks.
BROADCAST_CLASSES = 10_000


def _bucket(h: Column) -> Column:
    return F.shiftright(h, 32 - BUCKET_BITS)


def _histogram(hashed: DataFrame, stratum: str) -> DataFrame:
    """Rows per (stratum, bucket), rows up to and including the bucket, rows of the stratum."""
    w = Window.partitionBy(stratum)
    return (
        hashed.groupBy(stratum, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumns(
            {
                "_upto": F.sum("_n").over(w.orderBy("_b")),
                "_total": F.sum("_n").over(w),
            }
        )
    )


def hash_cut(
    df: DataFrame,
    keys: list[str],
    stratum: Column | None,
    parts: list[tuple[str, Callable[[Column], Column]]],
    rest: str,
    seed: int = 42,
    out: str = "part",
) -> DataFrame:
    """Name each row's part by its hash rank inside its stratum (of the whole table without one).

    ``parts`` lists (name, quota): the quota maps the stratum size to the rank the part ends at,
    in rising order. Rows past the last quota get ``rest``. The keys identify a row.
    """
    hashed = df.withColumns(
        {"_s": F.lit(0) if stratum is None else stratum, "_h": hash32(*keys, seed=seed)}
    ).withColumn("_b", _bucket(F.col("_h")))
    counts = _histogram(hashed, "_s")
    first = F.col("_upto") - F.col("_n")
    edge_columns = [
        F.max(
            F.when(
                (quota(F.col("_total")) > first) & (quota(F.col("_total")) <= F.col("_upto")),
                F.struct(F.col("_b").alias("b"), (quota(F.col("_total")) - first).alias("need")),
            )
        ).alias(f"_e{i}")
        for i, (_, quota) in enumerate(parts)
    ]
    if stratum is None:
        # One row of edges: read as a value, so nothing is joined.
        edge = counts.agg(F.struct(*edge_columns)).scalar()
        placed = hashed.withColumns({f"_e{i}": edge[f"_e{i}"] for i in range(len(parts))})
    else:
        edges = counts.groupBy(F.col("_s").alias("_es")).agg(*edge_columns)
        # Stored and counted: a few classes must not shuffle the table into as many tasks.
        edges = stage(edges, "edges")
        few = edges.count() <= BROADCAST_CLASSES
        placed = hashed.join(
            F.broadcast(edges) if few else edges, F.col("_s").eqNullSafe(F.col("_es")), "left"
        )
    on_edge = F.lit(False)
    for i in range(len(parts)):
        on_edge = on_edge | F.coalesce(F.col("_b") == F.col(f"_e{i}.b"), F.lit(False))

    def name(rank: Column | None) -> Column:
        chain = F
        for i, (part, _) in enumerate(parts):
            inside = F.col("_b") < F.col(f"_e{i}.b")
            if rank is not None:
                inside = inside | (
                    (F.col("_b") == F.col(f"_e{i}.b")) & (rank <= F.col(f"_e{i}.need"))
                )
            chain = chain.when(F.coalesce(inside, F.lit(False)), F.lit(part))
        return chain.otherwise(F.lit(rest))

    in_bucket = Window.partitionBy("_s", "_b").orderBy("_h", *keys)
    clear = placed.filter(~on_edge).withColumn(out, name(None))
    border = (
        placed.filter(on_edge)
        .withColumn("_rank", F.row_number().over(in_bucket))
        .withColumn(out, name(F.col("_rank")))
    )
    columns = [*df.columns, out]
    return clear.select(*columns).unionByName(border.select(*columns))


def _upto(fraction: float | Column) -> Callable[[Column], Column]:
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return lambda total: F.floor(total * share + 0.5)


def split_stratified(
    df: DataFrame, keys: list[str], target: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add part ("train" or "test"), keeping the class shares."""
    return hash_cut(df, keys, F.col(target), [("test", _upto(test_size))], "train", seed)


def split_threshold(
    df: DataFrame, keys: list[str], test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add part by comparing the hash with the fraction: one pass, sizes only near the fraction."""
    cut = int(test_size * 2**32)
    test = hash32(*keys, seed=seed) < F.lit(cut)
    return df.withColumn("part", F.when(test, "test").otherwise("train"))


def split_three_way(
    df: DataFrame,
    keys: list[str],
    target: str,
    test_size: float = 0.2,
    val_size: float = 0.16,
    seed: int = 42,
) -> DataFrame:
    """Add part ("train", "val" or "test"): one hash, two cut points."""
    parts = [("test", _upto(test_size)), ("val", _upto(test_size + val_size))]
    return hash_cut(df, keys, F.col(target), parts, "train", seed)


def reserved_rows(df: DataFrame, cat_cols: list[str], keys: list[str]) -> DataFrame:
    """Keys of the first row (in key order) of every value of every categorical column."""
    long = df.select(
        F.struct(*keys).alias("_key"), *[F.col(c).cast("string").alias(c) for c in cat_cols]
    ).unpivot(["_key"], cat_cols, "_column", "_value")
    first = long.groupBy("_column", "_value").agg(F.min("_key").alias("_key"))
    return first.select("_key.*").distinct()


def anti_reserved(df: DataFrame, reserved: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are not reserved."""
    return df.join(reserved.select(*keys), keys, "left_anti")


def union_parts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both, columns matched by name."""
    return first.unionByName(second)


def split_with_coverage(
    df: DataFrame,
    cat_cols: list[str],
    target: str,
    keys: list[str],
    test_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Add part so that every category value occurs in train.

    One row per value is reserved for train; the test rows all come from the others, at a fraction
    raised to keep the overall size but at most one half, with class shares kept.
    """
    reserved = reserved_rows(df, cat_cols, keys)
    remaining = anti_reserved(df, reserved, keys)
    total = df.agg(F.count("*")).scalar()
    left = remaining.agg(F.count("*")).scalar()
    wanted = F.floor(total * F.lit(float(test_size)))
    fraction = F.least(wanted / F.greatest(left, F.lit(1)), F.lit(0.5))
    cut = hash_cut(remaining, keys, F.col(target), [("test", _upto(fraction))], "train", seed)
    kept = df.join(reserved, keys, "left_semi").withColumn("part", F.lit("train"))
    return union_parts(kept, cut)


def unseen_values(train: DataFrame, test: DataFrame, cat_cols: list[str]) -> DataFrame:
    """(column, value) pairs of test that train lacks."""

    def pairs(df: DataFrame) -> DataFrame:
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in cat_cols])
        return texts.unpivot([], cat_cols, "column", "value").distinct()

    left, right = pairs(test).alias("l"), pairs(train).alias("r")
    same = (F.col("l.column") == F.col("r.column")) & F.col("l.value").eqNullSafe(F.col("r.value"))
    return left.join(right, same, "left_anti")


def class_shares(parts: DataFrame, target: str, part: str = "part") -> DataFrame:
    """Rows and share of each class inside each part."""
    counts = parts.groupBy(part, target).agg(F.count("*").alias("rows"))
    of_part = F.sum("rows").over(Window.partitionBy(part))
    return counts.withColumn("share", F.col("rows") / of_part)


def validate_split(parts: DataFrame, cat_cols: list[str], part: str = "part") -> DataFrame:
    """Per categorical column the number of test values unseen in train, and whether that is 0."""
    unseen = unseen_values(
        parts.filter(F.col(part) == "train"), parts.filter(F.col(part) == "test"), cat_cols
    )
    counts = unseen.groupBy("column").agg(F.count("*").alias("n"))
    names = parts.sparkSession.createDataFrame([(c,) for c in cat_cols], "column string")
    return names.join(counts, "column", "left").select(
        "column",
        F.coalesce("n", F.lit(0)).alias("unseen"),
        F.col("n").isNull().alias("valid"),
    )


def hash_rank(
    df: DataFrame, keys: list[str], stratum: Column, seed: int = 42, out: str = "rank"
) -> DataFrame:
    """1-based hash rank of every row inside its stratum; ranking runs per hash bucket."""
    hashed = df.withColumns({"_s": stratum, "_h": hash32(*keys, seed=seed)}).withColumn(
        "_b", _bucket(F.col("_h"))
    )
    before = _histogram(hashed, "_s").select(
        F.col("_s").alias("_cs"), F.col("_b").alias("_cb"), (F.col("_upto") - F.col("_n")).alias("_first")
    )
    in_bucket = Window.partitionBy("_s", "_b").orderBy("_h", *keys)
    same = F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_b") == F.col("_cb"))
    return (
        hashed.withColumn("_rank", F.row_number().over(in_bucket))
        .join(before, same)
        .select(*df.columns, (F.col("_first") + F.col("_rank")).alias(out))
    )


def stratified_folds(
    df: DataFrame, keys: list[str], target: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Add fold (0 to k-1), class shares kept."""
    ranked = hash_rank(df, keys, F.col(target), seed, "_fold_rank")
    return ranked.withColumn("fold", ((F.col("_fold_rank") - 1) % k).cast("bigint")).drop("_fold_rank")


def sample_n(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows (all, if there are fewer), chosen by hash."""
    quota = [("in", lambda total: F.least(F.lit(n), total))]
    cut = hash_cut(df, keys, None, quota, "out", seed, "_sampled")
    return cut.filter("_sampled = 'in'").drop("_sampled")


def subsample_stratified(
    df: DataFrame, keys: list[str], target: str, cap: int = 1_000_000, seed: int = 42
) -> DataFrame:
    """All rows up to the cap; beyond it about cap rows with the class shares kept."""
    fraction = F.least(F.lit(1.0), F.lit(float(cap)) / df.agg(F.count("*")).scalar())
    cut = hash_cut(df, keys, F.col(target), [("in", _upto(fraction))], "out", seed, "_sampled")
    return cut.filter("_sampled = 'in'").drop("_sampled")
