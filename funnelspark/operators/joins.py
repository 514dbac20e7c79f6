"""A left join that holds up when one key has much of the left side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

# At most this many keys are treated as hot. Every other key then holds at most a share of
# 1 / (HOT_KEYS + 1) of the weight, which one task can take.
HOT_KEYS = 1000

# A stored table takes up to about so many times its size in memory.
COMPRESSED = 8


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a stored table reads."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total += fs.getFileStatus(path).getLen()
    return total


def broadcast_limit(spark: SparkSession) -> int:
    """The session's broadcast threshold in bytes, -1 where broadcasts are off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if text.startswith("-"):
        return -1
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))


def spread_left_join(
    left: DataFrame, right: DataFrame, keys: list[str], weight: str, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """``left`` left-joined with ``right``, which has one row per key and the key's weight.

    The heaviest keys' rows are broadcast (a number of rows fixed by ``hot_keys``); left rows of
    those keys are answered by it and carry a salt that spreads them over all tasks of the shuffle
    join answering the other rows.

    ``right`` is read twice, so it is stored first: an aggregate behind it runs once. If its stored size is far
    below the session's broadcast threshold, it is broadcast whole instead. All its other columns, the
    weight included, are in the result.
    """
    spark = left.sparkSession
    right = stage(right, "right")
    if COMPRESSED * stored_bytes(right) <= broadcast_limit(spark):
        values = [c for c in right.columns if c not in keys]
        side = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *values)
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"_k_{k}"))
        return left.join(F.broadcast(side), same, "left").select(*left.columns, *values)
    salts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    values = [c for c in right.columns if c not in keys]
    hot = right.orderBy(F.desc(weight), *keys).limit(hot_keys)
    hot = hot.select(
        *[F.col(k).alias(f"_hk_{k}") for k in keys],
        *[F.col(c).alias(f"_h_{c}") for c in values],
        F.lit(True).alias("_hot"),
    )
    on_hot, on_cold = F.lit(True), F.col("_salt") == F.col("_rsalt")
    for k in keys:
        on_hot = on_hot & (F.col(k) == F.col(f"_hk_{k}"))
        on_cold = on_cold & (F.col(k) == F.col(f"_ck_{k}"))
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)) + 1
    # A null key matches nothing, and many rows may have it.
    nameless = F.lit(False)
    for k in keys:
        nameless = nameless | F.col(k).isNull()
    marked = left.join(F.broadcast(hot), on_hot, "left").withColumn(
        "_salt", F.when(F.col("_hot") | nameless, spread).otherwise(F.lit(0).cast("bigint"))
    )
    cold = right.select(
        *[F.col(k).alias(f"_ck_{k}") for k in keys],
        *[F.col(c).alias(f"_c_{c}") for c in values],
        # Always 0, as weights are counts; a literal would be folded out of the join keys.
        (F.col(weight) < 0).cast("bigint").alias("_rsalt"),
    )
    joined = marked.join(cold, on_cold, "left")
    return joined.select(
        *left.columns,
        *[
            F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c)
            for c in values
        ],
    )


# Text that no stored key begins with.
NO_KEY = "\u0000"


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """The keys that hold more than ``share`` of the rows: fewer than 1 / ``share`` of them."""
    most = df.count() * share
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return stage(counts.filter(F.col("_n") > most).select(key), "heavy")


def keyed_left_join(
    left: DataFrame, key: Column, right: DataFrame, values: list[str], counted: DataFrame | None = None
) -> DataFrame:
    """``left`` with the ``values`` of ``right``, which has one row per text in its column ``_key``.

    A ``right`` whose files are far below the session's broadcast threshold is broadcast whole. Else only the left
    side is shuffled where ``right`` is stored in buckets of its key. Left keys that hold more than a
    quarter of a task's share of the rows are counted first; their rows on the right, fewer than four per task, are
    broadcast, and their rows on the left, like those without a key, are spread over all tasks. ``counted`` is a
    cheaper table with the same keys to count, where ``left`` is dear.
    """
    spark = left.sparkSession
    keyed = left.withColumn("_key", key)
    side = right.select(F.col("_key").alias("_rkey"), *[F.col(c).alias(f"_r_{c}") for c in values])
    if 0 < COMPRESSED * stored_bytes(right) <= broadcast_limit(spark):
        # The files behind the table are small: every task gets it whole.
        joined = keyed.join(F.broadcast(side), F.col("_key") == F.col("_rkey"), "left")
        return joined.select(*left.columns, *[F.col(f"_r_{c}").alias(c) for c in values])
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy_keys((left if counted is None else counted).select(key.alias("_key")), "_key", 1 / (4 * tasks))
    known = right.join(F.broadcast(heavy), "_key", "left_semi").select("_key", *values)
    hot = heavy.join(F.broadcast(known), "_key", "left").select(
        F.col("_key").alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in values]
    )
    marked = keyed.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    apart = F.concat(F.lit(NO_KEY), F.hex(F.xxhash64(*left.columns)))
    marked = marked.withColumn(
        "_cold", F.when(F.col("_hot").isNotNull() | F.col("_key").isNull(), apart).otherwise(F.col("_key"))
    ).drop("_key")
    joined = marked.join(side, F.col("_cold") == F.col("_rkey"), "left")
    picked = [
        F.when(F.col("_hot").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_r_{c}")).alias(c) for c in values
    ]
    return joined.select(*left.columns, *picked)
