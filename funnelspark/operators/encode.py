"""Encoding and scaling of feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import UNKNOWN
from ..schemas import CATEGORICAL_FEATURES, ENCODER_FALLBACK, ENCODER_SMOOTHING, TARGET
from ..session import stage
from .joins import COMPRESSED, broadcast_limit, keyed_left_join, stored_bytes
from .ordered import quantiles, running_totals

INFREQUENT = "infrequent"


def _long_texts(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    texts = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot(keep, columns, "column", "category")


def fit_target_encoder(
    df: DataFrame,
    columns: list[str] = CATEGORICAL_FEATURES,
    target: str = TARGET,
    smoothing: int = ENCODER_SMOOTHING,
) -> DataFrame:
    """(column, category, value, global_mean): class mean of each category, drawn to the overall mean.

    Null is the category "unknown". All columns are counted in one aggregation.
    """
    overall = df.agg(F.avg(target)).scalar()
    counts = (
        _long_texts(df, columns, [target])
        .groupBy("column", F.coalesce("category", F.lit(UNKNOWN)).alias("category"))
        .agg(F.count(target).alias("n"), F.sum(F.col(target).cast("double")).alias("hits"))
    )
    value = (F.col("hits") + smoothing * overall) / (F.col("n") + smoothing)
    return counts.select(
        "column", "category", value.alias("value"), overall.alias("global_mean")
    )


def apply_encoding(df: DataFrame, encoders: DataFrame, column: str) -> DataFrame:
    """One column to its encoded value, unseen categories to the overall mean."""
    return apply_target_encoder(df, encoders, [column])


def _looked_up(df: DataFrame, fitted: DataFrame, value: str, texts: dict[str, Column]) -> DataFrame:
    """``df`` with ``_found_<i>``: what ``fitted`` (column, category, ``value``) has for the i-th text, or null.

    ``fitted`` must be stored and hold one row per column and category. Far below the session's broadcast threshold
    it becomes one dictionary (category, values of all columns), which is broadcast once and probed once per
    column in one pass. Else each column is a join that counts its heavy texts, "unknown" among them, and
    spreads their rows.
    """
    columns = list(texts)
    if COMPRESSED * stored_bytes(fitted) <= broadcast_limit(df.sparkSession):
        values = F.array(*[F.max(F.when(F.col("column") == c, F.col(value))) for c in columns])
        dictionary = fitted.groupBy("category").agg(values.alias("values"))
        out = df
        for i, c in enumerate(columns):
            # The same relation each time, so that Spark builds one copy of it.
            side = F.broadcast(dictionary.toDF(f"_category_{i}", f"_values_{i}"))
            out = out.join(side, texts[c] == F.col(f"_category_{i}"), "left")
        return out.select(*df.columns, *[F.col(f"_values_{i}")[i].alias(f"_found_{i}") for i in range(len(columns))])
    out = df
    for i, c in enumerate(columns):
        own = fitted.filter(F.col("column") == c)
        side = own.select(F.col("category").alias("_key"), F.col(value).alias(f"_found_{i}"))
        out = keyed_left_join(out, texts[c], side, [f"_found_{i}"], counted=df)
    return out


def _fitted(table: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a fitted table that belong to the columns of a call, stored."""
    return stage(table.filter(F.col("column").isin(columns)), "fitted")


def apply_target_encoder(
    df: DataFrame, encoders: DataFrame, columns: list[str] = CATEGORICAL_FEATURES
) -> DataFrame:
    """Columns to their encoded values.

    Text is trimmed but keeps its case. Unseen categories get the overall mean (0.26 where the
    encoder has none); a column without an encoder, or an absent column, becomes 0. The encoders are
    stored first and read as one dictionary where their size allows it.
    """
    present = [c for c in columns if c in df.columns]
    own = _fitted(encoders, present)
    # One row per column of the call.
    means = {r["column"]: r["mean"] for r in own.groupBy("column").agg(F.max("global_mean").alias("mean")).collect()}
    texts = {c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(UNKNOWN)) for c in present}
    out = _looked_up(df, own, "value", texts)
    encoded = {}
    for i, c in enumerate(present):
        mean = means.get(c, 0.0)
        fallback = F.lit(float(ENCODER_FALLBACK if mean is None else mean))
        encoded[c] = F.coalesce(F.col(f"_found_{i}"), fallback)
    absent = {c: F.lit(0.0) for c in columns if c not in present}
    return out.withColumns({**encoded, **absent}).drop(*[f"_found_{i}" for i in range(len(present))])


def fit_label_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, category, index): alphabetical position of each value; null is a value of its own."""
    # "None" is how the text form of a missing value reads.
    values = _long_texts(df, columns, []).select(
        "column", F.coalesce("category", F.lit("None")).alias("category")
    )
    ranked = running_totals(values.distinct(), ["category"], {"upto": F.lit(1)}, ["column"])
    return ranked.select("column", "category", (F.col("upto") - 1).alias("index"))


def label_encode(
    df: DataFrame, index: DataFrame, columns: list[str], unseen: str = "minus_one"
) -> DataFrame:
    """Columns to their fitted index.

    ``unseen`` is "minus_one", or "unknown": the index of the lower-cased, trimmed text, else that
    of "unknown", else 0.
    """
    if unseen not in ("minus_one", "unknown"):
        raise ValueError(f"unknown rule for unseen values {unseen!r}")
    own = _fitted(index, columns)
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns}
    defaults = dict.fromkeys(columns, -1)
    if unseen == "unknown":
        texts = {c: F.lower(F.trim(text)) for c, text in texts.items()}
        # At most one row per column of the call.
        known = {r["column"]: r["index"] for r in own.filter(F.col("category") == UNKNOWN).collect()}
        defaults = {c: known.get(c, 0) for c in columns}
    out = _looked_up(df, own, "index", texts)
    found = {
        c: F.coalesce(F.col(f"_found_{i}"), F.lit(defaults[c]).cast("bigint")) for i, c in enumerate(columns)
    }
    return out.withColumns(found).drop(*[f"_found_{i}" for i in range(len(columns))])


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus their mean over their population deviation; constant columns become 0."""
    facts = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        )
    ).scalar()

    def scaled(i: int, c: str) -> Column:
        s = F.when(facts[f"s{i}"] == 0, F.lit(1.0)).otherwise(facts[f"s{i}"])
        return (F.col(c) - facts[f"m{i}"]) / s

    return df.withColumns({c: scaled(i, c) for i, c in enumerate(columns)})


def fit_one_hot(df: DataFrame, column: str, max_categories: int = 100) -> DataFrame:
    """(category, slot): frequent categories keep a slot of their own, the rest share one.

    There are at most ``max_categories`` slots, the shared one included.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(
        F.col(column).cast("string").alias("category")
    ).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "category").limit(max_categories - 1)
    top = top.select("category", F.col("category").alias("slot"))
    size = counts.agg(F.count("*")).scalar()
    return counts.join(F.broadcast(top), "category", "left").select(
        "category",
        F.when(size <= max_categories, F.col("category"))
        .otherwise(F.coalesce("slot", F.lit(INFREQUENT)))
        .alias("slot"),
    )


def one_hot_slots(fitted: DataFrame) -> list[str]:
    """Slot names in order; their number is bounded by the fitting limit."""
    return [r.slot for r in fitted.select("slot").distinct().orderBy("slot").collect()]


def one_hot_capped(df: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """Replace the column by one 0/1 column per slot; unknown values give all zeros."""
    slots = one_hot_slots(fitted)
    side = fitted.select(F.col("category").alias("_category"), F.col("slot").alias("_slot"))
    joined = df.join(side, F.col(column).cast("string") == F.col("_category"), "left")
    hot = {
        f"{column}={s}": F.coalesce(F.col("_slot") == s, F.lit(False)).cast("bigint") for s in slots
    }
    return joined.withColumns(hot).drop("_category", "_slot", column)


def winsorize(
    df: DataFrame, columns: list[str], low: float | None = None, high: float | None = 0.99
) -> DataFrame:
    """Columns clipped to their own exact quantiles; nulls stay null."""
    wanted = {name: p for name, p in (("low", low), ("high", high)) if p is not None}
    bounds = quantiles(df, columns, wanted)
    facts = bounds.agg(
        F.struct(
            *[
                F.max(F.when(F.col("column") == c, F.col(name))).alias(f"{name}{i}")
                for i, c in enumerate(columns)
                for name in wanted
            ]
        )
    ).scalar()

    def clipped(i: int, c: str) -> Column:
        x = F.col(c).cast("double")
        y = x
        if low is not None:
            y = F.greatest(y, facts[f"low{i}"])
        if high is not None:
            y = F.least(y, facts[f"high{i}"])
        return F.when(x.isNotNull(), y)

    return df.withColumns({c: clipped(i, c) for i, c in enumerate(columns)})


def class_weight(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Negatives per positive and the balanced weight of each class, one row."""
    n, pos = F.count(target), F.count_if(F.col(target) == 1)
    neg = F.count_if(F.col(target) == 0)
    return df.agg(
        (neg / F.greatest(pos, F.lit(1))).alias("pos_weight"),
        F.when(pos > 0, n / (2 * pos)).alias("weight_1"),
        F.when(neg > 0, n / (2 * neg)).alias("weight_0"),
    )
