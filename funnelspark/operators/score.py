"""Scoring batches of rows and explaining the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..schemas import (
    ALL_FEATURES,
    CONTRIBUTION,
    DECISION_THRESHOLD,
    LITE_FEATURES,
)
from .clean import check_contract
from .store import lookup_features

# Weights of the model-free score.
WEIGHTS = {
    "user_cart_to_purchase_rate": 0.35,
    "brand_purchase_rate": 0.25,
    "product_cart_to_purchase_rate": 0.20,
    "activity_count": 0.10,
    "user_view_to_cart_rate": 0.05,
    "price_vs_user_avg": 0.05,
}
# Constants of the lite derivation.
BASE_CONVERSION = 0.4
BRAND_SHARE = 0.3
BASE_SHARE = 0.7


def display_name(feature: str) -> str:
    """Heading of a feature."""
    return feature.replace("_", " ").title()


def clamp_threshold(threshold: float | None) -> float:
    """Threshold within 0..1, the default where none is given."""
    return DECISION_THRESHOLD if threshold is None else min(1.0, max(0.0, float(threshold)))


def threshold_predict(
    df: DataFrame, threshold: float | None = None, probability: str = "probability"
) -> DataFrame:
    """Add prediction: 1 where the probability reaches the threshold, null without one."""
    cut = F.lit(clamp_threshold(threshold))
    p = F.col(probability)
    return df.withColumn(
        "prediction", F.when(p.isNotNull(), (p >= cut).cast("bigint"))
    )


def max_class_probability(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Add class_probability: the probability of whichever class is likelier."""
    p = F.col(probability)
    return df.withColumn("class_probability", F.when(p.isNotNull(), F.greatest(p, 1 - p)))


def derive_full_from_lite(df: DataFrame) -> DataFrame:
    """The 14 lite inputs to all 26 features; other columns are kept."""
    d = {c: F.col(c).cast("double") for c in LITE_FEATURES[:11]}
    one = F.lit(1.0)
    whole = F.lit(True)
    for value in d.values():
        whole = whole & value.isNotNull()
    views, carts = F.greatest(d["user_total_views"], one), d["user_total_carts"]
    p_views, p_carts = F.greatest(d["product_total_views"], one), d["product_total_carts"]
    brand = d["brand_purchase_rate"]
    conversion = F.lit(BRAND_SHARE) * brand + F.lit(BASE_SHARE * BASE_CONVERSION)
    bought, p_bought = F.rint(carts * conversion), F.rint(p_carts * conversion)
    p_rate = F.least(p_carts / p_views, one)
    engagement = F.least(d["activity_count"] / 50, F.lit(1.5))
    derived = {
        "user_total_events": views + carts + bought,
        "user_total_views": views,
        "user_total_carts": carts,
        "user_total_purchases": bought,
        "user_view_to_cart_rate": F.least(carts / views, one),
        "user_cart_to_purchase_rate": F.least(bought / F.greatest(carts, one), one),
        "user_avg_purchase_price": d["price"] / F.greatest(d["price_vs_user_avg"], F.lit(0.5)),
        "user_unique_products": F.greatest(one, carts * 0.5 * engagement),
        "user_unique_categories": F.greatest(one, carts * 0.1 * engagement),
        "product_total_events": p_views + p_carts + p_bought,
        "product_total_views": p_views,
        "product_total_carts": p_carts,
        "product_total_purchases": p_bought,
        "product_view_to_cart_rate": p_rate,
        "product_cart_to_purchase_rate": F.least(p_bought / F.greatest(p_carts, one), one),
        "product_unique_buyers": F.greatest(
            one, p_carts * conversion * (F.lit(0.3) + p_rate * 0.7)
        ),
    }
    # least and greatest pass over nulls; what is derived from a missing input is missing.
    derived = {c: F.when(whole, value) for c, value in derived.items()}
    derived |= {c: d[c] for c in LITE_FEATURES[:11] if c not in derived}
    kept = [c for c in df.columns if c not in ALL_FEATURES]
    return df.select(
        *kept, *[derived.get(c, F.col(c)).alias(c) for c in ALL_FEATURES]
    )


def quality_struct() -> Column:
    """Quality of derived features: coverage and the level of the known rates, graded A to D."""
    coverage = F.lit(len(LITE_FEATURES) / len(ALL_FEATURES))
    rates = (
        F.col("user_view_to_cart_rate")
        + F.col("product_view_to_cart_rate")
        + F.col("brand_purchase_rate")
    ) / 3
    score = C.round_exact((coverage * 0.6 + rates * 0.4) * 100, 1)
    grade = F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").otherwise("D")
    return F.struct(
        score.alias("score"),
        grade.alias("grade"),
        F.lit(0.0).alias("fallback_ratio"),
        F.lit(len(ALL_FEATURES) - len(LITE_FEATURES)).cast("bigint").alias("inferred_count"),
        F.lit(0).cast("bigint").alias("fallback_count"),
    )


def feature_quality(derived: DataFrame) -> DataFrame:
    """Add feature_quality to rows derived from lite inputs."""
    return derived.withColumn("feature_quality", quality_struct())


def perfect_quality() -> Column:
    """Quality of rows whose 26 features were all looked up."""
    return F.struct(
        F.lit(100.0).alias("score"),
        F.lit("A").alias("grade"),
        F.lit(0.0).alias("fallback_ratio"),
        F.lit(0).cast("bigint").alias("inferred_count"),
        F.lit(0).cast("bigint").alias("fallback_count"),
    )


def heuristic_terms() -> dict[str, Column]:
    """The six terms of the model-free score, by feature."""
    cheap = F.greatest(
        F.lit(0.0), 1.0 - F.greatest(F.lit(0.0), F.col("price_vs_user_avg") - 1.0)
    )
    value = {
        "activity_count": F.least(F.lit(1.0), F.col("activity_count") / 20.0),
        "price_vs_user_avg": cheap,
    }
    # least and greatest pass over nulls; a missing feature must not earn its bonus.
    known = {f: F.when(F.col(f).isNotNull(), v) for f, v in value.items()}
    return {f: F.lit(w) * known.get(f, F.col(f)) for f, w in WEIGHTS.items()}


def score_heuristic(df: DataFrame) -> DataFrame:
    """Add probability: the weighted sum of six features, to 4 places."""
    terms = list(heuristic_terms().values())
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return (
        df.withColumn("_score", total)
        .withColumn("probability", C.round_exact("_score", 4))
        .drop("_score")
    )


def _entries(values: Column) -> Column:
    """Contribution entries of an array with one value per feature."""
    names = F.array(*[F.lit(f) for f in ALL_FEATURES])
    titles = F.array(*[F.lit(display_name(f)) for f in ALL_FEATURES])
    return F.arrays_zip(names, values, titles).cast(T.ArrayType(CONTRIBUTION))


def heuristic_contributions(df: DataFrame) -> DataFrame:
    """Add feature_contributions: the six terms to 6 places, 0 for the other features.

    Entries are made from an array of values rather than written out one by one: 26 written-out structs become
    a generated method that is too large to be compiled, and exploding them runs many times slower.
    """
    terms = heuristic_terms()
    values = F.array(*[C.round_exact(f"_t_{f}", 6) if f in terms else F.lit(0.0) for f in ALL_FEATURES])
    return (
        df.withColumns({f"_t_{f}": term for f, term in terms.items()})
        .withColumn("feature_contributions", _entries(values))
        .drop(*[f"_t_{f}" for f in terms])
    )


def importance_contributions(df: DataFrame, importances: list[float]) -> DataFrame:
    """Add feature_contributions: each encoded value's share of the row times its importance.

    Short importance lists are padded with 0; a row of zeros is divided by 1.
    """
    padded = (list(importances) + [0.0] * len(ALL_FEATURES))[: len(ALL_FEATURES)]
    values = F.array(*[F.col(f).cast("double") for f in ALL_FEATURES])
    total = F.aggregate("_values", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    weights = F.array(*[F.lit(float(w)) for w in padded])
    names = F.array(*[F.lit(f) for f in ALL_FEATURES])
    titles = F.array(*[F.lit(display_name(f)) for f in ALL_FEATURES])
    # The scale rides along in every entry, so it is summed once per row and not once per feature.
    scaled = df.withColumn("_values", values).withColumn(
        "_parts",
        F.zip_with(
            "_values",
            F.array_repeat(F.when(total == 0, F.lit(1.0)).otherwise(total), len(ALL_FEATURES)),
            lambda x, scale: x / scale,
        ),
    )
    signed = F.zip_with("_parts", weights, lambda x, w: x * w)
    entries = F.transform(
        signed,
        lambda x, i: F.struct(
            F.get(names, i).alias("feature"),
            C.round_exact(x, 6).alias("contribution"),
            F.get(titles, i).alias("display_name"),
        ),
    )
    return scaled.withColumn("feature_contributions", entries).drop("_values", "_parts")


def top_of(contributions: Column, n: int = 3) -> Column:
    """The n entries largest by absolute contribution, equal ones in feature order."""
    keyed = F.transform(
        contributions,
        lambda x, i: F.struct((-F.abs(x["contribution"])).alias("k"), i.alias("i"), x.alias("x")),
    )
    return F.transform(F.slice(F.sort_array(keyed), 1, n), lambda e: e["x"])


def top_signals(df: DataFrame) -> DataFrame:
    """Add top_signals: the three largest contributions."""
    return df.withColumn("top_signals", top_of(F.col("feature_contributions")))


def explain_payload(
    df: DataFrame, method: str = "heuristic", baseline: Column | float = 0.0, level: str = "top"
) -> DataFrame:
    """Add explainability, and cut the contributions to the level ("top" or "full")."""
    if level not in ("top", "full"):
        raise ValueError(f"unknown explain level {level!r}")
    base = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
    note = "Contributions show the effect of each feature on this row. Response level: " + level
    signals = top_of(F.col("feature_contributions"))
    payload = F.when(
        F.size("feature_contributions") > 0,
        F.struct(
            F.lit(method).alias("method"),
            C.round_exact(base, 6).alias("baseline_score"),
            signals.alias("top_signals"),
            F.array(F.lit(note)).alias("notes"),
        ),
    )
    out = df.withColumn("explainability", payload)
    if level == "top":
        out = out.withColumn("feature_contributions", F.col("explainability.top_signals"))
    return out


def _decide(df: DataFrame, threshold: float | None, model: str) -> DataFrame:
    cut = clamp_threshold(threshold)
    out = threshold_predict(df, cut).withColumns(
        {
            "is_purchased": F.coalesce("prediction", F.lit(0)).cast("bigint"),
            "decision_threshold": F.lit(round(cut, 4)),
            "model_used": F.lit(model),
        }
    )
    return out.drop("prediction")


def score_rows(
    df: DataFrame,
    threshold: float | None = None,
    level: str = "top",
    model: str = "heuristic",
) -> DataFrame:
    """Score full feature rows without a model, with contributions and explanation."""
    scored = heuristic_contributions(score_heuristic(df))
    return _decide(explain_payload(scored, "heuristic", 0.0, level), threshold, model)


def score_lite(df: DataFrame, threshold: float | None = None, level: str = "top") -> DataFrame:
    """Derive, score and grade lite rows."""
    return score_rows(feature_quality(derive_full_from_lite(df)), threshold, level)


def score_checked(
    df: DataFrame, names: list[str], threshold: float | None = None, level: str = "top"
) -> DataFrame:
    """Score a lite batch, keeping rows that break the contract with a null probability."""
    checked = check_contract(df, names)
    scored = score_lite(checked, threshold, level)
    valid = F.size("violations") == 0
    return scored.withColumns(
        {
            "probability": F.when(valid, F.col("probability")),
            "is_purchased": F.when(valid, F.col("is_purchased")).otherwise(0).cast("bigint"),
            "feature_contributions": F.when(valid, F.col("feature_contributions")),
            "explainability": F.when(valid, F.col("explainability")),
            "feature_quality": F.when(valid, F.col("feature_quality")),
        }
    )


def score_batch(
    df: DataFrame,
    model,
    importances: list[float],
    threshold: float | None = None,
    level: str = "top",
    name: str = "gbt",
) -> DataFrame:
    """Score encoded rows with a fitted MLlib pipeline; no cap on the batch.

    ``df`` holds the 26 features with categories already encoded. The model's vector output is
    turned into a plain column on the JVM.
    """
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    probability = vector_to_array("probability")[1]
    out = importance_contributions(
        scored.withColumn("_p", probability)
        .withColumn("probability", C.round_exact("_p", 4))
        .drop("_p"),
        importances,
    )
    out = _decide(explain_payload(out, "importance", 0.0, level), threshold, name)
    return out.drop("features", "rawPrediction")


def score_lookup_pairs(
    pairs: DataFrame,
    users: DataFrame,
    products: DataFrame,
    threshold: float | None = None,
    level: str = "top",
) -> tuple[DataFrame, DataFrame]:
    """(scored, not_found) for text entity pairs."""
    found, not_found = lookup_features(pairs, users, products)
    scored = score_rows(found, threshold, level)
    return scored.withColumn("feature_quality", perfect_quality()), not_found


def contribution_rows(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Contributions in long form: (key, position, feature, contribution, display_name)."""
    # The outer form, without its rows of empty lists: the inner one would first filter by the list's size, and
    # for that build every list twice.
    entry = F.posexplode_outer("feature_contributions").alias("position", "entry")
    return df.select(key, entry).filter(F.col("position").isNotNull()).select(
        key, F.col("position").cast("bigint"), *[
            F.col("entry")[f].alias(f) for f in CONTRIBUTION.fieldNames()
        ]
    )
