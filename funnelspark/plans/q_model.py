"""Queries: training, tuning and model scoring.

What a learner finds cannot be said in SQL, what must hold of it can: the queries return that as booleans.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import encode, ml, score, split
from ..operators.features import agg_user
from ..schemas import DECISION_THRESHOLD, ALL_FEATURES, CATEGORICAL_FEATURES, NUMERIC_FEATURES, TARGET
from . import tables
from .q_features import KEYS, feature_rows
from .registry import query

SMALL = {
    "random_forest": {"numTrees": 10, "maxDepth": 5, "seed": 42},
    "decision_tree": {"maxDepth": 5},
    "logistic_regression": {"maxIter": 20},
    "gradient_boosting": {"maxIter": 5, "maxDepth": 3, "seed": 42},
}


def prepared(spark, sf):
    """Encoded feature rows with part and fold; the encoder is fitted on train rows only."""

    def build():
        rows = feature_rows(spark, sf)
        parts = split.split_three_way(rows, KEYS, TARGET)
        encoders = encode.fit_target_encoder(parts.filter("part = 'train'"))
        ready = encode.apply_target_encoder(parts, encoders, CATEGORICAL_FEATURES)
        folded = split.stratified_folds(ready, KEYS, TARGET, k=5)
        numeric = {c: F.col(c).cast("double") for c in NUMERIC_FEATURES}
        return folded.withColumns(numeric).select(*KEYS, *ALL_FEATURES, TARGET, "part", "fold")

    return tables.published(spark, sf, "prepared", build)


def _parts(spark, sf):
    rows = prepared(spark, sf)
    return [rows.filter(F.col("part") == p) for p in ("train", "val", "test")]


def _trained(spark, sf, model_type="gradient_boosting"):
    train, _val, test = _parts(spark, sf)
    return ml.train_classifier(train, test, model_type, SMALL[model_type])


MODELS_SQL = f"(VALUES {', '.join(f'({chr(39)}{m}{chr(39)})' for m in SMALL)}) m(model)"
METRICS = ["accuracy", "precision", "recall", "f1", "auc_roc"]


def _in_range(names: list[str]):
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).between(0, 1)
    return ok


def _majority(df):
    """Share of the more frequent class."""
    share = F.avg(F.col(TARGET).cast("double"))
    return df.agg(F.greatest(share, 1 - share)).scalar()


@query(
    "train_classifier",
    f"""SELECT model, part, true AS in_range, true AS near_majority_or_better FROM {MODELS_SQL},
    (VALUES ('train'), ('test')) p(part)""",
)
def _(spark, sf):
    """Every model is at least about as accurate as always naming the more frequent class."""
    train, _val, test = _parts(spark, sf)
    least = F.when(F.col("part") == "train", _majority(train)).otherwise(_majority(test)) - 0.02
    out = None
    for model_type, params in SMALL.items():
        fitted = ml.train_classifier(train, test, model_type, params)
        rows = fitted.metrics.withColumn("model", F.lit(model_type))
        out = rows if out is None else out.unionByName(rows)
    return out.select(
        "model", "part", _in_range(["accuracy"]).alias("in_range"),
        (F.col("accuracy") >= least).alias("near_majority_or_better"),
    )


@query("top_importances", "SELECT unnest(range(1, 11)) AS place, true AS is_feature, true AS in_order, true AS in_range")
def _(spark, sf):
    """Ten different features, in descending order; importances add up to one at most."""
    top = ml.top_importances(spark, _trained(spark, sf))
    order = Window.orderBy(F.desc("importance"), "feature")
    listed = top.withColumn("place", F.row_number().over(order).cast("bigint"))
    before = F.lag("importance", 1, 1.0).over(order)
    return listed.select(
        "place", F.col("feature").isin(ALL_FEATURES).alias("is_feature"),
        (F.col("importance") <= before).alias("in_order"), F.col("importance").between(0, 1).alias("in_range"),
    )


@query(
    "tune_regularization",
    """SELECT c, true AS in_range, true AS penalty_falls_with_c, true AS one_is_best
    FROM (VALUES (1e-3), (1e-2), (1e-1), (1e0), (1e1), (1e2)) v(c)""",
)
def _(spark, sf):
    train, val, _test = _parts(spark, sf)
    found = ml.tune_regularization(train, val)
    whole = found.agg(
        F.count_if("is_best").alias("n"), F.max("auc_roc").alias("top"),
        F.max(F.when(F.col("is_best"), F.col("auc_roc"))).alias("got"),
        F.max(F.col("c") * F.col("reg_param")).alias("unit"),
    )
    return found.join(F.broadcast(whole)).select(
        "c", _in_range(["auc_roc"]).alias("in_range"),
        (F.abs(F.col("c") * F.col("reg_param") / F.col("unit") - 1) < 1e-9).alias("penalty_falls_with_c"),
        ((F.col("n") == 1) & (F.col("top") == F.col("got"))).alias("one_is_best"),
    )


TRIALS, FOLDS = 20, 5


@query(
    "search_params_cv",
    f"""SELECT unnest(range({TRIALS})) AS trial, true AS in_range, true AS folds_as_stopped, true AS best_is_finished,
    true AS half_stopped_early""",
)
def _(spark, sf):
    """Trials end where they fall behind; the best has seen all folds and has the highest mean of those that did."""
    found = ml.search_params_cv(prepared(spark, sf).filter("part <> 'test'"), "fold", FOLDS, trials=TRIALS)
    done = F.col("stopped_after").isNull()
    whole = found.agg(
        F.max(F.when(done, F.col("mean_f1"))).alias("top"),
        F.max(F.when(F.col("is_best") & done, F.col("mean_f1"))).alias("got"),
        F.count_if("is_best").alias("n"),
        F.count_if(F.col("stopped_after") < FOLDS).alias("stopped"),
    )
    return found.join(F.broadcast(whole)).select(
        "trial",
        (_in_range(["mean_f1"]) & (F.col("std_f1") >= 0)).alias("in_range"),
        (F.col("folds") == F.coalesce("stopped_after", F.lit(FOLDS))).alias("folds_as_stopped"),
        ((F.col("n") == 1) & (F.col("top") == F.col("got"))).alias("best_is_finished"),
        (F.col("stopped") >= TRIALS // 2).alias("half_stopped_early"),
    )


@query("benchmark_models", f"SELECT model, true AS in_range, true AS took_time FROM {MODELS_SQL}")
def _(spark, sf):
    train, _val, test = _parts(spark, sf)
    found = ml.benchmark_models(train, test, SMALL)
    return found.select(
        "model", (_in_range(METRICS) & (F.col("log_loss") >= 0)).alias("in_range"), (F.col("train_seconds") > 0).alias("took_time")
    )


@query(
    "train_classifier_weighted",
    """SELECT 'logistic_regression' AS model, count(*) > 0 AS weights_even_the_classes, true AS recall_does_not_fall
    FROM features""",
)
def _(spark, sf):
    """Balanced class weights add up to the same for both classes, and find no fewer purchases."""
    train, _val, test = _parts(spark, sf)
    weighted = ml.with_class_weight(train)
    even = weighted.agg(
        F.abs(F.sum(F.when(F.col(TARGET) == 1, F.col("class_weight")).otherwise(-F.col("class_weight")))) < 1e-6
    ).scalar()
    kind = "logistic_regression"
    recall = [
        ml.evaluate_model(
            ml.train_classifier(weighted, test, kind, SMALL[kind], weight=w).model, test
        ).select("recall").scalar()
        for w in (None, "class_weight")
    ]
    return spark.range(1).select(
        F.lit(kind).alias("model"),
        even.alias("weights_even_the_classes"),
        (recall[1] >= recall[0]).alias("recall_does_not_fall"),
    )


@query("refit_and_evaluate", "SELECT true AS in_range, true AS near_majority_or_better")
def _(spark, sf):
    train, val, test = _parts(spark, sf)
    found = ml.refit_and_evaluate(train, val, test, "random_forest", SMALL["random_forest"])[1]
    return found.select(
        (_in_range(METRICS) & (F.col("log_loss") >= 0)).alias("in_range"),
        (F.col("accuracy") >= _majority(test) - 0.02).alias("near_majority_or_better"),
    )


@query(
    "score_batch",
    f"""SELECT user_id, product_id, true AS in_range, true AS label_follows,
    {DECISION_THRESHOLD}::DOUBLE AS decision_threshold, true AS explained FROM features""",
)
def _(spark, sf):
    fitted = _trained(spark, sf)
    rows = score.score_batch(prepared(spark, sf), fitted.model, ml.importances(fitted))
    p = F.col("probability")
    return rows.select(
        "user_id",
        "product_id",
        p.between(0, 1).alias("in_range"),
        (F.col("is_purchased") == (p >= F.col("decision_threshold")).cast("int")).alias("label_follows"),
        "decision_threshold",
        (F.size("explainability.top_signals.feature") > 0).alias("explained"),
    )


@query(
    "agg_user_approximate",
    """SELECT user_id, user_total_events, user_total_views, user_total_carts, user_total_purchases, true AS close
    FROM agg_user""",
)
def _(spark, sf):
    """Exact totals; distinct counts within a tenth of the exact ones."""
    events = tables.raw(spark, sf)
    exact = agg_user(events).select(
        "user_id", *[F.col(c).alias(f"_{c}") for c in ("user_unique_products", "user_unique_categories")]
    )
    both = agg_user(events, approximate=True).join(exact, "user_id")
    close = F.lit(True)
    for c in ("user_unique_products", "user_unique_categories"):
        close = close & (F.abs(F.col(c) - F.col(f"_{c}")) <= F.greatest(F.lit(1), F.col(f"_{c}") / 10))
    return both.select(
        "user_id", "user_total_events", "user_total_views", "user_total_carts", "user_total_purchases",
        close.alias("close"),
    )
