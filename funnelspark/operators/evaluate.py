"""Evaluation of binary predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import share
from .ordered import running_totals

# Fixed value: the smallest distance of a probability to 0 and 1 in the log loss.
EPSILON = 2.220446049250313e-16


def auc_roc(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Area under the ROC curve, one row; exact with ties.

    Classes are counted per distinct score and accumulated over a distributed sort of the scores.
    """
    scores = df.groupBy(F.col(probability).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    ranked = running_totals(scores, ["score"], {"upto": F.col("neg")})
    wins = F.col("pos") * (F.col("upto") - F.col("neg") + F.col("neg") / 2)
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.agg(F.when(pairs > 0, F.sum(wins) / pairs).alias("auc_roc"))


def binary_metrics(
    df: DataFrame,
    label: str = "actual_label",
    prediction: str = "prediction",
    probability: str = "probability",
) -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined), auc_roc and log_loss, one row.

    Rows without a label, prediction or probability are not scored and left out.
    """
    df = df.select(label, prediction, probability).dropna()
    y, hit = F.col(label) == 1, F.col(prediction) == 1
    p = F.greatest(F.least(F.col(probability), F.lit(1 - EPSILON)), F.lit(EPSILON))
    counts = df.agg(
        F.count("*").alias("n"),
        F.count_if(hit & y).alias("tp"),
        F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"),
        F.count_if(~hit & ~y).alias("tn"),
        F.avg(-F.when(y, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        share(tp + tn, F.col("n")).alias("accuracy"),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        auc_roc(df, label, probability).scalar().alias("auc_roc"),
        "log_loss",
    )


def confusion_matrix(
    df: DataFrame, label: str = "actual_label", prediction: str = "prediction"
) -> DataFrame:
    """Rows per (actual, predicted)."""
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count("*").alias("rows")
    )


def class_metrics(
    df: DataFrame, label: str = "actual_label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, f1 and support of class 0, class 1 and their plain mean ("macro")."""
    y, hit = F.col(label) == 1, F.col(prediction) == 1
    cells = df.agg(
        F.count_if(hit & y).alias("tp"),
        F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"),
        F.count_if(~hit & ~y).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def line(name: str, right, wrong, missed):
        return F.struct(
            F.lit(name).alias("class"),
            share(right, right + wrong).alias("precision"),
            share(right, right + missed).alias("recall"),
            share(2 * right, 2 * right + wrong + missed).alias("f1"),
            (right + missed).alias("support"),
        )

    both = F.array(line("0", tn, fn, fp), line("1", tp, fp, fn))
    rows = cells.select(both.alias("both"))
    macro = F.struct(
        F.lit("macro").alias("class"),
        *[
            ((F.col("both")[0][m] + F.col("both")[1][m]) / 2).alias(m)
            for m in ("precision", "recall", "f1")
        ],
        (F.col("both")[0]["support"] + F.col("both")[1]["support"]).alias("support"),
    )
    return rows.select(F.inline(F.array_append("both", macro)))


def metrics_long(metrics: DataFrame) -> DataFrame:
    """One-row metrics as (metric, value)."""
    doubles = metrics.select(*[F.col(c).cast("double").alias(c) for c in metrics.columns])
    return doubles.unpivot([], metrics.columns, "metric", "value")


def validate_thresholds(metrics: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Whether every configured metric that exists reaches its minimum; one row.

    ``metrics`` is in long form. Configured names without a value are not checked.
    """
    limits = metrics.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in minimums.items()], "metric string, minimum double"
    )
    checked = metrics.join(F.broadcast(limits), "metric")
    return checked.agg(
        F.count("*").alias("checked"),
        F.coalesce(F.bool_and(F.col("value") >= F.col("minimum")), F.lit(True)).alias("passed"),
    )


def compare_models(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per baseline metric: both values, the difference and the percent difference.

    A metric the candidate lacks counts as 0; the percent is 0 for a baseline of 0.
    """
    left = baseline.select("metric", F.col("value").alias("baseline"))
    right = candidate.select("metric", F.col("value").alias("candidate"))
    gain = F.col("candidate") - F.col("baseline")
    return (
        left.join(right, "metric", "left")
        .fillna(0.0, subset=["candidate"])
        .select(
            "metric",
            "baseline",
            "candidate",
            gain.alias("improvement"),
            F.when(F.col("baseline") != 0, gain / F.col("baseline") * 100)
            .otherwise(0.0)
            .alias("improvement_pct"),
        )
    )
