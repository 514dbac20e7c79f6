"""Queries: scoring, explanation and batch analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, evaluate, monitor, results, score
from ..schemas import ALL_FEATURES, NUMERIC_FEATURES
from ..session import staging_path
from ..sources import writers
from . import tables
from .prelude import rounded
from .registry import query

SIM = tables.SIMULATED
TERMS = {
    "user_cart_to_purchase_rate": "t1",
    "brand_purchase_rate": "t2",
    "product_cart_to_purchase_rate": "t3",
    "activity_count": "t4",
    "user_view_to_cart_rate": "t5",
    "price_vs_user_avg": "t6",
}
FULL_DOUBLES = [
    c for c in NUMERIC_FEATURES if c not in ("event_weekday", "event_hour")
]


def _full(spark, sf):
    return score.derive_full_from_lite(tables.lite_batch(spark, sf))


@query(
    "derive_full_from_lite",
    "SELECT row_id, event_weekday::DOUBLE AS event_weekday, event_hour::DOUBLE AS event_hour, "
    + ", ".join(rounded(c, c) for c in FULL_DOUBLES)
    + ", brand, category_code_level1, category_code_level2 FROM full_rows",
)
def _(spark, sf):
    return _full(spark, sf).select("row_id", *ALL_FEATURES)


QUALITY_SQL = """, graded AS (
  SELECT row_id, CAST(printf('%.1f', (14 / 26e0 * 6e-1
    + (user_view_to_cart_rate + product_view_to_cart_rate + brand_purchase_rate) / 3 * 4e-1) * 100) AS DOUBLE) AS score FROM full_rows
)"""


@query(
    "feature_quality",
    QUALITY_SQL
    + f""" SELECT row_id, {rounded('score', 'score')}, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B'
    WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade, 0e0 AS fallback_ratio, 12::BIGINT AS inferred_count,
    0::BIGINT AS fallback_count FROM graded""",
)
def _(spark, sf):
    return score.feature_quality(_full(spark, sf)).select("row_id", "feature_quality.*")


@query("score_heuristic", f"SELECT row_id, {rounded('score', 'probability')} FROM scored")
def _(spark, sf):
    return score.score_heuristic(_full(spark, sf)).select("row_id", "probability")


CONTRIBUTION_SQL = ", contributions AS (" + " UNION ALL ".join(
    f"""SELECT row_id, {i}::BIGINT AS position, '{f}' AS feature,
    {f"CAST(printf('%.6f', {TERMS[f]}) AS DOUBLE)" if f in TERMS else '0e0'} AS contribution,
    '{score.display_name(f)}' AS display_name, valid FROM predictions"""
    for i, f in enumerate(ALL_FEATURES)
) + ")"


@query(
    "heuristic_contributions",
    CONTRIBUTION_SQL + " SELECT row_id, position, feature, contribution, display_name FROM contributions",
)
def _(spark, sf):
    return score.contribution_rows(score.heuristic_contributions(_full(spark, sf)))


def _importances() -> list[float]:
    return [1.0 / (i + 1) for i in range(len(ALL_FEATURES))]


def _encoded(spark, sf):
    full = _full(spark, sf)
    index = encode.fit_label_index(full, ["brand", "category_code_level1", "category_code_level2"])
    return encode.label_encode(
        full, index, ["brand", "category_code_level1", "category_code_level2"]
    )


INDEXED_SQL = "".join(
    f""", ix_{c} AS (SELECT {c} AS category, row_number() OVER (ORDER BY {c}) - 1 AS i
    FROM (SELECT DISTINCT {c} FROM full_rows))"""
    for c in ("brand", "category_code_level1", "category_code_level2")
) + """, indexed AS (
  SELECT f.* REPLACE (b.i AS brand, c1.i AS category_code_level1, c2.i AS category_code_level2)
  FROM full_rows f JOIN ix_brand b ON f.brand = b.category
    JOIN ix_category_code_level1 c1 ON f.category_code_level1 = c1.category
    JOIN ix_category_code_level2 c2 ON f.category_code_level2 = c2.category
), scaled AS (SELECT *, """ + " + ".join(f"abs({c})" for c in ALL_FEATURES) + """ AS scale FROM indexed)"""


@query(
    "importance_contributions",
    INDEXED_SQL
    + " "
    + " UNION ALL ".join(
        f"""SELECT row_id, {i}::BIGINT AS position, '{f}' AS feature,
        CAST(printf('%.6f', {f}::DOUBLE / CASE WHEN scale = 0 THEN 1 ELSE scale END * (1e0 / {i + 1})) AS DOUBLE) AS contribution,
        '{score.display_name(f)}' AS display_name FROM scaled"""
        for i, f in enumerate(ALL_FEATURES)
    ),
)
def _(spark, sf):
    return score.contribution_rows(
        score.importance_contributions(_encoded(spark, sf), _importances())
    )


@query(
    "top_signals",
    CONTRIBUTION_SQL
    + """ SELECT row_id, rn AS place, feature, contribution FROM (SELECT *, row_number() OVER (
      PARTITION BY row_id ORDER BY abs(contribution) DESC, position) AS rn FROM contributions) WHERE rn <= 3""",
)
def _(spark, sf):
    rows = score.top_signals(score.heuristic_contributions(_full(spark, sf)))
    out = rows.select("row_id", F.posexplode("top_signals").alias("place", "e"))
    return out.select("row_id", (F.col("place") + 1).alias("place"), "e.feature", "e.contribution")


@query(
    "explain_payload",
    CONTRIBUTION_SQL
    + """ SELECT row_id, 'heuristic' AS method, 0e0 AS baseline_score, string_agg(feature, ',' ORDER BY rn) AS signals,
    3::BIGINT AS returned FROM (SELECT *, row_number() OVER (
      PARTITION BY row_id ORDER BY abs(contribution) DESC, position) AS rn FROM contributions) WHERE rn <= 3 GROUP BY row_id""",
)
def _(spark, sf):
    rows = score.explain_payload(score.heuristic_contributions(_full(spark, sf)))
    return rows.select(
        "row_id", "explainability.method", "explainability.baseline_score",
        F.concat_ws(",", "explainability.top_signals.feature").alias("signals"),
        F.size("feature_contributions").alias("returned"),
    )


@query(
    "score_lite",
    QUALITY_SQL
    + f""" SELECT s.row_id, {rounded('s.score', 'probability')}, CASE WHEN s.score >= 525e-3 THEN 1 ELSE 0 END::BIGINT AS is_purchased,
    525e-3 AS decision_threshold, {rounded('g.score', 'quality')} FROM scored s JOIN graded g ON s.row_id = g.row_id""",
)
def _(spark, sf):
    return score.score_lite(tables.lite_batch(spark, sf)).select(
        "row_id", "probability", "is_purchased", "decision_threshold",
        F.col("feature_quality.score").alias("quality"),
    )


@query(
    "score_checked",
    f"SELECT row_id, {rounded('probability', 'probability')}, is_purchased::BIGINT AS is_purchased FROM predictions",
)
def _(spark, sf):
    return tables.predictions(spark, sf).select("row_id", "probability", "is_purchased")


@query(
    "threshold_predict",
    "SELECT row_id, CASE WHEN probability IS NOT NULL THEN CASE WHEN probability >= 525e-3 THEN 1 ELSE 0 END END::BIGINT AS prediction FROM predictions",
)
def _(spark, sf):
    return score.threshold_predict(tables.predictions(spark, sf)).select("row_id", "prediction")


@query(
    "max_class_probability",
    f"SELECT row_id, {rounded('greatest(probability, 1 - probability)', 'class_probability')} FROM predictions",
)
def _(spark, sf):
    return score.max_class_probability(tables.predictions(spark, sf)).select(
        "row_id", "class_probability"
    )


@query(
    "batch_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (prediction = 1) AS purchased, count(*) FILTER (prediction <> 1) AS not_purchased,
    {rounded('count(*) FILTER (prediction = 1) / count(*)::DOUBLE', 'purchase_rate')},
    {rounded('avg(probability)', 'average_probability')},
    count(*) FILTER (abs(gap) >= 15e-2) AS high_confidence FROM simulated""",
)
def _(spark, sf):
    return results.batch_summary(tables.predictions(spark, sf), SIM)


@query(
    "batch_vs_previous",
    """SELECT 'current' AS batch_id, count(*) FILTER (batch_id = 'current') AS total,
    count(*) FILTER (batch_id = 'current' AND is_purchased = 1) AS purchased,
    count(*) FILTER (batch_id = 'current' AND is_purchased = 0) AS not_purchased,
    count(*) FILTER (batch_id = 'previous') AS previous_total,
    count(*) FILTER (batch_id = 'previous' AND is_purchased = 1) AS previous_purchased,
    count(*) FILTER (batch_id = 'previous' AND is_purchased = 0) AS previous_not_purchased FROM predictions""",
)
def _(spark, sf):
    return results.batch_vs_previous(tables.predictions(spark, sf), "current", "previous")


@query(
    "threshold_flip_count",
    "SELECT count(*) FILTER (probability IS NOT NULL AND prediction <> is_purchased) AS flips FROM simulated",
)
def _(spark, sf):
    return results.threshold_flip_count(tables.predictions(spark, sf), SIM)


@query(
    "probability_histogram",
    """SELECT b.bin, (b.bin * 10) || '-' || ((b.bin + 1) * 10) || '%' AS label, count(p.row_id) AS count
    FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT row_id, least(9, floor(probability * 10))::BIGINT AS bin
      FROM predictions WHERE probability IS NOT NULL) p ON b.bin = p.bin GROUP BY b.bin""",
)
def _(spark, sf):
    return results.probability_histogram(tables.predictions(spark, sf))


BAND_SQL = """CASE WHEN gap <= -15e-2 THEN 'High-conf negative' WHEN abs(gap) < 5e-2 THEN 'Near threshold'
    WHEN gap >= 15e-2 THEN 'High-conf positive' WHEN gap IS NOT NULL THEN 'Moderate confidence' END"""


@query(
    "threshold_bands",
    f"""SELECT n.band, count(s.row_id) AS count FROM (SELECT unnest(['High-conf negative', 'Near threshold',
    'Moderate confidence', 'High-conf positive']) AS band) n
    LEFT JOIN (SELECT row_id, {BAND_SQL} AS band FROM simulated) s ON n.band = s.band GROUP BY n.band""",
)
def _(spark, sf):
    return results.threshold_bands(tables.predictions(spark, sf), SIM)


@query(
    "band_insights",
    f"""SELECT {rounded("count(*) FILTER (band = 'Near threshold') / count(band)::DOUBLE * 100", 'near_threshold_pct')},
    {rounded("count(*) FILTER (band = 'High-conf positive') / count(band)::DOUBLE * 100", 'high_positive_pct')}
    FROM (SELECT {BAND_SQL} AS band FROM simulated)""",
)
def _(spark, sf):
    return results.band_insights(tables.predictions(spark, sf), SIM)


DECILE_SQL = """, deciled AS (
  SELECT row_id, prediction, rn, CAST(floor((rn - 1) / greatest(1, ceil(n / 10e0))) + 1 AS BIGINT) AS decile FROM (
    SELECT row_id, prediction, row_number() OVER (ORDER BY probability DESC, row_id) AS rn, count(*) OVER () AS n
    FROM simulated WHERE probability IS NOT NULL)
)"""


@query("score_deciles", DECILE_SQL + " SELECT row_id, rn AS rank, decile FROM deciled")
def _(spark, sf):
    slim = tables.predictions(spark, sf).select("row_id", "probability")
    return results.score_deciles(slim).select("row_id", "rank", "decile")


@query(
    "decile_performance",
    DECILE_SQL
    + f""" SELECT 'D' || decile AS decile, count(*) AS rows,
    {rounded('count(*) FILTER (prediction = 1) / count(*)::DOUBLE * 100', 'purchase_rate')} FROM deciled GROUP BY deciled.decile""",
)
def _(spark, sf):
    return results.decile_performance(tables.predictions(spark, sf), SIM)


@query(
    "calibration",
    f"""SELECT 'B' || (b.bin + 1) AS bin, b.bin * 10 + 5 AS predicted_rate,
    {rounded('CASE WHEN count(p.row_id) > 0 THEN coalesce(sum(p.actual_label), 0) / count(p.row_id)::DOUBLE * 100 ELSE 0 END', 'actual_rate')},
    count(p.row_id) AS count
    FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN (SELECT row_id, actual_label, least(9, floor(probability * 10))::BIGINT AS bin
      FROM predictions WHERE probability IS NOT NULL) p ON b.bin = p.bin GROUP BY b.bin""",
)
def _(spark, sf):
    return results.calibration(tables.predictions(spark, sf))


@query(
    "confusion_at_threshold",
    f""", cells AS (SELECT count(*) FILTER (prediction = 1 AND actual_label = 1) AS tp,
      count(*) FILTER (prediction = 1 AND actual_label = 0) AS fp, count(*) FILTER (prediction = 0 AND actual_label = 0) AS tn,
      count(*) FILTER (prediction = 0 AND actual_label = 1) AS fn FROM simulated WHERE probability IS NOT NULL)
    SELECT tp, fp, tn, fn, {rounded('CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END', 'precision')},
    {rounded('CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END', 'recall')},
    {', '.join(rounded(f'{c} / greatest(1, tp, fp, tn, fn)::DOUBLE', f'{c}_intensity') for c in ('tp', 'fp', 'tn', 'fn'))}
    FROM cells""",
)
def _(spark, sf):
    return results.confusion_at_threshold(tables.predictions(spark, sf), SIM)


@query(
    "global_importance",
    CONTRIBUTION_SQL
    + f""" SELECT feature, display_name AS label, {rounded('m', 'mean_abs_contribution')} FROM (
    SELECT feature, display_name, avg(abs(contribution)) AS m FROM contributions WHERE valid GROUP BY ALL
    ORDER BY m DESC, feature LIMIT 10)""",
)
def _(spark, sf):
    return results.global_importance(tables.predictions(spark, sf))


@query(
    "row_waterfall",
    CONTRIBUTION_SQL
    + """ SELECT feature, display_name AS label, contribution FROM contributions
    WHERE valid AND row_id = (SELECT min(row_id) FROM predictions WHERE valid)
    ORDER BY abs(contribution) DESC, position LIMIT 12""",
)
def _(spark, sf):
    rows = tables.predictions(spark, sf)
    first = rows.filter("probability is not null").agg(F.min("row_id")).scalar()
    return results.row_waterfall(rows, first, 12)


@query(
    "compare_contributions",
    CONTRIBUTION_SQL
    + """, ends AS (SELECT min(row_id) AS lo, max(row_id) AS hi FROM predictions WHERE valid)
    SELECT a.feature, a.display_name AS label, a.contribution AS selected, b.contribution AS pinned,
    floor(abs(a.contribution - b.contribution) * 1e6 + 500001e-6) / 1e6 AS delta
    FROM contributions a JOIN contributions b ON a.feature = b.feature, ends
    WHERE a.row_id = ends.lo AND b.row_id = ends.hi
    ORDER BY abs(a.contribution - b.contribution) DESC, a.feature LIMIT 8""",
)
def _(spark, sf):
    rows = tables.predictions(spark, sf)
    valid = rows.filter("probability is not null")
    return results.compare_contributions(
        rows, valid.agg(F.min("row_id")).scalar(), valid.agg(F.max("row_id")).scalar()
    )


@query(
    "feature_key_union",
    CONTRIBUTION_SQL + " SELECT DISTINCT feature FROM contributions WHERE valid",
)
def _(spark, sf):
    rows = tables.predictions(spark, sf)
    valid = rows.filter("probability is not null")
    return results.feature_key_union(
        rows, valid.agg(F.min("row_id")).scalar(), valid.agg(F.max("row_id")).scalar()
    )


@query(
    "explanation_coverage",
    f"""SELECT count(*) FILTER (valid) AS rows_with_full, 0::BIGINT AS rows_with_top_only,
    {rounded('count(*) FILTER (valid) / count(*)::DOUBLE * 100', 'coverage_pct')}, 0e0 AS fallback_pct FROM predictions""",
)
def _(spark, sf):
    return results.explanation_coverage(tables.predictions(spark, sf))


@query(
    "predicted_rate",
    f"SELECT {rounded('count(*) FILTER (prediction = 1) / count(*)::DOUBLE * 100', 'predicted_rate')} FROM simulated WHERE probability IS NOT NULL",
)
def _(spark, sf):
    return results.predicted_rate(tables.predictions(spark, sf), SIM)


def _cohort_sql(field: str, order: str, name: str) -> str:
    return f""", grouped AS (
  SELECT coalesce(nullif(CAST({field} AS VARCHAR), ''), 'Unknown') AS cohort, count(*) AS n, sum(prediction) AS hits,
    coalesce(avg(probability), 0) * count(*) AS weighted FROM simulated GROUP BY 1
), ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS groups FROM grouped),
named AS (SELECT *, CASE WHEN groups <= 8 OR rn <= 7 THEN rn ELSE 8 END AS position,
  CASE WHEN groups <= 8 OR rn <= 7 THEN {name} ELSE 'Others' END AS label FROM ranked)
SELECT position, label AS cohort, sum(n)::BIGINT AS count, {rounded('sum(hits)::DOUBLE / sum(n)::DOUBLE * 100', 'predicted_rate')},
  {rounded('sum(weighted) / sum(n)::DOUBLE * 100', 'avg_probability')} FROM named GROUP BY position, label"""


@query("cohort_breakdown", _cohort_sql("brand", "n DESC, cohort", "cohort"))
def _(spark, sf):
    return results.cohort_breakdown(tables.predictions(spark, sf), "brand", SIM)


@query("cohort_breakdown_users", _cohort_sql("user_id", "n DESC, cohort", "cohort"))
def _(spark, sf):
    return results.cohort_breakdown(tables.predictions(spark, sf), "user_id", SIM)


@query(
    "cohort_breakdown_weekday",
    _cohort_sql(
        "event_weekday", "CAST(cohort AS BIGINT), n DESC",
        "['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][CAST(cohort AS BIGINT) + 1]",
    ),
)
def _(spark, sf):
    rows = tables.predictions(spark, sf)
    rows = rows.withColumn("event_weekday", F.col("event_weekday").cast("bigint").cast("string"))
    return results.cohort_breakdown(rows, "event_weekday", SIM)


@query(
    "weekday_label",
    "SELECT row_id, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][event_weekday + 1] AS day FROM lite",
)
def _(spark, sf):
    rows = tables.lite_batch(spark, sf)
    text = F.col("event_weekday").cast("bigint").cast("string")
    zero = rows.agg(F.max((text == "0").cast("int"))).scalar() == 1
    return rows.select("row_id", results.weekday_label(text, zero).alias("day"))


SEGMENT_SQL = """, tagged AS (
  SELECT row_id, 'drop' AS segment FROM simulated WHERE gap <= -15e-2
  UNION ALL SELECT row_id, 'hesitant' FROM simulated WHERE gap >= 0 AND gap < 15e-2
  UNION ALL SELECT row_id, 'converters' FROM simulated WHERE gap >= 15e-2
  UNION ALL SELECT row_id, 'unknown' FROM simulated WHERE abs(gap) < 5e-2
)"""


@query(
    "action_segments",
    SEGMENT_SQL
    + """ SELECT s.segment, count(t.row_id) AS count FROM (SELECT unnest(['drop', 'hesitant', 'converters', 'unknown']) AS segment) s
    LEFT JOIN tagged t ON s.segment = t.segment GROUP BY s.segment""",
)
def _(spark, sf):
    return results.action_segments(tables.predictions(spark, sf), SIM)


@query(
    "export_segment",
    f"SELECT row_id AS row, is_purchased::BIGINT AS is_purchased, {rounded('probability', 'probability')} FROM simulated WHERE gap >= 0 AND gap < 15e-2",
)
def _(spark, sf):
    path = staging_path(spark, "segment-csv")
    segment = results.export_segment(tables.predictions(spark, sf), "hesitant", SIM)
    writers.write_csv(segment, path, quote_all=True)
    return spark.read.schema(segment.schema).option("header", True).csv(path)


@query(
    "export_filtered",
    f"""SELECT row_id AS row, is_purchased::BIGINT AS original_is_purchased, prediction::BIGINT AS simulated_is_purchased,
    {rounded('probability', 'probability')}, '0.6500' AS threshold_applied FROM simulated WHERE prediction = 1 AND probability <= 8e-1""",
)
def _(spark, sf):
    return results.export_filtered(
        tables.predictions(spark, sf), simulated=SIM, show="purchased", high=0.8
    )


@query(
    "filter_results",
    "SELECT row_id FROM simulated WHERE prediction = 1 AND probability BETWEEN 6e-1 AND 75e-2 AND contains(CAST(row_id AS VARCHAR), '7')",
)
def _(spark, sf):
    # Bounds are given the wrong way round on purpose.
    return results.filter_results(
        tables.predictions(spark, sf), "purchased", 0.75, 0.6, "7", simulated=SIM
    ).select("row_id")


@query(
    "page_results",
    f"""SELECT row_id, {rounded('probability', 'probability')} FROM predictions ORDER BY probability DESC NULLS LAST, row_id
    LIMIT 10 OFFSET 20""",
)
def _(spark, sf):
    rows = tables.predictions(spark, sf).select("row_id", "probability")
    return results.page_results(rows, [F.desc_nulls_last("probability"), "row_id"], page=3)


@query(
    "page_results_indexed",
    f"""SELECT row_id, {rounded('probability', 'probability')} FROM predictions ORDER BY probability DESC NULLS LAST, row_id
    LIMIT 20 OFFSET 980""",
)
def _(spark, sf):
    rows = tables.predictions(spark, sf).select("row_id", "probability")
    return results.index_results(rows, [F.desc_nulls_last("probability")]).page(page=50, size=20)


# Evaluation ---------------------------------------------------------------------------------


def _evaluated(spark, sf, cut=SIM):
    rows = tables.predictions(spark, sf).filter("probability is not null")
    return score.threshold_predict(rows, cut).select(
        "row_id", "actual_label", "probability", "prediction"
    )


METRICS_SQL = """, judged AS (SELECT actual_label AS y, probability AS p, prediction AS h FROM simulated WHERE probability IS NOT NULL),
cells AS (SELECT count(*) AS n, count(*) FILTER (h = 1 AND y = 1) AS tp, count(*) FILTER (h = 1 AND y = 0) AS fp,
  count(*) FILTER (h = 0 AND y = 1) AS fn, count(*) FILTER (h = 0 AND y = 0) AS tn,
  avg(-(CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16))
    ELSE ln(1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) END)) AS log_loss FROM judged),
ranks AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS mid FROM judged),
curve AS (SELECT (sum(mid) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE AS auc FROM ranks),
metrics AS (SELECT (tp + tn) / n::DOUBLE AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS "precision",
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1, auc AS auc_roc, log_loss FROM cells, curve)"""
METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "auc_roc", "log_loss"]


@query(
    "binary_metrics",
    METRICS_SQL + " SELECT " + ", ".join(rounded(f'"{m}"', f'"{m}"') for m in METRIC_NAMES) + " FROM metrics",
)
def _(spark, sf):
    return evaluate.binary_metrics(_evaluated(spark, sf))


@query(
    "binary_metrics_with_unscored",
    METRICS_SQL + " SELECT " + ", ".join(rounded(f'"{m}"', f'"{m}"') for m in METRIC_NAMES) + " FROM metrics",
)
def _(spark, sf):
    rows = _evaluated(spark, sf)
    unscored = rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in ("probability", "prediction")})
    return evaluate.binary_metrics(rows.unionByName(unscored))


LONG_SQL = METRICS_SQL + ", long AS (" + " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, "{m}" AS value FROM metrics""" for m in METRIC_NAMES
) + ")"


@query("metrics_long", LONG_SQL + f" SELECT metric, {rounded('value', 'value')} FROM long")
def _(spark, sf):
    return evaluate.metrics_long(evaluate.binary_metrics(_evaluated(spark, sf)))


@query(
    "validate_thresholds",
    LONG_SQL
    + """ SELECT count(*) AS checked, bool_and(value >= minimum) AS passed FROM long
    JOIN (VALUES ('accuracy', 1e-2), ('recall', 3e-1), ('absent', 9e-1)) t(metric, minimum) USING (metric)""",
)
def _(spark, sf):
    long = evaluate.metrics_long(evaluate.binary_metrics(_evaluated(spark, sf)))
    return evaluate.validate_thresholds(long, {"accuracy": 0.01, "recall": 0.3, "absent": 0.9})


def _cell_metrics(hit: str) -> str:
    return f"""SELECT count(*) AS n, count(*) FILTER ({hit} AND y = 1) AS tp, count(*) FILTER ({hit} AND y = 0) AS fp,
      count(*) FILTER (NOT ({hit}) AND y = 1) AS fn, count(*) FILTER (NOT ({hit}) AND y = 0) AS tn FROM judged"""


def _simple(metric: str, source: str) -> str:
    value = {
        "accuracy": "(tp + tn) / n::DOUBLE",
        "precision": "CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END",
        "recall": "CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END",
    }[metric]
    return f"(SELECT {value} FROM {source})"


@query(
    "compare_models",
    METRICS_SQL
    + f", base AS ({_cell_metrics('p >= 65e-2')}), cand AS ({_cell_metrics('p >= 7e-1')}), sides AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {_simple(m, 'base')} AS baseline, {_simple(m, 'cand')} AS candidate"
        for m in ("accuracy", "precision", "recall")
    )
    + f""") SELECT metric, {rounded('baseline', 'baseline')}, {rounded('candidate', 'candidate')},
    {rounded('candidate - baseline', 'improvement')},
    {rounded('CASE WHEN baseline <> 0 THEN (candidate - baseline) / baseline * 100 ELSE 0 END', 'improvement_pct')} FROM sides""",
)
def _(spark, sf):
    sides = []
    for cut in (SIM, tables.BATCH_THRESHOLD):
        metrics = evaluate.binary_metrics(_evaluated(spark, sf, cut))
        sides.append(evaluate.metrics_long(metrics.select("accuracy", "precision", "recall")))
    return evaluate.compare_models(*sides)


@query(
    "class_metrics",
    METRICS_SQL
    + f""", per AS (
      SELECT '1' AS class, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r,
        CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f, tp + fn AS support FROM cells
      UNION ALL SELECT '0', CASE WHEN tn + fn > 0 THEN tn / (tn + fn)::DOUBLE ELSE 0 END,
        CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END,
        CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn)::DOUBLE ELSE 0 END, tn + fp FROM cells
    ), total AS (SELECT * FROM per UNION ALL SELECT 'macro', avg(p), avg(r), avg(f), sum(support)::BIGINT FROM per)
    SELECT class, {rounded('p', '"precision"')}, {rounded('r', 'recall')}, {rounded('f', 'f1')}, support FROM total""",
)
def _(spark, sf):
    return evaluate.class_metrics(_evaluated(spark, sf))


@query(
    "confusion_matrix",
    METRICS_SQL + " SELECT y AS actual, h::BIGINT AS predicted, count(*) AS rows FROM judged GROUP BY ALL",
)
def _(spark, sf):
    return evaluate.confusion_matrix(_evaluated(spark, sf))


@query(
    "auc_roc",
    """, judged AS (SELECT l.quality AS y, length(d.text)::DOUBLE AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    ranks AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS mid FROM judged)
    SELECT """
    + rounded(
        """(sum(mid) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0)
        / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE""",
        "auc_roc",
    )
    + " FROM ranks",
)
def _(spark, sf):
    from .testbed import table

    docs = table(spark, sf, "documents").select("doc_id", F.length("text").cast("double").alias("size"))
    return evaluate.auc_roc(table(spark, sf, "labels").join(docs, "doc_id"), "quality", "size")


# Monitoring ---------------------------------------------------------------------------------

LOG_SQL = """, log AS (SELECT CASE event_weekday % 3 WHEN 0 THEN 'xgboost' WHEN 1 THEN 'lightgbm' ELSE 'catboost' END AS model,
    valid AS success FROM predictions)"""


def _log(spark, sf):
    day = F.col("event_weekday").cast("bigint") % 3
    model = F.when(day == 0, "xgboost").when(day == 1, "lightgbm").otherwise("catboost")
    return tables.predictions(spark, sf).select(
        model.alias("model"), F.col("probability").isNotNull().alias("success"), "feature_quality"
    )


@query(
    "prediction_stats",
    LOG_SQL
    + """ SELECT CASE WHEN grouping(model) = 1 THEN 'all' ELSE model END AS model, count(*) AS total,
    count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed,
    CAST(printf('%.1f', count(*) FILTER (success) / count(*)::DOUBLE * 100) AS DOUBLE) AS success_rate FROM log GROUP BY ROLLUP (model)""",
)
def _(spark, sf):
    return monitor.prediction_stats(_log(spark, sf))


@query(
    "fallback_ratio",
    "SELECT 0e0 AS fallback_ratio, count(*) FILTER (valid) AS sample_size FROM predictions",
)
def _(spark, sf):
    return monitor.fallback_ratio(_log(spark, sf))
