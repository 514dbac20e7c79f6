"""Queries: dataset profile, quality, conversion, exploration, run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eda, labels, profile, runs
from ..schemas import FEATURE_TABLE_COLUMNS, NUMERIC_FEATURES, TARGET
from . import tables
from .prelude import rounded
from .registry import query
from .testbed import table

EVENT_COLUMNS = [
    "event_time", "event_type", "product_id", "category_id", "category_code", "brand", "price",
    "user_id", "user_session",
]


@query(
    "event_distribution",
    f"""SELECT event_type, count(*) AS events, {rounded('count(*) / (SELECT count(*) FROM raw)::DOUBLE * 100', 'percent')}
    FROM raw GROUP BY event_type""",
)
def _(spark, sf):
    return profile.event_distribution(tables.raw(spark, sf))


def _nulls(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls,
        {rounded(f'count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE * 100', 'percent')} FROM {source}"""
        for c in columns
    )


@query("null_counts", _nulls("raw", EVENT_COLUMNS))
def _(spark, sf):
    return profile.null_counts(tables.raw(spark, sf))


@query("duplicate_count", "SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicates")
def _(spark, sf):
    return profile.duplicate_count(tables.raw(spark, sf))


@query(
    "cardinality",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values FROM raw"""
        for c in ("brand", "category_code", "user_id", "user_session")
    ),
)
def _(spark, sf):
    return profile.cardinality(
        tables.raw(spark, sf), ["brand", "category_code", "user_id", "user_session"]
    )


@query("value_counts", "SELECT user_id, count(*) AS rows FROM clean GROUP BY user_id ORDER BY rows DESC, user_id LIMIT 10")
def _(spark, sf):
    return profile.value_counts(tables.clean(spark, sf), "user_id", 10)


@query(
    "target_distribution",
    f""", c AS (SELECT is_purchased, count(*) AS n FROM samples GROUP BY 1)
    SELECT is_purchased, n AS rows, {rounded('n / (SELECT sum(n) FROM c)::DOUBLE', 'share')},
    {rounded('(SELECT max(n) FROM c) / (SELECT min(n) FROM c)::DOUBLE', 'imbalance')} FROM c""",
)
def _(spark, sf):
    return profile.target_distribution(tables.samples(spark, sf))


@query(
    "label_summary",
    f"""SELECT count(*) AS rows, sum(is_purchased)::BIGINT AS positives, (count(*) - sum(is_purchased))::BIGINT AS negatives,
    {rounded('avg(is_purchased)', 'positive_share')} FROM samples""",
)
def _(spark, sf):
    return profile.label_summary(tables.samples(spark, sf))


RAW_TYPES = {
    "event_time": "timestamp", "event_type": "string", "product_id": "bigint", "category_id": "bigint",
    "category_code": "string", "brand": "string", "price": "double", "user_id": "bigint",
    "user_session": "string",
}


@query(
    "column_profiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS missing_count,
        {rounded(f'count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE * 100', 'missing_percent')} FROM raw"""
        for c, t in RAW_TYPES.items()
    ),
)
def _(spark, sf):
    return profile.column_profiles(tables.raw(spark, sf))


@query(
    "dataset_profile",
    f"""SELECT count(*) AS rows, 9::BIGINT AS cols,
    {rounded('(' + ' + '.join(f'count(*) FILTER ({c} IS NULL)' for c in EVENT_COLUMNS) + ') / (count(*) * 9)::DOUBLE * 100', 'missing_percent')},
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate_rows, 4::BIGINT AS numeric_columns,
    5::BIGINT AS categorical_columns, 'is_purchased' AS target_column,
    epoch_us(TIMESTAMP '2024-02-01') AS last_updated_at FROM raw""",
)
def _(spark, sf):
    return profile.dataset_profile(tables.raw(spark, sf), updated_at=tables.CREATED_AT)


def _distribution_sql(source: str, column: str, bins: str) -> str:
    """Histogram by interval membership, written without the binning formula."""
    return f"""SELECT '{column}' AS "column", {rounded('s.mean', 'mean')}, {rounded('s.median', 'median')},
      {rounded('s.mn', 'min')}, {rounded('s.mx', 'max')}, b.bin AS bin,
      printf('%.2f', s.lo + b.bin * ((s.hi - s.lo) / s.n)) || '-' || printf('%.2f', s.lo + (b.bin + 1) * ((s.hi - s.lo) / s.n)) AS label,
      (SELECT count(*) FROM {source} x WHERE x.{column} >= s.lo + b.bin * ((s.hi - s.lo) / s.n)
        AND (b.bin = s.n - 1 OR x.{column} < s.lo + (b.bin + 1) * ((s.hi - s.lo) / s.n))) AS count
    FROM (SELECT avg({column}) AS mean, quantile_cont({column}::DOUBLE, 5e-1) AS median, min({column})::DOUBLE AS mn,
        max({column})::DOUBLE AS mx,
        CASE WHEN min({column}) = max({column}) THEN min({column}) - 5e-1 ELSE min({column})::DOUBLE END AS lo,
        CASE WHEN min({column}) = max({column}) THEN max({column}) + 5e-1 ELSE max({column})::DOUBLE END AS hi,
        {bins} AS n FROM {source}) s, (SELECT unnest(range(8)) AS bin) b WHERE b.bin < s.n"""


NUMERIC_COLUMNS = ["user_id", "product_id", *NUMERIC_FEATURES, TARGET]


@query(
    "numeric_distribution",
    " UNION ALL ".join(
        _distribution_sql("features", c, f"least(8, count(DISTINCT {c}))") for c in NUMERIC_COLUMNS
    ),
)
def _(spark, sf):
    return profile.numeric_distribution(tables.features(spark, sf))


def _categories(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", (SELECT count(DISTINCT coalesce(CAST({c} AS VARCHAR), '<missing>')) FROM {source}) AS unique_count,
        row_number() OVER (ORDER BY count(*) DESC, coalesce(CAST({c} AS VARCHAR), '<missing>')) AS rank,
        coalesce(CAST({c} AS VARCHAR), '<missing>') AS label, count(*) AS count FROM {source} GROUP BY 4) WHERE rank <= 6"""
        for c in columns
    )


@query("categorical_distribution", _categories("raw", ["brand", "category_code", "user_session"]))
def _(spark, sf):
    return profile.categorical_distribution(
        tables.raw(spark, sf), ["brand", "category_code", "user_session"]
    )


@query(
    "dataset_quality",
    """, f AS (SELECT * EXCLUDE (event_timestamp, created_timestamp) FROM features)
    SELECT 'duplicates' AS section, '' AS item, (SELECT count(*) FROM features)
      - (SELECT count(*) FROM (SELECT DISTINCT * FROM features)) AS value
    """
    + " ".join(
        f"""UNION ALL SELECT 'numeric', '{c} ' || bin, count FROM ({_distribution_sql('f', c, f"least(8, count(DISTINCT {c}))")})"""
        for c in NUMERIC_COLUMNS
    )
    + " ".join(
        f"""UNION ALL SELECT 'categorical', '{c} ' || label, count FROM ({_categories('f', [c])})"""
        for c in profile.QUALITY_CATEGORIES
    )
    + f""" UNION ALL SELECT 'top_missing', "column", 0 FROM (SELECT unnest({sorted(FEATURE_TABLE_COLUMNS)[:8]}) AS "column")
    UNION ALL SELECT 'drift', 'not_configured', {len(NUMERIC_COLUMNS) + 3}""",
)
def _(spark, sf):
    report = profile.dataset_quality(tables.features(spark, sf))
    named = F.concat_ws(" ", "column", F.col("bin").cast("string"))
    parts = [
        report["duplicates"].select(
            F.lit("duplicates").alias("section"), F.lit("").alias("item"), F.col("duplicates").alias("value")
        ),
        report["drift"].select(F.lit("drift"), F.col("status"), "monitored_columns"),
        report["numeric"].select(F.lit("numeric"), named, "count"),
        report["categorical"].select(F.lit("categorical"), F.concat_ws(" ", "column", "label"), "count"),
        report["top_missing"].select(F.lit("top_missing"), "column", "missing_count"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query(
    "drift_summary",
    f"SELECT 'not_configured' AS status, {len(NUMERIC_COLUMNS) + 3}::BIGINT AS monitored_columns, 0::BIGINT AS drifted_columns",
)
def _(spark, sf):
    return profile.drift_summary(tables.features(spark, sf))


@query(
    "psi",
    """, a AS (SELECT brand AS v, count(*) / (SELECT count(*) FROM predictions WHERE batch_id = 'current')::DOUBLE AS s
      FROM predictions WHERE batch_id = 'current' GROUP BY 1),
    b AS (SELECT brand AS v, count(*) / (SELECT count(*) FROM predictions WHERE batch_id = 'previous')::DOUBLE AS s
      FROM predictions WHERE batch_id = 'previous' GROUP BY 1)
    SELECT 'brand' AS "column", """
    + rounded(
        """sum((greatest(coalesce(a.s, 0), 1e-4) - greatest(coalesce(b.s, 0), 1e-4))
        * ln(greatest(coalesce(a.s, 0), 1e-4) / greatest(coalesce(b.s, 0), 1e-4)))""",
        "psi",
    )
    + " FROM a FULL JOIN b ON a.v = b.v",
)
def _(spark, sf):
    rows = tables.predictions(spark, sf)
    return profile.psi(
        rows.filter("batch_id = 'current'"), rows.filter("batch_id = 'previous'"), ["brand"]
    )


@query(
    "conversion_counts",
    """SELECT count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'cart') AS carts,
    count(*) FILTER (event_type = 'purchase') AS purchases FROM raw""",
)
def _(spark, sf):
    return profile.conversion_counts(tables.raw(spark, sf))


@query(
    "conversion_counts_features",
    """SELECT sum(product_total_views)::BIGINT AS views, count(*) AS carts, count(*) FILTER (is_purchased > 0) AS purchases
    FROM features""",
)
def _(spark, sf):
    return profile.conversion_counts(tables.features(spark, sf))


BRAND_SQL = """, brands AS (SELECT brand, count(*) AS carts, count(*) FILTER (is_purchased > 0) AS purchases
    FROM features GROUP BY brand ORDER BY carts DESC, brand LIMIT 10)"""


@query(
    "brand_conversion",
    BRAND_SQL + f" SELECT brand, carts, purchases, {rounded('purchases / carts::DOUBLE', 'conversion_rate')} FROM brands",
)
def _(spark, sf):
    return profile.brand_conversion(tables.features(spark, sf))


@query(
    "brand_conversion_estimated",
    f""", b AS (SELECT brand, count(*) AS carts, round_even(count(*) * avg(brand_purchase_rate), 0)::BIGINT AS purchases
    FROM features GROUP BY brand ORDER BY carts DESC, brand LIMIT 10)
    SELECT brand, carts, purchases, {rounded('purchases / carts::DOUBLE', 'conversion_rate')} FROM b""",
)
def _(spark, sf):
    return profile.brand_conversion(tables.features(spark, sf).drop("is_purchased"))


@query(
    "funnel_stages",
    f""", c AS (SELECT count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'cart') AS c,
      count(*) FILTER (event_type = 'purchase') AS p FROM raw)
    SELECT 1::BIGINT AS step, 'View' AS stage, v AS value, 1e0 AS rate, 1e2 AS pct_of_view FROM c
    UNION ALL SELECT 2, 'Add to Cart', c, {rounded('c / v::DOUBLE', 'rate')}, {rounded('c / v::DOUBLE * 100', 'pct')} FROM c
    UNION ALL SELECT 3, 'Purchase', p, {rounded('p / c::DOUBLE', 'rate')}, {rounded('p / v::DOUBLE * 100', 'pct')} FROM c""",
)
def _(spark, sf):
    return profile.funnel_stages(profile.conversion_counts(tables.raw(spark, sf)))


@query(
    "brand_share",
    BRAND_SQL
    + f""" SELECT brand AS name, {rounded('purchases / carts::DOUBLE', 'rate')}, carts AS volume, purchases,
    {rounded('carts / (SELECT sum(carts) FROM brands)::DOUBLE', 'share')} FROM brands ORDER BY carts DESC, brand LIMIT 5""",
)
def _(spark, sf):
    return profile.brand_share(profile.brand_conversion(tables.features(spark, sf)))


BINNED_SQL = """, delays AS (
  SELECT (epoch_us(b.event_time) - epoch_us(c.event_time)) / 1e6 / 60 AS minutes
  FROM raw c JOIN raw b ON c.user_session = b.user_session AND c.product_id = b.product_id
  WHERE c.event_type = 'cart' AND b.event_type = 'purchase'
    AND epoch_us(b.event_time) - epoch_us(c.event_time) BETWEEN 0 AND 86400000000
), binned AS (SELECT floor(minutes / 30) * 30e0 AS minute, count(*) AS volume FROM delays GROUP BY 1)"""


def _binned(spark, sf):
    latency = labels.cart_purchase_latency(tables.raw(spark, sf), 86_400)
    minute = F.floor(F.col("latency_minutes") / 30) * F.lit(30.0)
    return latency.groupBy(minute.alias("minute")).agg(F.sum("pairs").alias("volume"))


MEDIAN_SQL = """(SELECT min(minute) FROM (SELECT minute, sum(volume) OVER (ORDER BY minute) AS upto FROM binned)
    WHERE upto >= (SELECT sum(volume) FROM binned) / 2e0)"""


@query("bin_weighted_median", BINNED_SQL + f" SELECT {MEDIAN_SQL} AS median")
def _(spark, sf):
    return profile.bin_weighted_median(_binned(spark, sf))


@query(
    "histogram_stats",
    BINNED_SQL
    + f""" SELECT {rounded('sum(minute * volume) / sum(volume)', 'mean')},
    {rounded('sum(volume) FILTER (minute <= 120) / sum(volume)::DOUBLE * 100', 'within_fast_pct')},
    {rounded('avg(volume)', 'mean_volume')}, {MEDIAN_SQL} AS median FROM binned""",
)
def _(spark, sf):
    return profile.histogram_stats(_binned(spark, sf), fast=120)


@query(
    "best_bin",
    f"""SELECT event_hour, {rounded('avg(is_purchased)', 'rate')}, count(*) AS rows FROM features GROUP BY event_hour
    ORDER BY avg(is_purchased) DESC, event_hour LIMIT 1""",
)
def _(spark, sf):
    rates = eda.rate_by_dimension(tables.features(spark, sf), "event_hour")
    return profile.best_bin(rates, "event_hour", "rate")


@query(
    "dense_weekdays",
    """SELECT d.weekday, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][d.weekday + 1] AS day, count(s.user_id) AS value
    FROM (SELECT unnest(range(7)) AS weekday) d LEFT JOIN samples s ON s.event_weekday = d.weekday AND s.is_purchased = 1
    GROUP BY d.weekday""",
)
def _(spark, sf):
    return profile.dense_weekdays(tables.samples(spark, sf).filter("is_purchased = 1"))


# Exploration --------------------------------------------------------------------------------


def _described(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {rounded(f'avg({c})', 'mean')},
        {rounded(f'stddev_samp({c})', 'std')}, {rounded(f'min({c})', 'min')}, {rounded(f'max({c})', 'max')},
        {rounded(f'quantile_cont({c}::DOUBLE, 25e-2)', 'q25')}, {rounded(f'quantile_cont({c}::DOUBLE, 5e-1)', 'q50')},
        {rounded(f'quantile_cont({c}::DOUBLE, 75e-2)', 'q75')} FROM {source}"""
        for c in columns
    )


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_numeric", _described("lineitem", LINE_NUMBERS))
def _(spark, sf):
    return eda.describe_numeric(table(spark, sf, "lineitem"), LINE_NUMBERS)


def _described_text(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique",
        first(v ORDER BY n DESC, v) AS top, max(n) AS freq
        FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in columns
    )


@query("describe_categorical", _described_text("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"]))
def _(spark, sf):
    return eda.describe_categorical(
        table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]
    )


def _bins_sql(source: str, column: str, bins: int, extra: str = "", where: str = "") -> str:
    return f"""SELECT b.bin AS bin, {rounded(f's.lo + b.bin * ((s.hi - s.lo) / {bins})', 'low')},
      {rounded(f's.lo + (b.bin + 1) * ((s.hi - s.lo) / {bins})', 'high')},
      (SELECT count(*) FROM {source} x WHERE x.{column} >= s.lo + b.bin * ((s.hi - s.lo) / {bins})
        AND (b.bin = {bins - 1} OR x.{column} < s.lo + (b.bin + 1) * ((s.hi - s.lo) / {bins})){where}) AS count{extra}
    FROM (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) s, (SELECT unnest(range({bins})) AS bin) b"""


@query("histogram", _bins_sql("lineitem", "l_extendedprice", 50))
def _(spark, sf):
    return eda.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 50)


@query(
    "histogram_winsorized",
    """, clipped AS (SELECT least(price, (SELECT quantile_cont(price, 95e-2) FROM features)) AS price FROM features), h AS ("""
    + _bins_sql("clipped", "price", 30, ", (s.hi - s.lo) / 30 AS step")
    + f") SELECT bin, low, high, count, {rounded('count / (SELECT count(*) FROM clipped) / step', 'density')} FROM h",
)
def _(spark, sf):
    out = eda.histogram(tables.features(spark, sf), "price", 30, clip_high=0.95, density=True)
    return out.select("bin", "low", "high", "count", "density")


@query(
    "histogram_by_class",
    ", h AS ("
    + " UNION ALL ".join(
        f"SELECT {k}::BIGINT AS is_purchased, * FROM ("
        + _bins_sql("features", "price", 20, ", (s.hi - s.lo) / 20 AS step", f" AND x.is_purchased = {k}")
        + ")"
        for k in (0, 1)
    )
    + f""") SELECT is_purchased, bin, low, high, count,
    {rounded('count / (sum(count) OVER (PARTITION BY is_purchased))::DOUBLE / step', 'density')} FROM h""",
)
def _(spark, sf):
    return eda.histogram_by_class(tables.features(spark, sf), "price", 20)


@query(
    "box_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", """
        + ", ".join(
            rounded(f"quantile_cont({c}::DOUBLE, {p}e-2)", name)
            for name, p in (("q01", 1), ("q25", 25), ("q50", 50), ("q75", 75), ("q99", 99))
        )
        + " FROM features"
        for c in NUMERIC_FEATURES
    ),
)
def _(spark, sf):
    return eda.box_stats(tables.features(spark, sf), NUMERIC_FEATURES)


@query(
    "median_by_class",
    f"SELECT is_purchased, {rounded('quantile_cont(price, 5e-1)', 'median')} FROM features GROUP BY is_purchased",
)
def _(spark, sf):
    return eda.median_by_class(tables.features(spark, sf))


@query(
    "rate_by_dimension",
    f"SELECT event_hour, {rounded('avg(is_purchased)', 'rate')}, count(*) AS rows FROM features GROUP BY event_hour",
)
def _(spark, sf):
    return eda.rate_by_dimension(tables.features(spark, sf), "event_hour")


@query(
    "rate_by_topk",
    f"""SELECT user_id, {rounded('avg(is_purchased)', 'rate')}, count(*) AS rows FROM samples WHERE user_id IN (
    SELECT user_id FROM samples GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 20) GROUP BY user_id""",
)
def _(spark, sf):
    return eda.rate_by_topk(tables.samples(spark, sf), "user_id", 20)


@query(
    "avg_price_by_category",
    f"SELECT category_code_level1, {rounded('avg(price)', 'avg_price')} FROM samples GROUP BY category_code_level1",
)
def _(spark, sf):
    return eda.avg_price_by_category(tables.samples(spark, sf))


@query(
    "rate_pivot",
    f"""SELECT category_code_level1, brand, {rounded('avg(is_purchased)', 'rate')} FROM samples
    WHERE category_code_level1 IN (SELECT category_code_level1 FROM samples GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4)
      AND brand IN (SELECT brand FROM samples GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4)
    GROUP BY category_code_level1, brand""",
)
def _(spark, sf):
    return eda.rate_pivot(tables.samples(spark, sf), "category_code_level1", "brand", 4)


@query(
    "rate_pivot_weekday",
    "SELECT event_hour, "
    + ", ".join(
        rounded(f"avg(is_purchased) FILTER (event_weekday = {d})", f'"{d}"') for d in range(7)
    )
    + " FROM features GROUP BY event_hour",
)
def _(spark, sf):
    return eda.rate_pivot_wide(
        tables.features(spark, sf), "event_hour", "event_weekday", list(range(7))
    )


CORRELATED = [*NUMERIC_FEATURES, "is_purchased"]


def _correlations(columns) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM features" for a, b in pairs
    )


@query(
    "correlation_matrix",
    f", m AS ({_correlations(CORRELATED)}) SELECT a, b, CASE WHEN isfinite(c) THEN floor(c * 1e6 + 500001e-6) / 1e6 END AS corr FROM m",
)
def _(spark, sf):
    return eda.correlation_matrix(tables.features(spark, sf), CORRELATED)


@query(
    "target_correlation",
    f""", m AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, is_purchased) AS c FROM features" for c in NUMERIC_FEATURES)})
    (SELECT feature, floor(c * 1e6 + 500001e-6) / 1e6 AS corr, 'top' AS side FROM m WHERE isfinite(c) ORDER BY c DESC, feature LIMIT 5)
    UNION ALL (SELECT feature, floor(c * 1e6 + 500001e-6) / 1e6, 'bottom' FROM m WHERE isfinite(c) ORDER BY c, feature LIMIT 5)""",
)
def _(spark, sf):
    return eda.target_correlation(tables.features(spark, sf), NUMERIC_FEATURES, n=5)


@query(
    "collinear_pairs",
    f", m AS ({_correlations(CORRELATED)}) SELECT a, b, floor(c * 1e6 + 500001e-6) / 1e6 AS corr FROM m WHERE abs(c) > 9e-1 AND isfinite(c)",
)
def _(spark, sf):
    return eda.collinear_pairs(tables.features(spark, sf), CORRELATED)


@query(
    "mean_ratio_by_class",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, {rounded(f'avg({c}) FILTER (is_purchased = 1)', 'mean_1')},
        {rounded(f'avg({c}) FILTER (is_purchased = 0)', 'mean_0')},
        {rounded(f'avg({c}) FILTER (is_purchased = 1) / nullif(avg({c}) FILTER (is_purchased = 0), 0)', 'ratio')} FROM features"""
        for c in eda.COMPARED
    ),
)
def _(spark, sf):
    return eda.mean_ratio_by_class(tables.features(spark, sf))


def _funnel(entity: str) -> str:
    v, c, p = (f"avg({entity}_total_{what})" for what in ("views", "carts", "purchases"))
    return f"""SELECT '{entity}' AS entity, {rounded(v, 'views')}, {rounded(c, 'carts')}, {rounded(p, 'purchases')},
    {rounded(f'{c} / {v} * 100', 'view_to_cart_pct')}, {rounded(f'{p} / {c} * 100', 'cart_to_purchase_pct')},
    {rounded(f'{p} / {v} * 100', 'view_to_purchase_pct')} FROM features"""


@query("entity_funnel", _funnel("user") + " UNION ALL " + _funnel("product"))
def _(spark, sf):
    rows = tables.features(spark, sf)
    return eda.entity_funnel(rows, "user").unionByName(eda.entity_funnel(rows, "product"))


@query(
    "hourly_conversion",
    f""", h AS (SELECT hour(event_time) AS hour, avg(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) * 100 AS r
    FROM clean GROUP BY 1) SELECT hour, {rounded('r', 'rate_pct')}, hour = (SELECT hour FROM h ORDER BY r DESC, hour LIMIT 1) AS is_peak FROM h""",
)
def _(spark, sf):
    return eda.hourly_conversion(tables.clean(spark, sf))


@query(
    "latency_stats",
    BINNED_SQL
    + f""" SELECT count(*) AS pairs, {rounded('avg(minutes)', 'mean_minutes')}, {rounded('quantile_cont(minutes, 5e-1)', 'median_minutes')},
    {rounded('count(*) FILTER (minutes <= 120) / count(*)::DOUBLE * 100', 'within_fast_pct')} FROM delays""",
)
def _(spark, sf):
    return eda.latency_stats(tables.raw(spark, sf), 86_400, 120)


@query(
    "latency_histogram",
    BINNED_SQL
    + """, e AS (SELECT min(minutes) AS lo, max(minutes) AS hi FROM delays)
    SELECT b.bin, floor((e.lo + b.bin * ((e.hi - e.lo) / 50)) * 1e6 + 500001e-6) / 1e6 AS low,
    (SELECT count(*) FROM delays d WHERE least(49, floor((d.minutes - e.lo) / ((e.hi - e.lo) / 50))) = b.bin) AS count
    FROM e, (SELECT unnest(range(50)) AS bin) b""",
)
def _(spark, sf):
    return eda.latency_histogram(labels.cart_purchase_latency(tables.raw(spark, sf), 86_400))


@query(
    "flagship",
    f"""SELECT category_code_level1, {rounded('avg(is_purchased)', 'rate')}, count(*) AS rows
    FROM samples GROUP BY category_code_level1""",
)
def _(spark, sf):
    from ..operators.clean import clean_events

    samples = labels.cart_samples(clean_events(tables.raw(spark, sf)))
    return eda.rate_by_dimension(samples, "category_code_level1")


# Run history --------------------------------------------------------------------------------

RUNS_SQL = """, runs AS (
  SELECT 'run-' || user_id || '-' || strftime(event_timestamp, '%Y%m%d') AS run_id, 'train-' || product_id AS source_run_id,
    count(*) % 4 AS c, max(event_timestamp) AS end_time, min(event_timestamp) AS start_time,
    avg(price) AS price, avg(brand_purchase_rate) AS rate, count(*) AS n
  FROM features GROUP BY user_id, product_id, strftime(event_timestamp, '%Y%m%d')
), evals AS (SELECT *, CASE WHEN n = 1 THEN 'FINISHED' ELSE 'FAILED' END AS status, run_id || '-' || source_run_id AS id FROM runs)"""


def run_table(spark, sf):
    """A run per user, product and day, with metrics over its feature rows."""
    day = F.date_format("event_timestamp", "yyyyMMdd")
    grouped = tables.features(spark, sf).groupBy("user_id", "product_id", day.alias("day")).agg(
        F.count("*").alias("n"),
        F.min("event_timestamp").alias("start_time"),
        F.max("event_timestamp").alias("end_time"),
        F.avg("price").alias("price"),
        F.avg("brand_purchase_rate").alias("rate"),
    )
    source = F.concat(F.lit("train-"), F.col("product_id").cast("string"))
    run = F.concat(F.lit("run-"), F.col("user_id").cast("string"), F.lit("-"), "day")
    return grouped.select(
        F.concat_ws("-", run, source).alias("run_id"),
        source.alias("source_run_id"),
        F.lit("evaluate").alias("task"),
        F.when(F.col("n") == 1, "FINISHED").otherwise("FAILED").alias("status"),
        "start_time",
        "end_time",
        F.create_map(F.lit("price"), "price", F.lit("rate"), "rate").alias("metrics"),
        F.create_map(F.lit("source_run_id"), source).alias("tags"),
    )


@query(
    "search_runs",
    RUNS_SQL
    + f""" SELECT id AS run_id, status, {rounded('rate', 'rate')} FROM evals WHERE status = 'FINISHED' AND price > 50
    ORDER BY evals.rate DESC, id LIMIT 20""",
)
def _(spark, sf):
    found = runs.search_runs(
        run_table(spark, sf),
        (F.col("status") == "FINISHED") & (runs.metric("price") > 50),
        "rate",
        limit=20,
    )
    return found.select("run_id", "status", runs.metric("rate").alias("rate"))


@query(
    "best_run",
    RUNS_SQL + f" SELECT id AS run_id, {rounded('price', 'price')} FROM evals ORDER BY evals.price DESC, id LIMIT 1",
)
def _(spark, sf):
    return runs.best_run(run_table(spark, sf), "price").select(
        "run_id", runs.metric("price").alias("price")
    )


@query(
    "latest_eval_metric",
    RUNS_SQL
    + f""" SELECT source_run_id, id AS eval_run_id, {rounded('price', 'price')} FROM (
    SELECT *, row_number() OVER (PARTITION BY source_run_id ORDER BY end_time DESC, id DESC) AS rn FROM evals
    WHERE status = 'FINISHED') WHERE rn = 1""",
)
def _(spark, sf):
    return runs.latest_eval_metric(run_table(spark, sf), "price")


def _psi_numeric_sql(column: str) -> str:
    """Shares per bin of the even days' range, bins by counting the edges passed."""

    def shares(odd: int) -> str:
        return f"""(SELECT len(list_filter(range(1, 10), lambda k: {column} >= lo + k * ((hi - lo) / 10))) AS bin,
          count(*) / sum(count(*)) OVER ()::DOUBLE AS s FROM features,
          (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM features WHERE day(event_timestamp) % 2 = 0)
          WHERE day(event_timestamp) % 2 = {odd} GROUP BY 1)"""

    a, b = "greatest(coalesce(a.s, 0), 1e-4)", "greatest(coalesce(b.s, 0), 1e-4)"
    return f"""SELECT '{column}' AS "column", {rounded(f'sum(({a} - {b}) * ln({a} / {b}))', 'psi')}
      FROM (SELECT unnest(range(10)) AS bin) f LEFT JOIN {shares(1)} a USING (bin) LEFT JOIN {shares(0)} b USING (bin)"""


@query("psi_numeric", " UNION ALL ".join(map(_psi_numeric_sql, ["price", "activity_count"])))
def _(spark, sf):
    rows = tables.features(spark, sf)
    odd = F.dayofmonth("event_timestamp") % 2
    return profile.psi_numeric(rows.filter(odd == 1), rows.filter(odd == 0), ["price", "activity_count"])
