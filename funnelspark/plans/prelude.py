"""Common SQL of the comparison queries: the same tables, derived a second, independent way."""

PRELUDE = """
WITH mapped AS (
  SELECT e.event_id, e.ts AS event_time,
    CASE e.event_type WHEN 'signup' THEN 'view' WHEN 'click' THEN 'cart'
      WHEN 'error' THEN 'remove_from_cart' ELSE e.event_type END AS event_type,
    CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) % 10 AS product_id,
    e.event_id % 17 = 0 AS no_brand, e.value AS price, e.user_id,
    CASE WHEN e.event_id % 101 = 0 THEN 'NULL'
      ELSE e.user_id || '-' || strftime(date_trunc('week', e.ts), '%Y-%m-%d') END AS user_session
  FROM events e
), joined AS (
  SELECT m.event_id, m.event_time, m.event_type, m.product_id,
    CAST(p.p_size AS BIGINT) AS category_id,
    CASE WHEN p.p_size % 7 = 0 THEN NULL WHEN p.p_size % 3 = 0 THEN lower(p.p_type)
      ELSE lower(p.p_type) || '.' || lower(regexp_extract(p.p_name, '([^ ]*)$', 1)) END AS category_code,
    CASE WHEN m.no_brand THEN NULL ELSE lower(p.p_brand) END AS brand,
    m.price, m.user_id, m.user_session
  FROM mapped m JOIN part p ON p.p_partkey = m.product_id
), raw AS (
  SELECT * EXCLUDE (event_id) FROM joined
  UNION ALL
  SELECT * EXCLUDE (event_id) FROM joined WHERE event_id % 50 = 0
), clean AS (
  SELECT event_time, event_type, product_id, category_id,
    coalesce(lower(category_code), 'unknown') AS category_code,
    coalesce(lower(brand), 'unknown') AS brand, price, user_id, user_session
  FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, user_session, event_time, event_type, product_id
      ORDER BY category_id NULLS FIRST, category_code NULLS FIRST, brand NULLS FIRST, price NULLS FIRST) AS rn
    FROM raw)
  WHERE rn = 1 AND user_session IS NOT NULL AND user_session <> 'NULL'
), credits AS (
  SELECT user_id, product_id, user_session, purchase_time, cart_time, ranked FROM (
    SELECT b.user_id, b.product_id, b.user_session, b.event_time AS purchase_time, c.event_time AS cart_time,
      row_number() OVER (PARTITION BY b.user_id, b.product_id, b.user_session, b.event_time
        ORDER BY c.event_time DESC) AS rn,
      count(*) OVER (PARTITION BY b.user_id, b.product_id, b.user_session, b.event_time) AS ranked
    FROM clean b JOIN clean c ON b.user_id = c.user_id AND b.product_id = c.product_id
      AND b.user_session = c.user_session AND c.event_time < b.event_time
    WHERE b.event_type = 'purchase' AND c.event_type = 'cart')
  WHERE rn = 1
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY user_session ORDER BY event_time, event_type, product_id, user_id
    ROWS UNBOUNDED PRECEDING) AS activity_count
  FROM clean
), labelled AS (
  SELECT c.*, CAST(CASE WHEN h.user_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS is_purchased
  FROM counted c LEFT JOIN (SELECT DISTINCT user_id, product_id, user_session, cart_time FROM credits) h
    ON c.user_id = h.user_id AND c.product_id = h.product_id AND c.user_session = h.user_session
      AND c.event_time = h.cart_time
  WHERE c.event_type = 'cart'
), samples AS (
  SELECT event_time, user_id, product_id, string_split(category_code, '.')[1] AS category_code_level1,
    coalesce(string_split(category_code, '.')[2], 'unknown') AS category_code_level2, brand,
    CAST(isodow(event_time) - 1 AS BIGINT) AS event_weekday, price,
    CAST(activity_count AS BIGINT) AS activity_count, is_purchased
  FROM labelled
), user_base AS (
  SELECT user_id, count(*) AS user_total_events,
    count(*) FILTER (event_type = 'view') AS user_total_views,
    count(*) FILTER (event_type = 'cart') AS user_total_carts,
    count(*) FILTER (event_type = 'purchase') AS user_total_purchases,
    coalesce(avg(price) FILTER (event_type = 'purchase'), 0.0) AS user_avg_purchase_price,
    count(DISTINCT product_id) AS user_unique_products,
    count(DISTINCT lower(coalesce(string_split(category_code, '.')[1], 'unknown'))) AS user_unique_categories
  FROM raw GROUP BY user_id
), agg_user AS (
  SELECT *,
    CASE WHEN user_total_views > 0 THEN user_total_carts / user_total_views::DOUBLE ELSE 0.0::DOUBLE END AS user_view_to_cart_rate,
    CASE WHEN user_total_carts > 0 THEN user_total_purchases / user_total_carts::DOUBLE ELSE 0.0::DOUBLE END AS user_cart_to_purchase_rate
  FROM user_base
), product_base AS (
  SELECT product_id, count(*) AS product_total_events,
    count(*) FILTER (event_type = 'view') AS product_total_views,
    count(*) FILTER (event_type = 'cart') AS product_total_carts,
    count(*) FILTER (event_type = 'purchase') AS product_total_purchases,
    count(DISTINCT user_id) FILTER (event_type = 'purchase') AS product_unique_buyers
  FROM raw GROUP BY product_id
), agg_product AS (
  SELECT *,
    CASE WHEN product_total_views > 0 THEN product_total_carts / product_total_views::DOUBLE ELSE 0.0::DOUBLE END AS product_view_to_cart_rate,
    CASE WHEN product_total_carts > 0 THEN product_total_purchases / product_total_carts::DOUBLE ELSE 0.0::DOUBLE END AS product_cart_to_purchase_rate
  FROM product_base
), brand_base AS (
  SELECT coalesce(lower(brand), 'unknown') AS brand_clean,
    count(*) FILTER (event_type = 'purchase') AS brand_total_purchases,
    count(*) FILTER (event_type = 'cart') AS brand_total_carts, avg(price) AS brand_avg_price
  FROM raw GROUP BY 1
), agg_brand AS (
  SELECT *, CASE WHEN brand_total_carts > 0 THEN brand_total_purchases / brand_total_carts::DOUBLE ELSE 0.0::DOUBLE END AS brand_purchase_rate
  FROM brand_base
), agg_category AS (
  SELECT string_split(coalesce(lower(category_code), 'unknown'), '.')[1] AS category_level1,
    avg(price) AS category_avg_price, count(*) FILTER (event_type = 'purchase') AS category_total_purchases
  FROM raw GROUP BY 1
), feature_rows AS (
  SELECT s.user_id, s.product_id, s.event_time AS event_timestamp, TIMESTAMP '2024-02-01' AS created_timestamp,
    s.category_code_level1, s.category_code_level2, s.brand, s.event_weekday, s.price, s.activity_count,
    CAST(hour(s.event_time) AS BIGINT) AS event_hour,
    coalesce(user_total_events, 0) AS user_total_events, coalesce(user_total_views, 0) AS user_total_views,
    coalesce(user_total_carts, 0) AS user_total_carts, coalesce(user_total_purchases, 0) AS user_total_purchases,
    coalesce(user_view_to_cart_rate, 0.0) AS user_view_to_cart_rate,
    coalesce(user_cart_to_purchase_rate, 0.0) AS user_cart_to_purchase_rate,
    coalesce(user_avg_purchase_price, 0.0) AS user_avg_purchase_price,
    coalesce(user_unique_products, 0) AS user_unique_products, coalesce(user_unique_categories, 0) AS user_unique_categories,
    coalesce(product_total_events, 0) AS product_total_events, coalesce(product_total_views, 0) AS product_total_views,
    coalesce(product_total_carts, 0) AS product_total_carts, coalesce(product_total_purchases, 0) AS product_total_purchases,
    coalesce(product_view_to_cart_rate, 0.0) AS product_view_to_cart_rate,
    coalesce(product_cart_to_purchase_rate, 0.0) AS product_cart_to_purchase_rate,
    coalesce(product_unique_buyers, 0) AS product_unique_buyers, coalesce(brand_purchase_rate, 0.0) AS brand_purchase_rate,
    CASE WHEN user_avg_purchase_price > 0 THEN s.price / user_avg_purchase_price ELSE 1.0::DOUBLE END AS price_vs_user_avg,
    CASE WHEN category_avg_price > 0 THEN s.price / category_avg_price ELSE 1.0::DOUBLE END AS price_vs_category_avg,
    s.is_purchased
  FROM samples s LEFT JOIN agg_user u ON s.user_id = u.user_id
    LEFT JOIN agg_product p ON s.product_id = p.product_id
    LEFT JOIN agg_brand b ON lower(coalesce(s.brand, 'unknown')) = b.brand_clean
    LEFT JOIN agg_category c ON s.category_code_level1 = c.category_level1
), features AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, product_id, event_timestamp
      ORDER BY category_code_level1, category_code_level2, brand, event_weekday, price, activity_count, is_purchased) AS rn
    FROM feature_rows) WHERE rn = 1
), lite AS (
  SELECT user_id, product_id, event_timestamp, price, CAST(activity_count AS DOUBLE) AS activity_count,
    event_weekday, event_hour,
    CAST(user_total_views AS DOUBLE) AS user_total_views, CAST(user_total_carts AS DOUBLE) AS user_total_carts,
    CAST(product_total_views AS DOUBLE) AS product_total_views, CAST(product_total_carts AS DOUBLE) AS product_total_carts,
    brand_purchase_rate, price_vs_user_avg, price_vs_category_avg, brand, category_code_level1, category_code_level2,
    is_purchased AS actual_label,
    row_number() OVER (ORDER BY user_id, product_id, event_timestamp) AS row_id
  FROM features
), lite_parts AS (
  SELECT *, greatest(user_total_views, 1e0) AS views, greatest(product_total_views, 1e0) AS p_views,
    3e-1 * brand_purchase_rate + 7e-1 * 4e-1 AS conversion,
    least(activity_count / 50, 15e-1) AS engagement
  FROM lite
), lite_bought AS (
  SELECT *, round_even(user_total_carts * conversion, 0) AS bought,
    round_even(product_total_carts * conversion, 0) AS p_bought,
    least(user_total_carts / views, 1e0) AS u_rate, least(product_total_carts / p_views, 1e0) AS p_rate
  FROM lite_parts
), full_rows AS (
  SELECT row_id, user_id, product_id, event_timestamp, actual_label, price, activity_count, event_weekday, event_hour,
    views + user_total_carts + bought AS user_total_events, views AS user_total_views, user_total_carts,
    bought AS user_total_purchases, u_rate AS user_view_to_cart_rate,
    least(bought / greatest(user_total_carts, 1e0), 1e0) AS user_cart_to_purchase_rate,
    price / greatest(price_vs_user_avg, 5e-1) AS user_avg_purchase_price,
    greatest(1e0, user_total_carts * 5e-1 * engagement) AS user_unique_products,
    greatest(1e0, user_total_carts * 1e-1 * engagement) AS user_unique_categories,
    p_views + product_total_carts + p_bought AS product_total_events, p_views AS product_total_views,
    product_total_carts, p_bought AS product_total_purchases, p_rate AS product_view_to_cart_rate,
    least(p_bought / greatest(product_total_carts, 1e0), 1e0) AS product_cart_to_purchase_rate,
    greatest(1e0, product_total_carts * conversion * (3e-1 + p_rate * 7e-1)) AS product_unique_buyers,
    brand_purchase_rate, price_vs_user_avg, price_vs_category_avg, brand, category_code_level1, category_code_level2
  FROM lite_bought
), term_rows AS (
  SELECT *, 35e-2 * user_cart_to_purchase_rate AS t1, 25e-2 * brand_purchase_rate AS t2,
    2e-1 * product_cart_to_purchase_rate AS t3, 1e-1 * least(1e0, activity_count / 2e1) AS t4,
    5e-2 * user_view_to_cart_rate AS t5,
    5e-2 * greatest(0e0, 1e0 - greatest(0e0, price_vs_user_avg - 1e0)) AS t6
  FROM full_rows
), scored AS (
  SELECT *, CAST(printf('%.4f', t1 + t2 + t3 + t4 + t5 + t6) AS DOUBLE) AS score,
    brand_purchase_rate BETWEEN 0 AND 1 AND price >= 0 AND price_vs_user_avg IS NOT NULL
      AND price_vs_category_avg IS NOT NULL AS valid
  FROM term_rows
), predictions AS (
  SELECT *, CASE WHEN valid THEN score END AS probability, 7e-1 AS decision_threshold,
    CASE WHEN valid AND score >= 7e-1 THEN 1 ELSE 0 END AS is_purchased,
    CASE WHEN day(event_timestamp) % 2 = 1 THEN 'current' ELSE 'previous' END AS batch_id
  FROM scored
), simulated AS (
  SELECT *, probability - 65e-2 AS gap, probability - 7e-1 AS own_gap,
    CASE WHEN probability IS NULL THEN is_purchased WHEN probability >= 65e-2 THEN 1 ELSE 0 END AS prediction
  FROM predictions
)
"""


def rounded(expr: str, name: str) -> str:
    """A double to 6 places, by the rule the queries present doubles with."""
    return f"floor(({expr}) * 1e6 + 500001e-6) / 1e6 AS {name}"


def micros(expr: str, name: str | None = None) -> str:
    """A timestamp as microseconds."""
    return f"epoch_us({expr}) AS {name or expr}"


def body(select: str) -> str:
    """A full query: the prelude and a final select (or further tables and a select)."""
    text = select.strip()
    return f"{PRELUDE.strip()}\n{text}"
