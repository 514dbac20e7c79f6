"""Plans and layouts: what keeps the operators running when one key holds much of the data."""

import pytest
from pyspark.sql import functions as F

from funnelspark.operators import features, joins, labels, ordered, split
from funnelspark.operators.clean import dedup_events, filter_event_type
from funnelspark.schemas import EVENTS
from funnelspark.session import stage


@pytest.fixture(scope="module")
def hot_log(spark):
    """20,000 events, half of them of one user in one session with one product."""
    n = 20_000
    hot = F.col("id") % 2 == 0
    kinds = F.array(*[F.lit(k) for k in ("view", "cart", "purchase", "view")])
    df = spark.range(n).select(
        F.timestamp_micros(F.lit(1_704_103_200_000_000) + F.col("id") * 60_000_000).alias("event_time"),
        F.get(kinds, (F.xxhash64("id") % 4 + 4).cast("int") % 4).alias("event_type"),
        F.when(hot, 1).otherwise(F.col("id") % 50).cast("long").alias("product_id"),
        F.lit(1).cast("long").alias("category_id"),
        F.lit("home.lamp").alias("category_code"),
        F.lit("acme").alias("brand"),
        F.lit(10.0).alias("price"),
        F.when(hot, 1).otherwise(F.col("id") % 997).cast("long").alias("user_id"),
        F.when(hot, F.lit("hot")).otherwise((F.col("id") % 997).cast("string")).alias("user_session"),
    )
    return stage(df.select(*EVENTS.fieldNames()), "hot")


def plan_of(df, final=False):
    if final:
        df.write.format("noop").mode("overwrite").save()
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot_keys", [1, 5, 1000])
def test_spread_join_equals_a_plain_left_join(spark, hot_log, hot_keys):
    rows = hot_log.select("user_id", "event_time", "price").union(
        spark.sql("select cast(null as bigint), timestamp'2024-01-01', 1.0 union all select -5, timestamp'2024-01-01', 2.0")
    )
    user = features.agg_user(hot_log).filter("user_id % 3 <> 2")
    got = joins.spread_left_join(rows, user, ["user_id"], "user_total_events", hot_keys)
    want = rows.join(user, "user_id", "left").select(*got.columns)
    assert got.count() == rows.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_rows_of_a_hot_key_are_spread_over_the_tasks(spark, hot_log):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        user = features.agg_user(hot_log)
        joined = joins.spread_left_join(
            hot_log.select("user_id", "event_time"), user, ["user_id"], "user_total_events", 3
        )
        text = plan_of(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins_of = [x for x in text.splitlines() if "SortMergeJoin" in x]
    assert len(joins_of) == 1 and "_salt" in joins_of[0] and "NestedLoop" not in text
    assert any("Exchange hashpartitioning(" in x and "_salt" in x for x in text.splitlines())
    # The only broadcast is the fixed number of heaviest keys.
    assert text.count("BroadcastHashJoin") == 1 and "TakeOrderedAndProject(limit=3" in text


def test_the_hot_session_is_cut_into_small_windows(hot_log):
    cut = hot_log.withColumn("s", ordered.time_slice("event_time"))
    largest = cut.groupBy("user_session", "s").count().agg(F.max("count")).first()[0]
    assert largest <= 5  # of the 10,000 events of the session


def test_windows_are_partitioned_by_slice(hot_log):
    for df in (labels.activity_count(hot_log), labels.label_last_cart(hot_log)):
        windows = [x for x in plan_of(df).splitlines() if "FileScan" not in x and "Exchange hashpartitioning" in x]
        assert any("_slice" in x for x in windows)


def test_running_totals_spread_a_hot_group(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), "id")
    got = ordered.running_totals(df, ["id"], {"n": F.lit(1)}, ["g"], slices=8)
    assert got.filter(F.col("n") != F.col("id") + 1).count() == 0
    # Rows are read as they were stored: the only shuffle left is that of the slice totals.
    left = plan_of(got).split("BroadcastExchange")[0]
    assert "Exchange" not in left


def test_copies_collapse_before_the_shuffle(spark, hot_log):
    copies = hot_log.limit(1).crossJoin(spark.range(1000)).drop("id")
    plan = plan_of(dedup_events(stage(copies, "copies")))
    assert plan.count("partial_min") >= 1
    assert dedup_events(copies).count() == 1


@pytest.mark.parametrize("n", [3, 500])
def test_no_operator_joins_without_a_key(hot_log, n):
    keyed = hot_log.withColumn("at", F.unix_micros("event_time"))
    sampled = split.sample_n(keyed, ["user_id", "at"], n)
    samples = labels.cart_samples(hot_log)
    for df in (sampled, samples, labels.cart_purchase_latency(hot_log), labels.label_same_session(hot_log)):
        text = plan_of(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert sampled.count() == n


def test_latency_of_a_hot_session_stays_near_linear(hot_log):
    # Half the log is one session and product; only instants within the hour are paired.
    carts = filter_event_type(hot_log.filter("user_session = 'hot'"), "cart").count()
    pairs = labels.cart_purchase_latency(hot_log.filter("user_session = 'hot'")).count()
    assert pairs <= carts * 31


def test_lookups_read_stored_tables_without_a_shuffle(spark):
    from funnelspark.operators import store

    n = 6000
    table = spark.range(n).select(F.col("id").alias("product_id"), (F.col("id") * 2).alias("x"))
    kept = store.stored_by_key(table.unionByName(spark.sql("select cast(null as bigint) product_id, 1L x")), "lookup_test", ["product_id"])
    # One product in a third of the pairs, one that the table does not have in another tenth, and pairs without one.
    asked = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, -5).when(F.col("id") % 10 == 2, F.lit(None)).otherwise(F.col("id") % 9000)
    pairs = stage(spark.range(9000).select("id", asked.cast("string").alias("product")), "pairs")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.keyed_left_join(pairs, F.col("product"), kept, ["x"])
        want = pairs.join(table, F.col("product") == F.col("product_id").cast("string"), "left").select("id", "product", "x")
        assert got.count() == 9000 and got.exceptAll(want).isEmpty()
        text = plan_of(got, final=True)
        assert "Bucketed: true" in text
        # Only the pairs are dealt out by key.
        assert "hashpartitioning(_cold" in text and "hashpartitioning(_key" not in text and "hashpartitioning(_rkey" not in text
        heavy = {r[0] for r in joins.heavy_keys(pairs.select(F.col("product").alias("_key")), "_key", 1 / 16).collect()}
        assert heavy == {"7", "-5"}
        sizes = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert max(r["count"] for r in sizes) < 9000 / 4 * 1.5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_features_read_the_log_once(spark, hot_log):
    import datetime as dt

    cut = hot_log.filter("user_id < 40")
    made = features.event_counts(cut, "brand", "category_code")
    for agg in (features.agg_user, features.agg_product, features.agg_brand, features.agg_category):
        one, two = agg(cut), agg(made)
        assert one.columns == two.columns and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    samples = labels.cart_samples(dedup_events(cut))
    table = features.assemble_features_v2(samples, cut, dt.datetime(2024, 2, 1))
    text = table._jdf.queryExecution().optimizedPlan().toString()
    # Four stored sides: no aggregate over the log is left in the plan of the table.
    assert "user_unique_products" in text and "count(distinct" not in text.lower() and "approx" not in text


def _encoder_case(spark):
    from funnelspark.operators import encode

    seen = F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), F.col("id") % 700))
    rows = stage(
        spark.range(6000).select("id", seen.alias("a"), (F.col("id") % 11).cast("string").alias("b"), (F.col("id") % 3).alias("y")),
        "rows",
    )
    fitted = encode.fit_target_encoder(rows.filter("id % 5 > 0"), ["a", "b"], "y")
    index = encode.fit_label_index(rows, ["a", "b"])
    return encode, rows, fitted, index


def test_encoders_are_one_broadcast_dictionary(spark):
    encode, rows, fitted, index = _encoder_case(spark)
    for got in (encode.apply_target_encoder(rows, fitted, ["a", "b"]), encode.label_encode(rows, index, ["a", "b"])):
        assert got.count() == 6000
        text = plan_of(got, final=True).split("Initial Plan")[0]
        # Built once, used twice, and the rows themselves are not shuffled.
        assert text.count("ReusedExchange") >= 1 and "SortMergeJoin" not in text
        assert text.count("FileScan parquet") == 2


def test_large_encoders_spread_the_unknown_half(spark):
    encode, rows, fitted, index = _encoder_case(spark)
    want = encode.apply_target_encoder(rows, fitted, ["a", "b"]), encode.label_encode(rows, index, ["a", "b"], "unknown")
    want = [stage(w, "want") for w in want]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = encode.apply_target_encoder(rows, fitted, ["a", "b"]), encode.label_encode(rows, index, ["a", "b"], "unknown")
        for g, w in zip(got, want):
            assert g.columns == w.columns and g.count() == 6000 and g.exceptAll(w).isEmpty()
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        one = encode.apply_target_encoder(rows, fitted, ["a"])
        sizes = one.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(sizes) > 1 and max(r["count"] for r in sizes) < 6000 / 4 * 1.5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
