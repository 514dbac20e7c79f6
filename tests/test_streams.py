import datetime as dt
import random

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from funnelspark.operators import features, labels
from funnelspark.session import staging_path
from funnelspark.streaming import streams


def make(seed, n=250):
    rng = random.Random(seed)
    return sorted(
        {
            (rng.randrange(600), rng.choice(["cart", "purchase", "view"]), rng.randrange(3), 1, rng.choice(["hot", "hot", "b"]))
            for _ in range(n)
        }
    )


def files(spark, events_of, batches):
    """Folder with one file per batch, in order."""
    path = staging_path(spark, "stream-test")
    for data in batches:
        events_of(data).coalesce(1).write.mode("append").parquet(path)
    return streams.stream_events(spark, path, files_per_trigger=1)


@pytest.fixture
def shuffled():
    """Three batches whose rows are up to 30 minutes out of order across batches."""
    data = make(1)
    rng = random.Random(2)
    arrival = sorted(data, key=lambda r: r[0] + rng.uniform(0, 30))
    third = len(arrival) // 3
    return data, [arrival[:third], arrival[third : 2 * third], arrival[2 * third :]]


def test_stream_credits_equal_batch_credits(spark, events_of, shuffled):
    data, batches = shuffled
    job = streams.StreamCartLabel(spark, staging_path(spark, "c"), delay=dt.timedelta(minutes=31))
    got = job.run(files(spark, events_of, batches))
    want = labels.label_last_cart(events_of(data)).drop("earlier_carts")
    assert rows(got, *want.columns) == rows(want)


def test_stream_activity_equals_batch_activity(spark, events_of, shuffled):
    data, batches = shuffled
    job = streams.StreamActivityCount(spark, staging_path(spark, "a"), delay=dt.timedelta(minutes=31))
    got = job.run(files(spark, events_of, batches))
    columns = ["user_session", "event_time", "event_type", "product_id", "activity_count"]
    assert rows(got, *columns) == rows(labels.activity_count(events_of(data)), *columns)


def test_late_rows_are_left_out(spark, events_of):
    on_time = [(0, "cart", 1, 1, "s"), (300, "cart", 1, 1, "s")]
    late = [(10, "purchase", 1, 1, "s"), (310, "purchase", 1, 1, "s")]
    job = streams.StreamCartLabel(spark, staging_path(spark, "l"), delay=dt.timedelta(minutes=30))
    got = job.run(files(spark, events_of, [on_time, late]))
    assert rows(got, "purchase_time", "cart_time") == [(at(310), at(300))]
    assert rows(job.late(), "event_time", "event_type") == [(at(10), "purchase")]


def test_old_carts_are_dropped_into_a_table(spark, events_of):
    first = [(0, "cart", 1, 1, "s"), (200, "cart", 2, 1, "s")]
    second = [(210, "purchase", 1, 1, "s"), (211, "purchase", 2, 1, "s")]
    root, minutes = staging_path(spark, "b"), lambda n: dt.timedelta(minutes=n)
    job = streams.StreamCartLabel(spark, root, delay=minutes(1), bound=minutes(60))
    got = job.run(files(spark, events_of, [first, second]))
    assert rows(got, "product_id") == [(2,)]
    assert (at(0), 1) in rows(job.expired(), "event_time", "product_id")


def test_idle_sessions_start_anew_with_a_timeout(spark, events_of):
    data = [[(0, "view", 1, 1, "s"), (1, "view", 2, 1, "s"), (50, "view", 1, 1, "t")],
            [(60, "view", 1, 1, "s"), (61, "view", 1, 1, "t")], [(200, "view", 1, 1, "u")]]
    minutes = lambda n: dt.timedelta(minutes=n)
    job = streams.StreamActivityCount(spark, staging_path(spark, "i"), delay=minutes(5), timeout=minutes(30))
    got = job.run(files(spark, events_of, data))
    assert rows(got, "user_session", "event_time", "activity_count") == [
        ("s", at(0), 1), ("s", at(1), 2), ("s", at(60), 1), ("t", at(50), 1), ("t", at(61), 2), ("u", at(200), 1)
    ]


@pytest.mark.parametrize("form", ["credits", "activity", "users"])
def test_a_finished_stream_can_be_started_again(spark, events_of, form):
    data = make(6, 120)
    path, root = staging_path(spark, "again-in"), staging_path(spark, "again")
    made, want = {
        "credits": (lambda: streams.StreamCartLabel(spark, root, dt.timedelta(minutes=1)),
                    lambda df: labels.label_last_cart(df).drop("earlier_carts")),
        "activity": (lambda: streams.StreamActivityCount(spark, root, dt.timedelta(minutes=1)), labels.activity_count),
        "users": (lambda: streams.StreamUserFeatures(spark, root), features.agg_user),
    }[form]

    def result(upto):
        expected = want(events_of(data[:upto]))
        columns = [c for c in expected.columns if form != "activity" or c in (
            "user_session", "event_time", "event_type", "product_id", "activity_count")]
        got = made().run(streams.stream_events(spark, path, files_per_trigger=1))
        assert rows(got, *columns) == rows(expected, *columns)

    for start in (0, 40):
        events_of(data[start : start + 40]).coalesce(1).write.mode("append").parquet(path)
    result(80)
    result(80)
    events_of(data[80:]).coalesce(1).write.mode("append").parquet(path)
    result(len(data))


def test_a_repeated_batch_changes_nothing(spark, events_of):
    data = make(3)
    job = streams.StreamUserFeatures(spark, staging_path(spark, "u"))
    first, second = events_of(data[:100]), events_of(data[100:])
    job.step(first, 0)
    job.step(second, 1)
    once = rows(job.features())
    job.step(second, 1)
    assert rows(job.features()) == once
    want = features.agg_user(events_of(data))
    assert rows(job.features(), *want.columns) == rows(want)


def test_dedup_across_batches(spark, events_of):
    data = make(4, 60)
    stream = files(spark, events_of, [data[:40], data[20:], data])
    out = staging_path(spark, "d")
    streams.run_available(streams.stream_dedup(stream, "1 day"), out)
    columns = ["event_time", "event_type", "product_id", "user_session"]
    assert rows(spark.read.parquet(out), *columns) == rows(events_of(data), *columns)


def test_funnel_windows(spark, events_of):
    data = make(5, 80)
    out = staging_path(spark, "f")
    streams.run_available(streams.stream_funnel(files(spark, events_of, [data]), "1 hour"), out, "complete")
    want = events_of(data).groupBy(F.date_trunc("hour", "event_time").alias("h")).agg(
        F.count_if(F.col("event_type") == "cart").alias("n")
    )
    assert rows(spark.read.parquet(out), "window_start", "carts") == rows(want)


def test_idle_sessions_leave_the_state_store(spark, events_of):
    minutes = lambda n: dt.timedelta(minutes=n)
    data = [[(k, "view", 1, 1, f"s{k}") for k in range(20)], [(500, "view", 1, 1, "t")], [(501, "view", 1, 1, "t")]]
    root = staging_path(spark, "ttl")
    job = streams.StreamActivityCount(spark, root, delay=minutes(5), timeout=minutes(30))
    got = job.run(files(spark, events_of, data))
    assert got.count() == 22
    assert rows(job.state("total"), "user_session") == []
    kept = streams.StreamActivityCount(spark, staging_path(spark, "kept"), delay=minutes(5))
    kept.run(files(spark, events_of, data))
    assert len(rows(kept.state("total"), "user_session")) == 20
    assert rows(kept.state("waiting", listed=True), "user_session") == [("t",), ("t",)]


def test_old_journeys_leave_the_state_store(spark, events_of):
    minutes = lambda n: dt.timedelta(minutes=n)
    data = [[(k, "cart", k, 1, "s") for k in range(20)], [(500, "cart", 99, 1, "s")], [(501, "purchase", 99, 1, "s")]]
    job = streams.StreamCartLabel(spark, staging_path(spark, "bounded"), delay=minutes(5), bound=minutes(60))
    assert rows(job.run(files(spark, events_of, data)), "product_id") == [(99,)]
    assert rows(job.state("cart"), "product_id") == []
    assert len(rows(job.expired(), "product_id")) == 20


def test_late_events_of_a_session_are_in_a_side_table(spark, events_of):
    data = [[(0, "view", 1, 1, "s"), (300, "view", 1, 1, "s")], [(10, "view", 1, 1, None), (299, "cart", 1, 1, "s")]]
    job = streams.StreamActivityCount(spark, staging_path(spark, "late"), delay=dt.timedelta(minutes=30))
    got = job.run(files(spark, events_of, data))
    assert rows(got, "event_time", "activity_count") == [(at(0), 1), (at(299), 2), (at(300), 3)]
    assert rows(job.late(), "event_time", "user_session") == [(at(10), None)]


def test_bytes_of_a_micro_batch_follow_its_users(spark, events_of):
    many = [(k % 600, "view", k % 3, k, "s") for k in range(20_000)]
    job = streams.StreamUserFeatures(spark, staging_path(spark, "delta"))
    job.step(events_of(many), 0)
    base = job.log.size((0, 0))
    for k in range(1, 6):
        job.step(events_of([(k, "cart", 1, k, "s")]), k)
        runs = job.log.runs(k)
        # The large run is left alone; small ones are merged among themselves.
        assert runs[0] == (0, 0) and sum(job.log.size(r) for r in runs[1:]) < base / 4
        assert len(runs) <= 3
    want = features.agg_user(events_of(many + [(k, "cart", 1, k, "s") for k in range(1, 6)]))
    assert rows(job.features(), "user_id", "user_total_events", "user_total_carts") == rows(
        want, "user_id", "user_total_events", "user_total_carts"
    )
    job.step(events_of(many), 6)
    # As large as all before it: one run again.
    assert job.log.runs(6) == [(0, 6)]


def test_the_store_is_called_per_bucket_and_not_per_key(spark, events_of, monkeypatch):
    monkeypatch.setattr(streams, "BUCKETS", 3)
    data = [[(k % 30, "cart", k, 1, "s") for k in range(60)], [(300 + k % 30, "purchase", k, 1, "s") for k in range(60)]]
    job = streams.StreamCartLabel(spark, staging_path(spark, "buckets"), delay=dt.timedelta(minutes=1))
    query = job.start(files(spark, events_of, data))
    query.awaitTermination()
    first = query.recentProgress[0]["stateOperators"][0]["customMetrics"]
    assert int(first["numRegisteredTimers"]) <= 3
    # What waits longest is the last minute; the journeys of a bucket are credited apart.
    got = job.results().unionByName(job.closing())
    assert rows(got, "product_id", "cart_time") == sorted(
        ((k, at(k % 30)) for k in range(60)), key=lambda r: str(r[0])
    )
