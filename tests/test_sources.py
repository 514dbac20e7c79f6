import gzip

import pytest
from helpers import rows
from pyspark.sql import functions as F

from funnelspark import session
from funnelspark.sources import readers, writers

CSV = (
    "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
    "2019-11-01 00:00:00 UTC,view,1003461,2053013555631882655,electronics.smartphone,xiaomi,489.07,520088904,s1\n"
    "2019-11-01 00:00:01 UTC,cart,bad,2053013555631882655,,,12.5,530496790,NULL\n"
)


def test_gzip_csv_events(spark, tmp_path):
    path = str(tmp_path / "events.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write(CSV)
    df = readers.read_events(spark, path, partitions=3, keep_corrupt=True)
    got = df.orderBy("event_time").collect()
    assert str(got[0].event_time) == "2019-11-01 00:00:00" and got[0].price == 489.07
    assert got[1].product_id is None and got[1].brand is None and got[1].user_session == "NULL"
    assert got[0]._corrupt_record is None and "bad" in got[1]._corrupt_record


def test_read_table_by_suffix(spark, tmp_path):
    df = spark.range(5).withColumn("t", F.lit("x"))
    for suffix in (".csv", ".parquet", ".pq"):
        path = str(tmp_path / f"data{suffix}")
        (writers.write_csv if suffix == ".csv" else writers.write_parquet)(df, path)
        assert rows(readers.read_table(spark, path, df.schema)) == rows(df)
    with pytest.raises(ValueError, match="orc"):
        readers.read_table(spark, "data.orc")


def test_partitioned_feature_table_prunes_days(spark, tmp_path):
    df = spark.sql(
        "select id, timestamp'2024-01-01' + make_interval(0,0,0,cast(id % 3 as int)) as event_timestamp from range(30)"
    )
    path = writers.write_feature_table(df, str(tmp_path / "t"))
    back = spark.read.parquet(path)
    assert back.count() == 30
    plan = back.filter("event_date = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_quoted_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you')], "row int, note string")
    path = writers.write_csv(df.coalesce(1), str(tmp_path / "out"), quote_all=True)
    assert [r.value for r in spark.read.text(path).collect()] == ['"row","note"', '"1","say ""hi"", you"']


def test_bounded_sample_is_repeatable(spark):
    df = spark.range(200).withColumn("v", F.col("id") * 2)
    a = readers.read_bounded_sample(df, ["v"], ["id"], 10)
    b = readers.read_bounded_sample(df.repartition(7), ["v"], ["id"], 10)
    assert rows(a) == rows(b) and a.columns == ["v"] and a.count() == 10


def test_sorted_events_follow_each_other(spark, events_of):
    from funnelspark.operators.clean import sort_events

    events = events_of([(m % 13, "cart", m % 5, m % 3 or None, "s") for m in range(120)])
    placed = sort_events(events, partitions=4).withColumn("task", F.spark_partition_id()).collect()
    seen = [(r.user_id or 0, r.product_id, r.event_time) for r in placed]
    assert len(seen) == 120 and seen == sorted(seen) and len({r.task for r in placed}) == 4
    assert sort_events(events.limit(0)).count() == 0


def test_filters_reach_the_file_scan(spark, tmp_path):
    from funnelspark.operators.clean import filter_event_type

    path = writers.write_parquet(
        spark.createDataFrame([("cart", 1, 2.0)], "event_type string, user_id long, price double"),
        str(tmp_path / "e"),
    )
    plan = filter_event_type(spark.read.parquet(path), "cart").select("user_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,cart)" in text and "ReadSchema: struct<event_type:string,user_id:bigint>" in text


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())
