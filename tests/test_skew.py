"""Hot keys: results do not change and no task gets a whole hot key."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from boxmill.operators import skew
from boxmill.operators.selection import without_images
from boxmill.plans.merge import merge_datasets
from boxmill.plans.partition import partition_annotations


@pytest.fixture()
def low_limit(monkeypatch, spark):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    kept = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def facts(spark, n=3000):
    """A third of the rows have one key, a few have none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 300).cast("string")))
    return spark.range(n, numPartitions=12).select(key.alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
@pytest.mark.parametrize("weight", [None, "w"])
def test_lookup_join_equals_a_plain_join(spark, low_limit, how, weight):
    f = facts(spark)
    table = f.groupBy("k").agg(F.count("*").alias("w"), F.max("v").alias("m")).where("k = 'hot' or m % 2 = 0")
    got = skew.lookup_join(f, table, ["k"], how, weight)
    assert rows(got, *f.columns) == rows(f.join(table, "k", how), *f.columns)
    assert "_salt" not in got.columns
    if how == "left":
        assert rows(got, "v", "m") == rows(f.join(table, "k", how), "v", "m")


def test_a_hot_key_is_dealt_to_several_tasks(spark, low_limit):
    f = facts(spark)
    table = f.groupBy("k").agg(F.count("*").alias("w"))
    got = skew.lookup_join(f, table, ["k"], "left", "w").select("k", F.spark_partition_id().alias("task"))
    hot = {r.task: r["count"] for r in got.where("k = 'hot'").groupBy("task").count().collect()}
    assert len(hot) >= 4 and max(hot.values()) < 500
    assert got.where("k is null").select("task").distinct().count() >= 4


def test_plans_with_hot_images(spark, low_limit, monkeypatch):
    f = facts(spark)
    ann = f.select(
        F.col("k").alias("image_name"), F.col("v").alias("task_id"), F.lit("completed").alias("task_status"),
        F.concat(F.lit("2026-01-0"), (F.col("v") % 9 + 1).cast("string")).alias("task_updated_date"))
    gone = spark.createDataFrame([("hot", 9999, "2026-01-09")], "image_name string, task_id long, task_updated_date string")
    old, new = ann.where("task_id % 2 = 0"), ann.where("task_id % 2 = 1")
    results = lambda: (
        rows(partition_annotations(ann, gone)), rows(merge_datasets(old, new, gone.where("false"), by_time=True)),
        rows(without_images(ann, gone)))
    spread = results()
    monkeypatch.setattr(skew, "HOT_ROWS", 10**9)
    assert spread == results()


def test_the_adaptive_skew_join_can_act(spark):
    """Below the limit the join is left to Spark: the written table makes both sides
    plain shuffles.  Thresholds are brought down to test size."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        f = facts(spark, 60000).withColumn("load", F.xxhash64("v"))
        table = f.groupBy("k").agg(F.count("*").alias("w"), F.max("v").alias("m"))
        joined = skew.lookup_join(f, table, ["k"], "left", "w")
        assert sum(r.m is not None for r in joined.collect()) == f.where("k is not null").count()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
