import pytest
from conftest import rows
from pyspark.sql import functions as F

from boxmill.operators import lookup as K
from boxmill.operators.ordered import number_rows, number_within, sorted_slices, with_previous
from boxmill.operators.pick import first_per_key, last_per_key


@pytest.fixture(autouse=True)
def several_slices(spark):
    """Keep small slices apart, as they would be on large data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture()
def skewed(spark):
    """3000 rows, a third of them in one group; ``v`` is unique."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 41).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 3001).alias("v"),
    ).repartition(7)


def test_number_rows(skewed):
    got = number_rows(skewed, ["g", "v"], "n", start=5).collect()
    assert [(r.g, r.v) for r in sorted(got, key=lambda r: r.n)] == sorted((r.g, r.v) for r in got)
    assert sorted(r.n for r in got) == list(range(5, 3005))


def test_number_within(skewed):
    got = number_within(skewed, ["g"], ["v"], "n").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.v, r.n))
    for pairs in groups.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_with_previous(skewed):
    got = with_previous(skewed, ["g"], ["v"], "v", "p").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append((r.v, r.p))
    for pairs in groups.values():
        pairs.sort()
        assert [p for _, p in pairs] == [None, *[v for v, _ in pairs[:-1]]]


def test_a_hot_group_is_spread_over_slices(spark, skewed):
    per_slice = {r[0]: r[1] for r in sorted_slices(skewed, ["g", "v"]).groupBy("_slice").count().collect()}
    hot = sorted_slices(skewed, ["g", "v"]).where("g = 'hot'").select("_slice").distinct().count()
    assert hot > 1 and max(per_slice.values()) < 1500
    same = spark.range(2000).select(F.lit("x").alias("g"))
    assert sorted_slices(same, ["g"]).select("_slice").distinct().count() > 1
    assert sorted(r.n for r in number_rows(same, ["g"]).collect()) == list(range(1, 2001))


def test_null_groups_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, v int")
    assert rows(number_within(df, ["g"], ["v"])) == [(None, 1, 1), (None, 2, 2), ("a", 1, 1)]
    assert number_rows(df.where("v > 9"), ["v"]).count() == 0
    assert with_previous(df.where("v > 9"), ["g"], ["v"], "v").count() == 0


def test_pick(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", 5, "w")], "k string, o int, v string")
    assert rows(first_per_key(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", None, "z")]
    assert rows(last_per_key(df, ["k"], ["o"])) == [("a", 2, "x"), ("b", 5, "w")]


def brute_index(listing):
    answers = {}
    for key, name in listing:
        answers[name] = key
        base = name.rstrip("/").rsplit("/", 1)[-1]
        answers.setdefault(base, key)
    return answers


def test_name_index(spark):
    listing = [
        ("k0", "2026-01/a.jpg"), ("k1", "a.jpg"), ("k2", "2026-02/a.jpg"), ("k3", "a.jpg"), ("k4", "2026-01/b.jpg"),
        ("k5", "2026-02/b.jpg"), ("k6", "c.jpg"), ("k7", "x/c.jpg"), ("k8", "2026-01/b.jpg"),
    ]
    objects = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(listing)], "ord int, key string, name string")
    index = K.name_index(objects, "name", "key", ["ord"])
    assert {r.lookup: r.key for r in index.collect()} == brute_index(listing)
    wanted = spark.createDataFrame([("a.jpg",), ("other/b.jpg",), ("2026-02/b.jpg",), ("no.jpg",)], "image_name string")
    assert rows(K.attach_by_name(wanted, index, "image_name", "key")) == [
        ("2026-02/b.jpg", "k5"), ("a.jpg", "k3"), ("no.jpg", None), ("other/b.jpg", "k4")]


def test_newest_and_duplicates(spark):
    objects = spark.createDataFrame([("2026-01/a",), ("2026-02/a",), ("b",)], "name string")
    assert rows(K.newest_object(objects)) == [("a", "2026-02/a", 2), ("b", "b", 1)]
    assert rows(K.duplicate_objects(objects), "base", "name", "is_used") == [("a", "2026-01/a", False), ("a", "2026-02/a", True)]
