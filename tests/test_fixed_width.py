"""Picks per key by hashing: the packed order, and plans without a sorting aggregate."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from boxmill.operators.lookup import name_index
from boxmill.operators.pick import order_key
from boxmill.plans.partition import deleted_images
from boxmill.plans.reconcile import image_tasks

LONGS = [None, -(2**63), 2**63 - 1, 0, 1, -1]
INTS = [None, -(2**31), 2**31 - 1, 0, -1]


@pytest.mark.parametrize("types", ["a long, b int", "a int, b long", "a int, b string"])
def test_order_key_sorts_as_the_columns_do(spark, types):
    first, second = (LONGS, INTS) if types.startswith("a long") else (INTS, LONGS)
    if "string" in types:
        second = [None, "x", "", "y"]
    pairs = [(a, b) for a in first for b in second]
    random.Random(3).shuffle(pairs)
    df = spark.createDataFrame(pairs, types)
    keyed = df.select("a", "b", order_key(df, ["a", "b"]).alias("k"))
    by_key = [(r.a, r.b) for r in keyed.orderBy("k").collect()]
    assert by_key == [tuple(r) for r in df.orderBy("a", "b").collect()]
    assert ("decimal" in keyed.schema["k"].dataType.simpleString()) == ("string" not in types)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _history(spark, cells):
    return spark.createDataFrame(
        cells, "image_name string, task_id long, frame_id int, split string, task_status string, task_updated_date string"
    )


@pytest.fixture()
def history(spark):
    rnd = random.Random(5)
    cells = [
        (f"i{rnd.randrange(40)}" if n % 3 else "hot", rnd.randrange(6), rnd.randrange(5), rnd.choice([None, "", "train", "val", "x"]),
         "completed", rnd.choice(["2024-01-01", "2024-01-02", "2024-01-03", "no date", None]))
        for n in range(900)
    ]
    return cells


@pytest.mark.parametrize("order", [["task_id", "frame_id"], ["frame_id", "task_id"]])
def test_image_tasks(spark, history, order):
    df = _history(spark, history)
    got = image_tasks(df, order)
    assert "SortAggregate" not in _plan(got) and "HashAggregate" in _plan(got)
    want = {}
    for image, task, frame, *_ in history:
        at = (task, frame) if order[0] == "task_id" else (frame, task)
        want[image] = min(want.get(image, (at, task)), (at, task))
    assert rows(got) == sorted((i, t) for i, (_, t) in want.items())


def test_deletion_records(spark, history):
    df = _history(spark, history)
    deleted = df.select("image_name", "task_id", "frame_id", "task_updated_date", F.lit("x").alias("note"), F.create_map(F.lit("k"), F.lit(1)).alias("more"))
    got = deleted_images(df.where("image_name < 'i2'"), deleted)
    assert "SortAggregate" not in _plan(got)
    none = {}
    for image, task, frame, _, _, date in history:
        day = date if date and date[0] == "2" else ""
        none.setdefault(image, []).append((day, task, frame, date))
    want = {i: min((t, f, d or "") for day, t, f, d in found if day == max(found)[0]) for i, found in
            ((i, [(a, t, f, d or "") for a, t, f, d in x]) for i, x in none.items())}
    picked = {r.image_name: (r.task_id, r.frame_id) for r in got.collect()}
    assert picked == {i: w[:2] for i, w in want.items()}
    assert got.count() == len(want)


def test_frames_by_name_without_sorting(spark):
    frames = spark.createDataFrame([(1, 0, "a/x"), (1, 3, "a/x"), (1, 5, "b/x"), (2, 7, "x")], "task_id long, frame_id int, name string")
    got = name_index(frames, "name", "frame_id", ["frame_id"], ["task_id"])
    assert "SortAggregate" not in _plan(got)
    assert rows(got, "task_id", "lookup", "frame_id") == [(1, "a/x", 3), (1, "b/x", 5), (1, "x", 0), (2, "x", 7)]
