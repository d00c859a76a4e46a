"""Work that several outputs share is done once, and copies or files cost no more than there are of them."""

import os

import samples as X
from conftest import rows
from pyspark.sql import functions as F

from boxmill.operators import attributes as A
from boxmill.plans import extract, partition, scale
from boxmill.plans import yolo as Y
from boxmill.plans.extract import Snapshot, extract_records
from boxmill.sinks import tables as W
from boxmill.sinks.files import write_blobs
from boxmill.sources import documents as D
from boxmill.sources.listing import list_files


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _counted(monkeypatch, *modules):
    """The calls of ``settle`` in the modules, by module."""
    calls = []
    for module in modules:
        def kept(df, real=module.settle, name=module.__name__):
            calls.append(name.rpartition(".")[2])
            return real(df)

        monkeypatch.setattr(module, "settle", kept)
    return calls


def test_rows_of_a_task_are_not_multiplied_by_all_copies(spark, monkeypatch, tmp_path):
    docs = D.read_documents(spark, X.write(tmp_path / "in", X.normal(1), X.normal(2)))
    snapshot = Snapshot.of_documents(docs, X.labels(spark))
    monkeypatch.setattr(scale, "COPIES_PER_PART", 10)
    # no task has more copies than are made together, so its rows are read once
    few = scale.scale_project(snapshot, 20, pick="cycle")
    assert "_part" not in _plan(few.frames) and few.frames.count() == 20 * 8
    # one has: its rows go to its three parts, those of the other to one
    many = scale.scale_project(snapshot, 0, pick=[0] * 30 + [1] * 2)
    assert "_part" in _plan(many.frames)
    assert rows(many.frames.groupBy("task_id").count()) == sorted(((100 + i, 8) for i in range(32)), key=lambda r: str(r[0]))


def test_blobs_leave_nothing_beside_them_and_replace(spark, tmp_path):
    many = spark.createDataFrame([(f"d{i % 3}/_{i}", "x" * i) for i in range(50)], "name string, content string")
    folder = str(tmp_path / "store")
    for _ in range(2):
        assert write_blobs(many, folder).agg(F.sum("length")).first()[0] == sum(range(50))
    found = list_files(spark, folder)
    assert rows(found, "name", "length") == rows(many.select("name", F.length("content").cast("long")))
    assert os.listdir(f"{folder}/.staging") == []


def test_documents_are_parsed_once(spark, monkeypatch, tmp_path):
    docs = D.read_documents(spark, X.write(tmp_path, X.normal(1), X.normal(2)))
    calls = _counted(monkeypatch, extract)
    flat = Snapshot.of_documents(docs, X.labels(spark))
    assert calls == ["extract"]
    for table in (flat.tasks, flat.frames, flat.deleted, flat.shapes, flat.tracks):
        assert "from_json" not in _plan(table)


def test_deletions_of_known_and_unknown_frames(spark):
    tasks = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "c")], "task_id long, task_name string"
    ).selectExpr("*", "'completed' AS task_status", "'2024-01-01' AS task_updated_date", "'' AS subset")
    frames = spark.createDataFrame([(1, 0, "x"), (2, 0, None), (3, 0, "z")], "task_id long, frame_id int, name string").selectExpr("*", "10 AS width", "20 AS height")
    gone = spark.createDataFrame([(1, 0), (1, 7), (2, 0), (2, None), (3, 0), (None, 0)], "task_id long, frame_id int")
    shapes = spark.createDataFrame([], "task_id long, frame_id int, type string, label_id long, points array<double>")
    snapshot = Snapshot(tasks, frames.where("task_id <> 2"), gone, shapes, X.labels(spark))
    columns = ["image_name", "image_width", "task_id", "task_name", "frame_id"]
    counted = extract.counted_frames(snapshot)
    got = rows(extract.deleted_rows(snapshot, counted), *columns)
    assert got == rows(extract.deleted_rows(snapshot), *columns) and len(got) == 6
    assert "name" in _plan(counted) and _plan(extract_records(snapshot).deleted).count("Aggregate") == 0


def test_parts_and_deleted_images_share_one_state(spark, monkeypatch, tmp_path):
    docs = D.read_documents(spark, X.write(tmp_path / "in", X.normal(1), X.normal(2)))
    records = extract_records(Snapshot.of_documents(docs, X.labels(spark)))
    state = partition.counted_state(records.annotations, records.deleted)
    parts = partition.partition_annotations(records.annotations, records.deleted, state)
    plain = partition.partition_annotations(records.annotations, records.deleted)
    names = ["image_name", "task_id", "frame_id", "part"]
    assert rows(parts, *names) == rows(plain, *names)
    gone = partition.deleted_images(records.annotations, records.deleted, state=state)
    assert rows(gone, "image_name") == rows(partition.deleted_images(records.annotations, records.deleted), "image_name")
    assert "seen_at" not in _plan(gone) and "seen_at" in _plan(partition.deleted_images(records.annotations, records.deleted))
    # three outputs read the decided parts, which are written once
    calls = _counted(monkeypatch, W)
    W.write_parts_separately(parts, gone, f"{tmp_path}/out")
    assert calls == ["tables"]


def test_few_attribute_specs_need_no_row_numbers(spark, monkeypatch):
    df = spark.createDataFrame(
        [(1, [(1, "a"), (9, "b"), (1, "c"), (None, "d")]), (2, []), (3, None), (4, [None, (2, None)])],
        "k int, attributes array<struct<spec_id:bigint,value:string>>",
    )
    specs = spark.createDataFrame([(1, "one"), (2, "two"), (None, "none"), (4, None)], "spec_id long, target string")
    inside = A.with_spec_targets(df, specs)
    assert "_row" not in _plan(inside)
    monkeypatch.setattr(A, "FEW_SPECS", 0)
    joined = A.with_spec_targets(df, specs)
    assert "_row" in _plan(joined)
    assert inside.schema.simpleString() == joined.schema.simpleString()
    assert rows(inside) == rows(joined)


def test_first_sizes_are_picked_by_hashing(spark):
    boxes = spark.createDataFrame(
        [("train", "i", 2, 0, 5, 6), ("train", "i", 1, 3, 7, None), ("train", "i", 1, 4, 9, 9), ("val", "i", None, 0, 1, 2)],
        "split string, image_name string, task_id long, frame_id int, image_width int, image_height int",
    )
    sizes = Y.first_sizes(boxes, ["task_id", "frame_id"])
    assert rows(sizes) == [("train", "i", 7, None, 3), ("val", "i", 1, 2, 1)]
    assert "SortAggregate" not in sizes._jdf.queryExecution().executedPlan().toString()
