import pytest
import samples as X
from conftest import rows
from pyspark.sql import functions as F

from boxmill.operators import selection as P
from boxmill.plans import labels as L
from boxmill.plans import pushback as B
from boxmill.plans import reconcile as R
from boxmill.plans.extract import Snapshot, extract_records
from boxmill.plans.partition import deleted_images, partition_annotations
from boxmill.plans.scale import base_positions, scale_project, scale_tasks
from boxmill.sinks import tables as W
from boxmill.sources import documents as D
from boxmill.sources.listing import object_names
from boxmill.sources.tables import read_dataset_csv


def objects(spark, prefix, *names):
    return spark.createDataFrame(
        [(i, f"{prefix}/{n}" if prefix else n, n) for i, n in enumerate(names)], "ord int, key string, name string")


def files(spark, *found):
    return spark.createDataFrame([(n, f"/d{r}/{n}", r) for r, n in found], "name string, path string, dir_rank int")


def test_download(spark):
    ann = spark.createDataFrame(
        [("a.jpg", 2, 0), ("a.jpg", 1, 1), ("b.jpg", 1, 2), ("c.jpg", 1, 3), ("d.jpg", 1, 4)], "image_name string, task_id long, n int")
    store = objects(spark, "p", "2026-01/a.jpg", "b.jpg", "2026-01/b.jpg", "c.jpg")
    plan = R.plan_download(ann, store, files(spark, (0, "c.jpg")), ["n"])
    assert rows(plan) == [
        ("a.jpg", 2, "p/2026-01/a.jpg", "download"), ("b.jpg", 1, "p/b.jpg", "download"), ("c.jpg", 1, None, "cached"), ("d.jpg", 1, None, "failed")]
    assert rows(R.transfer_stats(plan)) == [(2, 1, 1, 4)]
    nothing = R.plan_download(ann, None, files(spark, (0, "c.jpg")), ["n"])
    assert rows(R.transfer_stats(nothing)) == [(0, 1, 3, 4)]


def test_sync_of_several_projects(spark):
    store = spark.createDataFrame([("x", "k1", "a"), ("x", "k2", "m/b"), ("y", "k3", "a")], "project string, key string, name string")
    local = spark.createDataFrame([("x", "a"), ("x", "extra"), ("y", "b")], "project string, name string")
    plan = R.plan_sync(store, local, ["project"])
    assert rows(plan, "key", "status") == [("k1", "cached"), ("k2", "download"), ("k3", "download")]
    assert rows(R.transfer_stats(plan, ["project"])) == [("x", 1, 1, 0, 2), ("y", 1, 0, 0, 1)]


def test_objects_under_a_prefix(spark):
    store = objects(spark, "", "p/", "p/a", "p/2026-01/b", "q/c", "pp/d")
    assert rows(object_names(store, "p"), "name") == [("2026-01/b",), ("a",), ("p/d",)]  # plain string test, marker dropped
    assert object_names(store).count() == 5


def test_upload(spark):
    data = spark.createDataFrame([
        ("a.jpg", "cat", "box"), ("a.jpg", "dog", "box"), ("b.jpg", "dog", "box"), ("c.jpg", None, "none"),
        ("d.jpg", None, "deleted"), ("e.jpg", "cat", "box"), ("f.jpg", "cat", "box")], "image_name string, instance_label string, instance_shape string")
    normal, _ = P.split_deleted(data)
    assert rows(P.label_candidates(normal)) == [("__no_annotation__", 1), ("cat", 3), ("dog", 2)]
    chosen, gone = R.upload_rows(data, ["cat", "__no_annotation__"])
    busy = spark.createDataFrame([("f.jpg",)], "image_name string")
    images = R.upload_images(chosen, gone, busy)
    assert rows(images) == [("a.jpg",), ("c.jpg",), ("d.jpg",), ("e.jpg",)]
    store = objects(spark, "p", "2026-01/a.jpg", "2026-02/a.jpg")
    plan = R.plan_upload(images, store, files(spark, (1, "c.jpg"), (0, "c.jpg"), (0, "a.jpg")), "p", "2026-03")
    assert rows(plan) == [
        ("a.jpg", "2026-02/a.jpg", "p/2026-02/a.jpg", "/d0/a.jpg", "existing"), ("c.jpg", "2026-03/c.jpg", "p/2026-03/c.jpg", "/d0/c.jpg", "upload"),
        ("d.jpg", "2026-03/d.jpg", "p/2026-03/d.jpg", None, "missing"), ("e.jpg", "2026-03/e.jpg", "p/2026-03/e.jpg", None, "missing")]
    assert rows(R.missing_images(images, files(spark, (0, "a.jpg"), (0, "c.jpg")))) == [("d.jpg",), ("e.jpg",)]
    assert P.split_deleted(data.drop("instance_shape"))[1].count() == 0


def test_label_check(spark):
    data = spark.createDataFrame([("cat",), ("zebra",), ("ant",), (None,)], "instance_label string")
    with pytest.raises(ValueError, match="ant, zebra; defined: cat, dog"):
        R.check_labels(data, X.labels(spark))
    assert R.check_labels(data.where("instance_label = 'cat'"), X.labels(spark)).count() == 1


def test_enrich(spark):
    data = spark.createDataFrame([("a.jpg", None), ("b.jpg", "/keep"), ("b.jpg", None)], "image_name string, image_path string")
    mapping = spark.createDataFrame([("a.jpg", "2026-01/a.jpg")], "image_name string, server_file string")
    got = R.enrich_paths(data, "p", files(spark, (0, "a.jpg")), mapping)
    assert rows(got, "image_name", "s3_path", "image_path") == [
        ("a.jpg", "p/2026-01/a.jpg", "/d0/a.jpg"), ("b.jpg", "p/b.jpg", None), ("b.jpg", "p/b.jpg", "/keep")]
    assert R.enrich_paths(data, None).columns == ["image_name", "image_path"]


def test_jobs(spark):
    images = spark.range(250).select(F.format_string("i%03d", "id").alias("image_name"))
    assert rows(R.jobs_per_task(images)) == [(250, 3)]
    got = dict(rows(R.job_numbers(images, ["image_name"])))
    assert got["i099"] == 0 and got["i100"] == 1 and got["i249"] == 2


FRAMES = [(1, 0, "2026-01/a.jpg"), (1, 1, "b.jpg"), (1, 2, "x/b.jpg"), (1, 3, "a.jpg"), (1, 4, "2026-02/c.jpg"), (1, 5, "2026-03/c.jpg"), (2, 0, "a.jpg")]


def frames(spark):
    return spark.createDataFrame(FRAMES, "task_id long, frame_id int, name string")


def test_push_back(spark):
    layout = "task_id long, image_name string, instance_label string, bbox_x_tl double, bbox_y_tl double, bbox_x_br double, bbox_y_br double"
    box = (1.0, 2.0, 3.0, 4.0)
    data = spark.createDataFrame([
        (1, "a.jpg", "cat", *box), (1, "c.jpg", "dog", *box), (1, "x/b.jpg", "cat", *box), (1, "zz.jpg", "nope", *box), (2, "b.jpg", "cat", *box),
        (1, "b.jpg", "nope", *box), (1, "b.jpg", None, *box), (1, "b.jpg", "cat", 1.0, None, 1.0, 1.0)], layout)
    matched = B.match_shapes(data, frames(spark), X.labels(spark))
    assert rows(B.push_counts(matched)) == [("no_frame", 2), ("no_label", 1), ("pushed", 3)]
    got = B.to_shapes(data, frames(spark), X.labels(spark))
    assert rows(got, "task_id", "frame_id", "label_id") == [(1, 2, 1), (1, 3, 1), (1, 4, 2)]
    assert got.first().points == list(box)


def test_mark_deleted(spark, tmp_path):
    gone = spark.createDataFrame([(1, 0), (1, 1)], "task_id long, frame_id int")
    names = spark.createDataFrame([("b.jpg",), ("a.jpg",), ("none",)], "image_name string")
    assert rows(B.mark_deleted(frames(spark), gone, names)) == [(1, 0), (1, 1), (1, 3), (2, 0)]
    one = names.withColumn("task_id", F.lit(2).cast("long"))
    assert rows(B.mark_deleted(frames(spark), gone, one)) == [(1, 0), (1, 1), (2, 0)]
    docs = D.read_documents(spark, X.write(tmp_path, X.last_removed(1), X.normal(2)))
    names = spark.createDataFrame([(1, "im2.jpg"), (1, "im7.jpg"), (2, "zz")], "task_id long, image_name string")
    got = B.mark_documents_deleted(docs, names)
    assert rows(got, "task.id", F.to_json("data_meta.deleted_frames")) == [(1, "[2,7]"), (2, "[]")]
    assert got.columns == docs.columns


# --- labels ---------------------------------------------------------------------
def some_shapes(spark):
    data = [(1, 0, 1, [(10, "a"), (11, "b"), (99, None)]), (1, 1, 2, []), (1, 2, 1, []), (1, 3, 5, [])]
    return spark.createDataFrame(data, "task_id long, ord long, label_id long, attributes array<struct<spec_id:bigint,value:string>>")


def test_usage(spark):
    assert rows(L.label_usage(some_shapes(spark))) == [(1, 2), (2, 1), (5, 1)]
    assert rows(L.usage_report(X.labels(spark), some_shapes(spark))) == [(1, "cat", 2), (2, "dog", 1)]


def test_label_edits(spark):
    labels, shapes = L.apply_label_changes(
        X.labels(spark), some_shapes(spark), add={9: " bird "}, rename={1: "Kitten"}, recolor={1: "#AABBCC"}, delete=[2])
    assert rows(labels, "label_id", "label_name", "color") == [(1, "Kitten", "#aabbcc"), (9, "bird", "")]
    assert rows(shapes, "label_id") == [(1,), (1,), (5,)]
    edit = lambda **kw: L.apply_label_changes(X.labels(spark), some_shapes(spark), **kw)
    for wrong in (dict(add={9: "CAT"}), dict(rename={1: "Dog"}), dict(add={8: "n", 9: "N"}), dict(add={9: " "}), dict(recolor={1: "red"})):
        with pytest.raises(ValueError):
            edit(**wrong)
    assert rows(edit(rename={1: "CAT"})[0], "label_name") == [("CAT",), ("dog",)]  # case of the same label
    assert rows(edit(delete=[2], add={9: "dog"})[0], "label_id", "label_name") == [(1, "cat"), (9, "dog")]


def test_remap(spark):
    target = spark.createDataFrame([(101, "cat", "", [(110, "age")])], X.labels(spark).schema)
    assert rows(L.remap_shapes(some_shapes(spark), X.labels(spark), target), "ord", "label_id", F.to_json("attributes")) == [
        (0, 101, '[{"spec_id":110,"value":"a"},{"spec_id":11,"value":"b"},{"spec_id":99,"value":""}]'), (2, 101, "[]")]


def test_remap_tracks(spark, tmp_path):
    doc = X.document(1, ["a.jpg"])
    inner = [{"type": "rectangle", "frame": f, "points": [0, 0, 1, 1], "outside": bool(f), "attributes": [{"spec_id": 10, "value": str(f)}]} for f in range(3)]
    doc["annotations"]["tracks"] = [
        {"id": 5, "frame": 0, "label_id": 1, "source": "m", "attributes": [{"spec_id": 11, "value": "q"}], "shapes": inner},
        {"id": 6, "frame": 0, "label_id": 1, "source": "m", "attributes": [], "shapes": []},
        {"id": 7, "frame": 0, "label_id": 2, "source": "m", "attributes": [], "shapes": inner}]
    tracks = D.tracks_table(D.read_documents(spark, X.write(tmp_path, doc)))
    target = spark.createDataFrame([(101, "cat", "", [(110, "age"), (111, "mood")])], X.labels(spark).schema)
    got = {r.id: r for r in L.remap_tracks(tracks, X.labels(spark), target).collect()}
    assert set(got) == {5, 6} and got[5].label_id == 101 and got[6].shapes == []
    assert [(s.frame, s.outside, s.attributes[0].spec_id, s.attributes[0].value) for s in got[5].shapes] == [
        (0, False, 110, "0"), (1, True, 110, "1"), (2, True, 110, "2")]
    assert got[5].attributes[0].spec_id == 111


# --- scaled projects --------------------------------------------------------------
def test_scaling(spark, tmp_path):
    docs = D.read_documents(spark, X.write(tmp_path, X.normal(1, name="Normal"), X.all_empty(2, name="Empty"), X.last_removed(3)))
    snapshot = Snapshot.of_documents(docs, X.labels(spark))
    big = scale_project(snapshot, 7, pick="cycle", names="enumerated", statuses=["annotation", "completed"])
    assert rows(big.tasks, "task_id", "task_name", "task_status")[:2] == [(100, "task-0", "annotation"), (101, "task-1", "completed")]
    found = {(r[0], r[1]): r[2] for r in extract_records(big).annotations.groupBy("task_id", "instance_shape").count().collect()}
    assert found == {(100, "box"): 30, (101, "none"): 8, (102, "box"): 17, (102, "none"): 1, (103, "box"): 30, (104, "none"): 8, (105, "box"): 17,
                     (105, "none"): 1, (106, "box"): 30}
    spots = base_positions(snapshot.tasks, [" empty", "NORMAL"])
    assert spots == [1, 0]
    assert rows(scale_tasks(snapshot.tasks, 0, pick=spots, names=["x"]), "task_id", "task_name", "base_task_id") == [(100, "x", 2), (101, "x", 1)]
    with pytest.raises(ValueError):
        base_positions(snapshot.tasks, ["nothing"])
    with pytest.raises(ValueError):
        scale_tasks(snapshot.tasks, 1, pick=[3])
    random = dict(seed=4, id_order="random", names="random", statuses="random")
    a, b = (rows(scale_tasks(snapshot.tasks, 50, **random)) for _ in range(2))
    assert a == b and sorted(r[0] for r in a) == list(range(100, 150)) and len({r[5] for r in a}) == 3
    assert rows(scale_tasks(snapshot.tasks, 50, **{**random, "seed": 5})) != a


# --- written tables ---------------------------------------------------------------
def test_written_tables(spark, tmp_path):
    docs = D.read_documents(spark, X.write(tmp_path / "in", X.normal(1), X.all_removed(2, date="2026-01-02"), X.all_empty(3, date="2025-01-01", status="annotation")))
    records = extract_records(Snapshot.of_documents(docs, X.labels(spark)))
    out = str(tmp_path / "out")
    W.write_partitioned(records, out)
    assert spark.read.parquet(f"{out}/parts").count() == 68 and spark.read.parquet(f"{out}/deleted").count() == 8
    parts = partition_annotations(records.annotations, records.deleted)
    W.write_parts_separately(parts, deleted_images(records.annotations, records.deleted), f"{out}/csv")
    sizes = {n: read_dataset_csv(spark, f"{out}/csv/{n}", ["image_name"]).count() for n in ("dataset", "obsolete", "in_progress", "deleted")}
    assert sizes == {"dataset": 0, "obsolete": 68, "in_progress": 0, "deleted": 8}
    back = read_dataset_csv(spark, f"{out}/csv/obsolete")
    key = ["image_name", "task_id", "frame_id", "annotation_id", "bbox_x_tl", "occluded", "instance_label"]
    assert rows(back, *key) == rows(parts, *key)
    assert back.columns == list(W.S.COLUMNS)
    header = [p for p in (tmp_path / "out/csv/dataset").glob("part-*.csv")]
    assert header and header[0].read_text().strip() == ",".join(W.S.COLUMNS)
    W.write_raw(records, f"{out}/raw")
    W.write_dataset_and_deleted(records, f"{out}/both", "csv")
    W.write_per_task(records, f"{out}/tasks")
    assert spark.read.parquet(f"{out}/raw").count() == 76 and (tmp_path / "out/tasks/task_id=2").is_dir()


def test_one_base_task_copied_many_times(spark, monkeypatch, tmp_path):
    from boxmill.plans import scale

    docs = D.read_documents(spark, X.write(tmp_path / "in", X.normal(1)))
    snapshot = Snapshot.of_documents(docs, X.labels(spark))
    monkeypatch.setattr(scale, "COPIES_PER_PART", 100)
    big = scale.scale_project(snapshot, 2500)
    assert "_part" in big.frames._jdf.queryExecution().optimizedPlan().toString()
    assert big.frames.count() == 2500 * 8 and big.shapes.count() == 2500 * 30
    assert big.frames.select("task_id", "frame_id").distinct().count() == 2500 * 8
