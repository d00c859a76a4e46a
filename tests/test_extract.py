import json

import pytest
import samples as X
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.functions import attributes_json
from boxmill.operators import attributes as A
from boxmill.operators import selection as P
from boxmill.plans.extract import (
    Snapshot,
    box_rows,
    choose_tasks,
    extract_documents,
    extract_records,
    fetch_annotations,
    fetch_project,
    fetch_summary,
)
from boxmill.plans.scale import scale_project
from boxmill.sinks.snapshots import project_document, snapshot_documents, write_documents
from boxmill.sources import documents as D
from boxmill.sources.ignore_list import ignore_list


def both(spark, folder, *docs, on_error="fail"):
    """Records through the flat tables and through whole documents."""
    read = D.read_documents(spark, X.write(folder, *docs), on_error)
    return [
        extract_records(Snapshot.of_documents(read, X.labels(spark))),
        extract_documents(read, X.labels(spark)),
    ]


def counts(records):
    return {r[0]: r[1] for r in fetch_summary(records).collect()}


@pytest.mark.parametrize("make, expected", [
    (X.normal, {"box": 30}),
    (X.all_empty, {"none": 8}),
    (X.all_removed, {"box": 30, "deleted": 8}),
    (X.last_removed, {"box": 17, "none": 1, "deleted": 1}),
])
def test_counts_per_task(spark, tmp_path, make, expected):
    for records in both(spark, tmp_path, make()):
        assert counts(records) == expected


def test_several_tasks(spark, tmp_path):
    for records in both(spark, tmp_path, X.normal(), X.all_empty(), X.all_removed()):
        assert counts(records) == {"box": 60, "none": 8, "deleted": 8}


def test_flat_and_nested_extraction_agree(spark, tmp_path):
    flat, nested = both(spark, tmp_path, X.normal(), X.last_removed(), X.document(20, []))
    order = [c for c in S.COLUMNS if c != "attributes"]
    for side in ("annotations", "deleted"):
        assert rows(getattr(flat, side), *order) == rows(getattr(nested, side), *order)


def test_fields_of_a_box(spark, tmp_path):
    raw = X.shape(
        7, 0, points=(1.5, 2, 3, 4), occluded=True, z_order=2, rotation=5.5, source="auto",
        attributes=[{"spec_id": 10, "value": "3"}, {"spec_id": 99, "value": "x"}, {"spec_id": 10, "value": "4"}],
        created_by={"username": "ann"},
    )
    doc = X.document(5, ["d/im.jpg"], shapes=[raw], name="n", status="annotation", date="2026-02-02")
    for records in both(spark, tmp_path, doc):
        got = records.annotations.withColumn("attributes", attributes_json("attributes")).first().asDict()
        assert got == {
            "image_name": "im.jpg", "image_width": 640, "image_height": 480, "instance_shape": "box",
            "instance_label": "cat", "bbox_x_tl": 1.5, "bbox_y_tl": 2.0, "bbox_x_br": 3.0, "bbox_y_br": 4.0,
            "task_id": 5, "task_name": "n", "task_status": "annotation", "task_updated_date": "2026-02-02",
            "created_by_username": "ann", "frame_id": 0, "split": None, "subset": "s", "occluded": True,
            "z_order": 2, "rotation": 5.5, "source": "auto", "annotation_id": 7, "confidence": None,
            "s3_path": None, "image_path": None, "attributes": '{"age": "4", "99": "x"}',
        }


def test_defaults_of_a_bare_shape(spark, tmp_path):
    doc = X.document(5, ["im.jpg"], shapes=[{"type": "rectangle", "frame": 0, "label_id": 1, "points": [0, 0, 1, 1]}])
    for records in both(spark, tmp_path, doc):
        got = records.annotations.first()
        assert (got.annotation_id, got.occluded, got.z_order, got.rotation, got.source, got.created_by_username) == (
            0, False, 0, 0.0, "", "")


def test_odd_shapes(spark, tmp_path):
    doc = X.document(
        6, ["a.jpg", "b.jpg", "c.jpg"], deleted=[2, 9],
        shapes=[X.shape(1, 0, label=77), X.shape(2, 1, kind="polygon"), X.shape(3, 5), X.shape(4, 2)],
    )
    for records in both(spark, tmp_path, doc):
        # unknown label, polygon-only frame is unannotated, missing frame dropped, deleted frame kept
        assert rows(records.annotations, "instance_shape", "image_name", "instance_label") == [
            ("box", "a.jpg", "<unknown>"), ("box", "c.jpg", "cat"), ("none", "b.jpg", None)]
        assert rows(records.deleted, "image_name", "frame_id", "image_width") == [
            ("<unknown>", 9, 0), ("c.jpg", 2, 640)]
    flat = Snapshot.of_documents(D.read_documents(spark, str(tmp_path)), X.labels(spark))
    assert rows(P.skipped_shapes(flat.shapes)) == [("polygon", 1)]


def test_task_without_frames(spark, tmp_path):
    for records in both(spark, tmp_path, X.document(8, [])):
        assert records.raw().count() == 0


def test_empty_frame_name_fails(spark, tmp_path):
    for records in both(spark, tmp_path, X.document(8, [""])):
        with pytest.raises(PySparkException, match="image name is empty"):
            records.annotations.collect()


def test_broken_documents(spark, tmp_path):
    X.write(tmp_path, X.normal())
    (tmp_path / "99.json").write_text('{"task": {"id": 99,')
    with pytest.raises(Exception, match="(?i)malformed|failfast|FAILED_READ_FILE"):
        D.tasks_table(D.read_documents(spark, str(tmp_path))).collect()
    read = D.read_documents(spark, str(tmp_path), on_error="skip").cache()
    assert counts(extract_records(Snapshot.of_documents(read, X.labels(spark)))) == {"box": 30}
    assert [r[0].rsplit("/", 1)[1] for r in D.broken_documents(read).collect()] == ["99.json"]


def test_updated_at_stands_in(spark, tmp_path):
    doc = X.document(3, ["a.jpg"], date=None, updated_at="2026-03-03")
    for records in both(spark, tmp_path, doc):
        assert records.annotations.first().task_updated_date == "2026-03-03"


def _snapshot(spark, tmp_path):
    docs = [
        X.normal(1, name="Alpha"), X.all_empty(2, name="beta", status="annotation"), X.all_removed(3, name="ALPHA"),
        X.last_removed(4, name="5"), X.all_empty(5, name="other", status="annotation"),
    ]
    return Snapshot.of_documents(D.read_documents(spark, X.write(tmp_path, *docs)), X.labels(spark))


def test_selectors(spark, tmp_path):
    tasks = _snapshot(spark, tmp_path).tasks
    pick = lambda *s: [(r.task_id) for r in P.select_tasks(tasks, list(s)).orderBy("pick").collect()]
    assert pick("alpha") == [1]  # first of two
    assert pick("BETA", 1) == [2, 1]  # selector order
    assert pick("5") == [5]  # an id before a name
    assert pick(" 4 ", "4", "alpha", 1) == [4, 1]  # duplicates collapse
    with pytest.raises(LookupError, match="nope"):
        pick("alpha", "nope")


def test_number_falls_back_to_name(spark):
    tasks = spark.createDataFrame([(1, "77")], "task_id long, task_name string")
    assert P.select_tasks(tasks, ["77"]).first().task_id == 1


def test_fetch_filters_in_order(spark, tmp_path):
    snapshot = _snapshot(spark, tmp_path)
    ignored = ignore_list(spark, {"p": [{"id": 1, "name": "Alpha", "silent": True}, 2]})
    ids = lambda **kw: sorted(r[0] for r in choose_tasks(snapshot.tasks, **kw).select("task_id").collect())
    assert ids(completed_only=True) == [1, 3, 4]
    assert ids(ignored=ignored) == [3, 4, 5]
    assert ids(ignored=ignored, selectors=["alpha"]) == [3]
    with pytest.raises(LookupError):
        ids(ignored=ignored, selectors=["beta"])
    assert rows(P.ignored_report(snapshot.tasks, ignored), "task_id") == [(2,)]
    assert fetch_annotations(snapshot, completed_only=True, selectors=["beta"]).count() == 0
    assert counts(fetch_project(snapshot, selectors=["beta"])) == {"none": 8}


def test_fetch_table_layout_of_nothing(spark, tmp_path):
    table = fetch_annotations(_snapshot(spark, tmp_path), completed_only=True, selectors=[2])
    assert table.schema.fieldNames() == list(S.COLUMNS) and table.count() == 0


def test_find_project(spark):
    projects = spark.createDataFrame([(3, "Cars"), (4, "cats")], "id long, name string")
    assert P.find_project(projects, 9) == 9 and P.find_project(projects, "12") == 12
    assert P.find_project(projects, "cARS ") == 3
    with pytest.raises(LookupError):
        P.find_project(projects, "dogs")


def test_ignore_list_entries(spark):
    raw = {"ignore": {"p": [{"id": "7", "name": "x", "description": "d", "silent": 1}, 8, "9", "z", None, {"name": "y"}, {"id": "q"}],
                      "q": "no list"}}
    got = ignore_list(spark, raw)
    assert rows(got) == [("p", 7, "x", "d", True), ("p", 8, "", "", False), ("p", 9, "", "", False)]
    more = spark.createDataFrame([("p", 8, "dup", "", False), ("r", 8, "new", "", False)], S.IGNORED)
    added = P.ignore_tasks(got, more)
    assert rows(added, "project", "id", "name") == [("p", 7, "x"), ("p", 8, ""), ("p", 9, ""), ("r", 8, "new")]
    assert rows(P.unignore_tasks(added, more), "project", "id") == [("p", 7), ("p", 9)]
    assert rows(P.ignored_counts(added)) == [(None, 4), ("p", 3), ("r", 1)]
    projects = spark.createDataFrame([(1, "z"), (2, "p")], "id long, name string")
    assert rows(P.project_names(projects, added)) == [("p",), ("r",), ("z",)]


def test_attribute_lookup(spark):
    # rows alike stay apart
    data = [(1, [(10, "a"), (11, "b"), (10, "c")]), (2, []), (3, [(5, "z")]), (3, [(5, "z")]), (4, None)]
    df = spark.createDataFrame(data, "k long, attributes array<struct<spec_id:bigint,value:string>>")
    specs = spark.createDataFrame([(10, "x"), (11, "y")], "spec_id long, target string")
    got = A.with_spec_targets(df, specs).orderBy("k").collect()
    assert [[tuple(a) for a in r.attributes] for r in got] == [
        [(10, "a", "x"), (11, "b", "y"), (10, "c", "x")], [], [(5, "z", None)], [(5, "z", None)], []]


@pytest.mark.parametrize("cut", [None, 3])
def test_snapshot_round_trip_through_files(spark, tmp_path, cut):
    docs = D.read_documents(spark, X.write(tmp_path / "in", X.normal(), X.last_removed(), X.all_empty()))
    first = Snapshot.of_documents(docs, X.labels(spark))
    out = snapshot_documents(first, frames_per_document=cut, shapes_per_document=2)
    if cut is None:
        assert out.count() == 3
    write_documents(out, str(tmp_path / "out"))
    again = D.read_documents(spark, str(tmp_path / "out"))
    second = Snapshot.of_documents(again, X.labels(spark))
    order = [c for c in S.COLUMNS if c != "attributes"]
    a, b = extract_records(first), extract_records(second)
    assert rows(a.raw(), *order) == rows(b.raw(), *order)
    assert (tmp_path / "out" / "document=11_task-11").is_dir()


def test_project_document(spark, tmp_path):
    doc = project_document(3, "p", X.labels(spark))
    doc.write.json(str(tmp_path / "p"))
    back = D.labels_table(D.read_project(spark, str(tmp_path / "p")))
    assert rows(back.select("label_id", "label_name", "color", F.to_json("attributes"))) == [
        (1, "cat", "#112233", json.dumps([{"id": 10, "name": "age"}, {"id": 11, "name": "mood"}], separators=(",", ":"))),
        (2, "dog", "", "[]")]


def test_documents_of_both_forms(spark, tmp_path):
    """JSON lines, several documents a file, and pretty documents side by side, with odd file names."""
    folder = X.write(tmp_path / "in", X.normal(1), X.all_removed(2))
    docs = D.read_documents(spark, folder)
    parts = snapshot_documents(Snapshot.of_documents(docs, X.labels(spark)), frames_per_document=3, shapes_per_document=2)
    lines = [r[0] for r in parts.select(F.to_json(F.struct(*parts.columns))).collect()]
    (tmp_path / "in" / "many [1] a%b.json").write_text("\n".join(lines) + "\n")
    pretty = json.dumps(json.loads(lines[0]), indent=2)
    (tmp_path / "in" / "one {x}.json").write_text(pretty)
    for on_error in ("fail", "skip"):
        assert D.read_documents(spark, folder, on_error).count() == len(lines) + 1 + docs.count()
    (tmp_path / "in" / "cut.json").write_text(lines[0] + "\n" + lines[1][:40])
    with pytest.raises(Exception, match="(?i)malformed|parse|corrupt|cut.json"):
        D.read_documents(spark, folder).collect()
    kept = D.read_documents(spark, folder, on_error="skip")
    assert D.good_documents(kept).count() == len(lines) + 2 + docs.count()


def test_task_exported_twice_and_doubled_label(spark, tmp_path):
    old, new = X.normal(1), X.normal(1)
    new["task"]["updated_date"] = "2030-01-01"
    new["data_meta"] = {"frames": [], "deleted_frames": []}
    new["annotations"] = {"shapes": [], "tracks": []}
    docs = D.read_documents(spark, [X.write(tmp_path / "a", new), X.write(tmp_path / "b", old)])
    assert [r.task_updated_date for r in D.tasks_table(docs).collect()] == ["2030-01-01"]
    labels = X.labels(spark)
    once = Snapshot.of_documents(docs, labels)
    twice = Snapshot.of_documents(docs, labels.unionByName(labels))
    assert box_rows(once).count() == box_rows(twice).count() > 0


def test_tracks_survive_an_export(spark, tmp_path):
    made = X.normal(1)
    made["annotations"]["tracks"] = [
        {"id": k, "frame": k, "label_id": 1, "source": "manual", "attributes": [{"spec_id": 10, "value": "v"}],
         "shapes": [X.shape(1, k), X.shape(2, k + 1)], "created_by": "me"} for k in range(7)]
    first = Snapshot.of_documents(D.read_documents(spark, X.write(tmp_path / "in", made)), X.labels(spark))
    write_documents(snapshot_documents(first, frames_per_document=3), str(tmp_path / "out"))
    second = Snapshot.of_documents(D.read_documents(spark, str(tmp_path / "out")), X.labels(spark))
    fields = ["id", "frame", "label_id", "source", F.to_json(F.struct("attributes", "shapes")), "created_by"]
    assert rows(second.tracks, *fields) == rows(first.tracks, *fields) and second.tracks.count() == 7


def test_tracks_of_one_frame_are_dealt_to_documents(spark, tmp_path):
    made = X.normal(1)
    made["annotations"]["tracks"] = [
        {"id": k, "frame": 0, "label_id": 1, "source": "manual", "attributes": [], "shapes": [X.shape(1, k)], "created_by": "me"} for k in range(60)]
    first = Snapshot.of_documents(D.read_documents(spark, X.write(tmp_path / "in", made)), X.labels(spark))
    cut = snapshot_documents(first, frames_per_document=3, shapes_per_document=10)
    sizes = [r[0] for r in cut.select(F.size("annotations.tracks")).collect()]
    assert sum(sizes) == 60 and max(sizes) < 30 and sum(n > 0 for n in sizes) >= 3
    write_documents(cut, str(tmp_path / "out"))
    second = Snapshot.of_documents(D.read_documents(spark, str(tmp_path / "out")), X.labels(spark))
    assert rows(second.tracks, "id") == rows(first.tracks, "id") and rows(second.shapes, "frame_id", "type") == rows(first.shapes, "frame_id", "type")
    # a scaled project has the tracks of its base task in every copy
    assert scale_project(first, 3).tracks.count() == 180
