import pytest
from conftest import rows
from pyspark.sql import functions as F

from boxmill.plans.merge import image_winners, merge_datasets, merge_summary
from boxmill.sources.tables import (
    MERGE_COLUMNS,
    TIME_COLUMN,
    read_dataset_csv,
    read_deletion_names,
    read_exclusion_names,
)

LAYOUT = "image_name string, instance_label string, split string, task_updated_date string, n int"


def table(spark, data):
    full = [(r + (None,) * 4)[:4] + (i,) for i, r in enumerate(data)]
    return spark.createDataFrame(full, LAYOUT)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "image_name string")


def merged(spark, old, new, deleted=(), **kw):
    out = merge_datasets(table(spark, old), table(spark, new), names(spark, *deleted), order=["n"], **kw)
    return rows(out, "image_name", "instance_label", "split")


def test_disjoint_and_shared(spark):
    assert merged(spark, [("a", "o"), ("b", "o")], [("b", "n"), ("c", "n")]) == [
        ("a", "o", None), ("b", "n", None), ("c", "n", None)]


def test_deletion_list(spark):
    assert merged(spark, [("a", "o"), ("b", "o")], [("b", "n"), ("c", "n")], ["a", "b", "zz"]) == [("c", "n", None)]


def test_missing_names_are_dropped(spark):
    assert merged(spark, [(None, "o"), ("a", "o")], [(None, "n")]) == [("a", "o", None)]


@pytest.mark.parametrize("old_date, new_date, label", [
    ("2026-01-02", "2026-01-01", "o"), ("2026-01-01", "2026-01-02", "n"), ("2026-01-01", "2026-01-01", "n"),
    ("junk", "2026-01-01", "n"), ("2026-01-01", "junk", "n"), (None, None, "n"),
    ("2026-01-01T12:00:00Z", "2026-01-01T13:00:00+03:00", "o"),
])
def test_by_time(spark, old_date, new_date, label):
    assert merged(spark, [("a", "o", None, old_date)], [("a", "n", None, new_date)], by_time=True) == [("a", label, None)]


def test_by_time_takes_the_latest_date_of_a_side(spark):
    old = [("a", "o", None, "2026-01-01"), ("a", "o", None, "2026-01-05")]
    assert merged(spark, old, [("a", "n", None, "2026-01-04")], by_time=True) == [("a", "o", None)] * 2


def test_by_time_does_not_bring_deleted_images_back(spark):
    old, new = [("a", "o", None, "2026-01-05")], [("a", "n", None, "2026-01-04")]
    assert merged(spark, old, new, ["a"], by_time=True) == []


def test_split_is_carried_over(spark):
    old = [("a", "o", None), ("a", "o", "val"), ("a", "o", "test"), ("b", "o", "train"), ("b", "o", None), ("c", "o", "val")]
    new = [("a", "n", None), ("a", "n", "train"), ("c", "n", "test"), ("d", "n", None)]
    assert merged(spark, old, new) == [
        ("a", "n", "train"), ("a", "n", "val"), ("b", "o", "train"), ("b", "o", "train"), ("c", "n", "test"), ("d", "n", None)]


def test_without_split_columns(spark):
    old, new = table(spark, [("a", "o", "val")]), table(spark, [("a", "n")]).drop("split")
    assert rows(merge_datasets(old, new), "image_name", "split") == [("a", "val")]
    assert "split" not in merge_datasets(old.drop("split"), new).columns


def test_columns_are_widened(spark):
    old, new = table(spark, [("a", "o")]), table(spark, [("b", "n")]).withColumn("extra", F.lit(1))
    assert rows(merge_datasets(old, new), "image_name", "extra") == [("a", None), ("b", 1)]


def test_summary(spark):
    old = table(spark, [("a", "o", "val", "2026-01-09"), ("b", "o"), ("b", "o"), ("x", "o"), ("k", "o", "val", "2026-01-01")])
    new = table(spark, [("a", "n", None, "2026-01-01"), ("c", "n"), ("x", "n"), ("k", "n", "val", "2026-01-02")])
    got = lambda **kw: merge_summary(image_winners(old, new, names(spark, "x", "q"), order=["n"], **kw)).first().asDict()
    assert got() == {"only_old": 1, "only_new": 1, "conflict_new": 2, "conflict_old": 0, "deleted": 1, "total_rows": 5, "split_conflicts": 1}
    assert got(by_time=True) == {"only_old": 1, "only_new": 1, "conflict_new": 1, "conflict_old": 1, "deleted": 1, "total_rows": 5, "split_conflicts": 1}


@pytest.mark.parametrize("old, new", [([], [("a", "n")]), ([("a", "o")], []), ([], [])])
def test_empty_sides(spark, old, new):
    assert merged(spark, old, new) == [(r[0], r[1], None) for r in old + new]
    summary = merge_summary(image_winners(table(spark, old), table(spark, new))).first()
    assert summary.total_rows == len(old + new)


def test_one_winner_per_image(spark):
    winners = image_winners(table(spark, [("a", "o")] * 50 + [("b", "o")]), table(spark, [("a", "n")] * 50))
    assert rows(winners, "image_name", "winner", "old_rows", "new_rows") == [("a", "new", 50, 50), ("b", "old", 1, 0)]


# --- files ---------------------------------------------------------------------
def test_dataset_csv(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text(
        'z_order,image_name,instance_label,bbox_x_tl,occluded,attributes,mine,annotation_id\n'
        '3.0,007.jpg,NA,1.5,True,"{""a"": ""x, \\"" y""}",keep,12345678901\n'
        ',"two\nlines.jpg",,,,{},,\n'
    )
    got = read_dataset_csv(spark, str(path), ["image_name"]).collect()
    assert got[0].asDict() == {
        "z_order": 3, "image_name": "007.jpg", "instance_label": "NA", "bbox_x_tl": 1.5, "occluded": True,
        "attributes": {"a": 'x, " y'}, "mine": "keep", "annotation_id": 12345678901}
    assert got[1].image_name == "two\nlines.jpg" and got[1].instance_label is None and got[1].z_order is None


def test_required_columns(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("image_name,split\na,train\n")
    with pytest.raises(ValueError, match="bbox_x_br, bbox_x_tl"):
        read_dataset_csv(spark, str(path), MERGE_COLUMNS)
    with pytest.raises(ValueError, match=TIME_COLUMN):
        read_dataset_csv(spark, str(path), ["image_name"], require_time=True)


def test_columns_by_name_over_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("image_name,split,instance_label\na.jpg,train,cat\n")
    (tmp_path / "b.csv").write_text('split,instance_label,image_name\nval,"do\ng",b.jpg\n')
    (tmp_path / "c.csv").write_text("image_name\nc.jpg\n")
    paths = [str(tmp_path / f"{x}.csv") for x in "abc"]
    got = read_dataset_csv(spark, paths, ["image_name"])
    assert rows(got, "image_name", "split", "instance_label") == [
        ("a.jpg", "train", "cat"), ("b.jpg", "val", "do\ng"), ("c.jpg", None, None)]
    with pytest.raises(Exception, match="(?i)header"):
        read_dataset_csv(spark, str(tmp_path)).collect()


def test_plain_csv_is_splittable(spark, tmp_path):
    (tmp_path / "big.csv").write_text("image_name,split\n" + "".join(f"image{i}.jpg,train\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = read_dataset_csv(spark, str(tmp_path / "big.csv"))
        assert read.rdd.getNumPartitions() > 2 and read.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_name_lists(spark, tmp_path):
    (tmp_path / "new.csv").write_text("task_id,image_name\n1,a.jpg\n2,\n3,a.jpg\n4,b.jpg\n")
    (tmp_path / "old.txt").write_text("a.jpg\n\n \tb.jpg\t \na.jpg\n\x0b\n")
    for name in ("new.csv", "old.txt"):
        assert rows(read_deletion_names(spark, str(tmp_path / name))) == [("a.jpg",), ("b.jpg",)]
    assert rows(read_exclusion_names(spark, str(tmp_path / "new.csv"))) == [("a.jpg",), ("b.jpg",)]
    assert rows(read_exclusion_names(spark, str(tmp_path / "old.txt"))) == []


def test_dataset_rules(spark):
    from boxmill.operators.validate import check_rows, invalid_rows

    layout = "image_name string, split string, instance_shape string, instance_label string, bbox_x_tl double, bbox_y_tl double, bbox_x_br double, bbox_y_br double, image_path string"
    box = (1.0, 1.0, 2.0, 2.0)
    data = spark.createDataFrame([
        ("ok.jpg", None, "box", "x", *box, None), ("ok2.jpg", "val", "none", None, None, None, None, None, "/a"),
        ("d/x.jpg", None, "none", None, *box, None), ("", None, "none", None, *box, None), ("a", "dev", "none", None, *box, None),
        ("b", None, "oval", None, *box, None), ("c", None, "box", None, *box, None), ("e", None, "box", "x", *box, "rel")], layout)
    assert rows(invalid_rows(data), "image_name") == [("",), ("a",), ("b",), ("c",), ("d/x.jpg",), ("e",)]
    with pytest.raises(ValueError, match="1 rows: box row lacks label or corners; 1 rows: image_name is empty"):
        check_rows(data)
    assert check_rows(data.where("image_name like 'ok%'")).count() == 2
