import json

import pictures
import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.operators import selection as P
from boxmill.operators.lookup import first_found
from boxmill.plans import yolo as Y
from boxmill.sinks.files import check_stems, copy_files, write_descriptor, write_label_files
from boxmill.sources.image_sizes import header_size, read_image_sizes, readable, stream_size, unreadable
from boxmill.sources.listing import image_files, list_files, list_objects, search_listing, stem_candidates
from boxmill.sources.yolo_text import class_names, parse_lines, read_label_lines, split_folders


@pytest.mark.parametrize("kind", ["png", "jpeg", "gif", "bmp", "webp", "tiff"])
def test_header_size(kind):
    assert header_size(getattr(pictures, kind)(321, 57)) == (321, 57)
    assert header_size(b"") is None and header_size(b"junk" * 20) is None


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "line string")


def test_parse_lines(spark):
    got = parse_lines(lines(spark, "0 0.5 0.5 0.1 0.2", "  3\t.5  1e-1 1 1 0.75  ", "1 2 3 4", "", "2.9 1 1 1 1"))
    assert rows(got.drop("line")) == [
        (0, 0.5, 0.5, 0.1, 0.2, None), (2, 1.0, 1.0, 1.0, 1.0, None), (3, 0.5, 0.1, 1.0, 1.0, 0.75)]


def test_malformed_numbers(spark):
    bad = lines(spark, "0 a 1 1 1", "1 1 1 1 1", "1.5 1 1 1 1", "1 1 1 1 1 x")
    with pytest.raises(PySparkException, match="not a number"):
        parse_lines(bad).collect()
    good = parse_lines(lines(spark, "0 a 1 1 1", "1 1 1 1 1", "1.5 1 1 1 1"), on_error="skip")
    assert rows(good, "class_id") == [(1,)]
    with pytest.raises(ValueError):
        parse_lines(bad, on_error="ignore")


def test_class_maps(spark, tmp_path):
    assert rows(class_names(spark, {"names": {"10": "b", "9": "a"}})) == [(10, "b"), (9, "a")]
    assert rows(class_names(spark, {0: "x"})) == [(0, "x")]
    assert [r[0] for r in class_names(spark, {"names": {"10": "b", "9": "a"}}).collect()] == [9, 10]
    (tmp_path / "d.yaml").write_text(json.dumps({"names": {"0": "x"}, "val": "images/val", "train": "images/train"}))
    assert rows(class_names(spark, str(tmp_path / "d.yaml"))) == [(0, "x")]
    assert list(split_folders(str(tmp_path / "d.yaml"))) == ["train", "val"]


ROW = dict(image_width=100, image_height=50, instance_shape="box", split="train")


def dataset(spark, *records):
    data = [{**ROW, **dict(zip(("image_name", "instance_label", "box"), r[:3])), **(r[3] if len(r) > 3 else {}), "n": i}
            for i, r in enumerate(records)]
    for d in data:
        box = d.pop("box") or (None,) * 4
        d.update(zip(("bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br"), box))
    layout = S.T.StructType([f for f in S.ANNOTATION.fields if f.name != "attributes"]).add("n", S.T.IntegerType())
    return spark.createDataFrame([tuple(d.get(c) for c in layout.fieldNames()) for d in data], layout)


NONE = {"instance_shape": "none"}


def sample(spark):
    return dataset(
        spark,
        ("b.jpg", "dog", (0.0, 0.0, 10.0, 10.0)), ("a.jpg", "cat", (10.0, 5.0, 30.0, 25.0)),
        ("b.jpg", "cat", (1.0, 1.0, 2.0, 2.0), {"image_width": 999}), ("c.jpg", None, None, {**NONE, "split": "val"}),
        ("a.jpg", None, None, NONE), ("d.jpg", None, None, {"instance_shape": "deleted"}),
    )


def test_to_lines(spark):
    data = sample(spark)
    classes = Y.class_index(data)
    assert rows(classes) == [("cat", 0), ("dog", 1)]
    # the size of an image is that of its first row
    assert rows(Y.yolo_lines(data, classes, ["n"]), "stem", "n", "line") == [
        ("a", 1, "0 0.200000 0.300000 0.200000 0.400000"), ("b", 0, "1 0.050000 0.100000 0.100000 0.200000"),
        ("b", 2, "0 0.015000 0.030000 0.010000 0.020000")]
    assert rows(Y.unlabelled_images(data)) == [("val", "c.jpg", "c")]
    assert [r[0] for r in Y.present_splits(data).collect()] == ["train", "val"]


def test_box_without_label_fails(spark):
    data = dataset(spark, ("a.jpg", None, (0.0, 0.0, 1.0, 1.0)))
    with pytest.raises(PySparkException, match="without a class"):
        Y.yolo_lines(data, Y.class_index(data), ["n"]).collect()


def test_missing_splits(spark):
    data = dataset(spark, *[(f"i{k:02d}.jpg", "x", None, {"split": None if k % 2 else ""}) for k in range(12)], ("ok.jpg", "x", None))
    with pytest.raises(ValueError, match=r"12 images have no split, such as: i00.jpg, .*i09.jpg$"):
        P.check_splits(data)
    assert P.check_splits(data.where("image_name = 'ok.jpg'")).count() == 1


def test_stem_collision(spark):
    data = dataset(spark, ("a.jpg", "x", None), ("a.png", "x", None), ("a.jpg", "x", None, {"split": "val"}))
    with pytest.raises(ValueError, match="train/a"):
        check_stems(data)


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_label_files_and_back(spark, tmp_path, coalesce):
    """One image holds most lines, so with small slices its file is joined from segments."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        boxes = [("hot.jpg", f"l{i % 3}", (i / 7, 1.0, i / 7 + 20.0, 30.0)) for i in range(300)]
        boxes += [(f"im{i}.jpg", "l1", (i / 9, 2.0, 50.0, 40.0), {"split": "val" if i % 2 else "train"}) for i in range(20)]
        data = dataset(spark, *boxes, ("empty.jpg", None, None, {**NONE, "split": "val"}))
        out = str(tmp_path / "ds")
        classes = Y.class_index(data)
        text = Y.yolo_lines(data, classes, ["n"])
        manifest = write_label_files(text, Y.unlabelled_images(data), out, ["n"])
        assert manifest.count() == 22 and manifest.agg(F.sum("lines")).first()[0] == 320
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = {}
    for r in text.orderBy("n").collect():
        expected.setdefault(f"{r.split}/{r.stem}.txt", []).append(r.line)
    for name, content in expected.items():
        assert (tmp_path / "ds/labels" / name).read_text() == "\n".join(content) + "\n"
    assert (tmp_path / "ds/labels/val/empty.txt").read_text() == ""
    assert not (tmp_path / "ds/.segments").exists()
    write_descriptor(data, classes, out)
    assert (tmp_path / "ds/dataset.yaml").read_text() == (
        f'path: "{out}"\ntrain: images/train\nval: images/val\nnames:\n  0: "l0"\n  1: "l1"\n  2: "l2"\n')

    for r in data.select("split", "image_name").distinct().collect():
        place = tmp_path / "ds/images" / r.split
        place.mkdir(parents=True, exist_ok=True)
        (place / r.image_name).write_bytes(pictures.png(100, 50))
    (tmp_path / "ds/images/train/notes.md").write_text("no image")
    back = Y.from_yolo_dataset(spark, out)
    assert back.schema.fieldNames() == list(S.COLUMNS)
    numbers = [r.annotation_id for r in back.where("instance_shape = 'box'").collect()]
    assert sorted(numbers) == list(range(1, 321))
    frames = {r.frame_id: (r.split, r.image_name) for r in back.collect()}
    order = {"train": 0, "val": 1}
    assert [frames[i] for i in range(22)] == sorted(frames.values(), key=lambda f: (order[f[0]], f[1]))
    none = back.where("instance_shape = 'none'").first()
    assert (none.image_name, none.occluded, none.z_order, none.source, none.task_name) == ("empty.jpg", None, None, "yolo", "yolo")
    # per image and place the boxes come back within a pixel
    place = lambda d, by: sorted((r.image_name, r[by], r.bbox_x_tl, r.bbox_y_br) for r in d.where("instance_shape = 'box'").collect())
    for a, b in zip(place(data, "n"), place(back, "annotation_id")):
        assert a[0] == b[0] and abs(a[2] - b[2]) < 0.02 and abs(a[3] - b[3]) < 0.02


def test_from_dataset_without_labels_or_folders(spark, tmp_path):
    (tmp_path / "dataset.yaml").write_text("train: images/train\nval: images/val\nnames: {0: a}\n")
    (tmp_path / "images/train").mkdir(parents=True)
    (tmp_path / "images/train/x.png").write_bytes(pictures.png(5, 6))
    got = Y.from_yolo_dataset(spark, str(tmp_path))
    assert rows(got, "image_name", "instance_shape", "image_width", "split") == [("x.png", "none", 5, "train")]
    (tmp_path / "dataset.yaml").write_text("train: images/train\n")
    with pytest.raises(ValueError, match="no class names"):
        Y.from_yolo_dataset(spark, str(tmp_path))


def test_predictions(spark, tmp_path):
    folder, pool = tmp_path / "pred", tmp_path / "pool"
    (folder / "b").mkdir(parents=True)
    (folder / "images").mkdir()
    (pool / "images").mkdir(parents=True)
    (folder / "b/x.txt").write_text("0 0.5 0.5 0.5 0.5 0.9\n1 0.1 0.1 0.1\n7 0.25 0.5 0.5 1\n")
    (folder / "a.txt").write_text("0 0.5 0.5 1 1\n")
    (folder / "short.txt").write_text("0 1 1\n")
    (folder / "lost.txt").write_text("0 0.5 0.5 1 1\n")
    (pool / "a.jpg").write_bytes(pictures.jpeg(10, 10))
    (folder / "images/a.png").write_bytes(pictures.png(20, 40))
    (pool / "images/x.png").write_bytes(pictures.png(100, 200))
    got, missing = Y.from_yolo_predictions(spark, str(folder), {"0": "cat"}, [str(pool)])
    columns = ["frame_id", "annotation_id", "image_name", "instance_label", "bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br", "confidence", "split"]
    assert rows(got, *columns) == [
        (0, 1, "a.png", "cat", 0.0, 0.0, 20.0, 40.0, None, None),
        (1, 2, "x.png", "cat", 25.0, 50.0, 75.0, 150.0, 0.9, None),
        (1, 3, "x.png", "class_7", 0.0, 0.0, 50.0, 200.0, None, None)]
    assert rows(missing, "stem") == [("lost",)]


def test_stem_precedence(spark, tmp_path):
    files = [("d0", "images/a.jpg"), ("d0", "a.png"), ("d1", "a.jpg"), ("d1", "images/b.bmp"), ("d1", "images/b.jpeg"), ("d0", "deep/er/c.jpg"), ("d0", "other/c.jpg")]
    for d, name in files:
        (tmp_path / d / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / d / name).write_bytes(pictures.png(1, 1))
    listing = search_listing(spark, [str(tmp_path / "d0"), str(tmp_path / "d1")])
    got = first_found(stem_candidates(listing), ["dir_rank", "sub_rank", "ext_rank"], by="stem")
    assert [(s, p.rsplit("/d", 1)[1]) for s, p in rows(got)] == [("a", "0/a.png"), ("b", "1/images/b.jpeg")]


def test_listing_and_sizes(spark, tmp_path):
    for name, data in {"x y/a+1.png": pictures.png(3, 4), "b.JPG": pictures.jpeg(5, 6), "c.txt": b"t", "bad.png": b"no", "big.tiff": pictures.tiff(7, 8)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert rows(list_files(spark, str(tmp_path)), "name", "length")[:2] == [("b.JPG", len(pictures.jpeg(5, 6))), ("bad.png", 2)]
    assert rows(image_files(list_files(spark, str(tmp_path))), "name") == [("b.JPG",), ("bad.png",), ("big.tiff",), ("x y/a+1.png",)]
    assert rows(list_objects(spark, str(tmp_path), "x y")) == [("x y/a+1.png", "a+1.png")]
    assert rows(read_image_sizes(spark, str(tmp_path)), "name", "image_width", "image_height") == [
        ("b.JPG", 5, 6), ("bad.png", None, None), ("big.tiff", 7, 8), ("x y/a+1.png", 3, 4)]
    assert {r[1:] for r in rows(read_image_sizes(spark, str(tmp_path), "first"), "name", "image_width", "image_height")} == {(5, 6)}


def test_size_behind_a_long_header(spark, tmp_path):
    note = b"".join(b"\xff\xe1" + (65535).to_bytes(2, "big") + b"x" * 65533 for _ in range(20))
    plain = pictures.jpeg(31, 17)
    (tmp_path / "long.jpg").write_bytes(plain[:2] + note + plain[2:])
    (tmp_path / "c.Png").write_bytes(pictures.png(2, 9))
    (tmp_path / "cut.png").write_bytes(pictures.png(2, 9)[:18])
    sizes = read_image_sizes(spark, str(tmp_path))
    assert rows(readable(sizes), "name", "image_width", "image_height") == [("c.Png", 2, 9), ("long.jpg", 31, 17)]
    assert rows(unreadable(sizes), "name") == [("cut.png",)]
    assert "content" not in sizes._jdf.queryExecution().executedPlan().toString()


def test_one_bad_address_among_good_ones(spark, tmp_path):
    (tmp_path / "a").write_text("data")
    plan = spark.createDataFrame([
        ("a", str(tmp_path / "a"), str(tmp_path / "new/a")), ("b", "nowhere://x/y", str(tmp_path / "new/b")), ("c", None, "x")],
        "name string, src string, dst string")
    report = copy_files(plan, wait=0.01)
    assert rows(report, "name", "status") == [("a", "copied"), ("b", "failed"), ("c", "failed")]
    assert rows(copy_files(plan, wait=0.01), "name", "status")[0] == ("a", "existing")


def test_line_order_of_split_files(spark, tmp_path):
    content = [f"{i} 0.5 0.5 0.5 0.5" for i in range(3000)]
    (tmp_path / "one.txt").write_text("\n".join(content))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = read_label_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 2
        assert [r.line for r in sorted(read.collect(), key=lambda r: (r.block, r.pos))] == content
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_copy_files(spark, tmp_path):
    (tmp_path / "a").write_text("data")
    (tmp_path / "there").write_text("old")
    plan = spark.createDataFrame([
        ("a", str(tmp_path / "a"), str(tmp_path / "new/deep/a")), ("b", str(tmp_path / "none"), str(tmp_path / "new/b")),
        ("c", str(tmp_path / "a"), str(tmp_path / "there"))], "name string, src string, dst string")
    report = copy_files(plan, wait=0.01)
    assert rows(report, "name", "status") == [("a", "copied"), ("b", "failed"), ("c", "existing")]
    assert (tmp_path / "new/deep/a").read_text() == "data" and (tmp_path / "there").read_text() == "old"
    assert "FileNotFound" in report.where("name = 'b'").first().error


def test_shapes_for_an_upload(spark):
    text = parse_lines(spark.createDataFrame([("train", "a", "0 0.5 0.5 1 1"), ("train", "a", "9 0.5 0.5 1 1")], "split string, stem string, line string"))
    images = spark.createDataFrame([("train", "a", 4, 10, 20)], "split string, stem string, frame_id int, image_width int, image_height int")
    classes = class_names(spark, {0: "cat"})
    labels = spark.createDataFrame([(77, "cat")], "label_id long, label_name string")
    got = Y.shapes_from_lines(text, images, classes, labels).collect()
    assert [(r.frame_id, r.label_id, r.points) for r in got] == [(4, 77, [0.0, 0.0, 10.0, 20.0])]


def test_listing_of_any_names_and_rounds(spark, tmp_path, monkeypatch):
    from boxmill.sources import listing

    names = ["a.jpg", "_DSC1.jpg", "sub/_b.png", ".hid.jpg", "_x=1.jpg", "empty.jpg", "_d/.e/f/g/h.jpg", "_SUCCESS"]
    names += [f"n{i % 7}/m{i % 3}/{i}.jpg" for i in range(80)]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else name.encode())
    (tmp_path / "hollow/folder").mkdir(parents=True)
    for limit in (listing.TASK_ENTRIES, 5, 1):  # also with many rounds
        monkeypatch.setattr(listing, "TASK_ENTRIES", limit)
        for root in (str(tmp_path), f"file://{tmp_path}/"):
            got = {r.name: r for r in list_files(spark, root).collect()}
            assert sorted(got) == sorted(names) and got["empty.jpg"].length == 0
            assert got["_DSC1.jpg"].path == f"{root.rstrip('/')}/_DSC1.jpg" and got["a.jpg"].modified is not None
    assert rows(list_objects(spark, str(tmp_path), "_d")) == [("_d/.e/f/g/h.jpg", ".e/f/g/h.jpg")]
    assert list_files(spark, str(tmp_path / "hollow")).count() == 0
    with pytest.raises(Exception, match="No such file"):
        list_files(spark, str(tmp_path / "nowhere"))


def test_two_attempts_of_a_task_leave_one_set_of_files(tmp_path, monkeypatch):
    """Both attempts run to their ends, or one is cut off in the middle; readers see whole files only."""
    import pandas as pd
    import pyspark
    from boxmill.sinks import files

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(pyspark, "TaskContext", Task)
    monkeypatch.setattr(files, "_HELD_BYTES", 40)
    table = pd.DataFrame([("train", f"i{k // 7}", f"{k} 0.5 0.5 0.5 0.5") for k in range(70)], columns=["split", "stem", "line"])
    root = str(tmp_path)
    cut = files._emit(iter([table[:30], table[30:]]), root, root)
    next(cut)
    both = [pd.concat(list(files._emit(iter([table[:33], table[33:]]), root, root))) for _ in range(2)]
    cut.close()
    for manifest in both:
        assert manifest.lines.tolist() == [7] * 10 and manifest.final.tolist() == [False, *[True] * 8, False]
        for r in manifest.itertuples():
            with open(r.path) as text:
                assert text.read().split("\n")[:-1] == table[table.stem == r.stem].line.tolist()
    assert set(both[0].path[~both[0].final]) & set(both[1].path[~both[1].final]) == set()
    assert sorted(p.name for p in (tmp_path / "labels/train").iterdir()) == [f"i{k}.txt" for k in range(1, 9)]
    plan = [pd.DataFrame({"name": ["a"], "src": [both[0].path.iloc[1]], "dst": [f"{root}/copy/a"]})]
    assert [next(files._copy(iter(plan), 1, 0)).status.tolist() for _ in range(2)] == [["copied"], ["existing"]]
    assert [p.name for p in (tmp_path / "copy").iterdir()] == ["a"]

    def broken():
        with files._published(files.open_filesystem(root)[0], f"{root}/copy/b") as out:
            out.write(b"half")
            raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        broken()
    assert [p.name for p in (tmp_path / "copy").iterdir()] == ["a"]


def test_size_of_a_long_picture_takes_kilobytes():
    class Sparse:
        """A file of zeros but for some pieces; counts what is read."""

        def __init__(self, length, pieces):
            self.length, self.pieces, self.at, self.taken = length, pieces, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            low, high = self.at, min(self.at + n, self.length)
            out = bytearray(max(0, high - low))
            for start, data in self.pieces.items():
                for i, byte in enumerate(data):
                    if low <= start + i < high:
                        out[start + i - low] = byte
            self.at, self.taken = high, self.taken + len(out)
            return bytes(out)

    whole = pictures.tiff(4000, 3000)
    far = (1 << 30) - 100
    late = Sparse(1 << 30, {0: b"II*\0" + far.to_bytes(4, "little"), far: whole[300:]})
    assert stream_size(late) == (4000, 3000) and late.taken < 1 << 16
    # a JPEG whose size follows sixteen full segments
    segment = b"\xff\xe2\xff\xff"
    behind = Sparse(2 + 16 * 65537 + 40, {0: b"\xff\xd8", **{2 + 65537 * i: segment for i in range(16)}, 2 + 16 * 65537: pictures.jpeg(31, 17)[20:]})
    assert stream_size(behind) == (31, 17) and behind.taken < 17 * (1 << 13) + 1
    assert stream_size(Sparse(10, {0: b"II*\0" + far.to_bytes(4, "little")})) is None
