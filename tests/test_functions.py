import math
import random

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from boxmill import functions as B


def one(spark, expression, **values):
    layout = ", ".join(f"{k} string" for k in values) or "x string"
    df = spark.createDataFrame([tuple(values.values()) or ("",)], layout)
    return df.select(expression).first()[0]


@pytest.mark.parametrize("path, name", [
    ("a.jpg", "a.jpg"), ("d/a.jpg", "a.jpg"), ("/d/e/a.jpg", "a.jpg"), ("a/b/", "b"), ("a//", "a"),
    ("a/.", "a"), ("a/./", "a"), ("./", ""), ("/", ""), ("", ""), (".", ""), ("..", ".."), ("d/.hidden", ".hidden"),
])
def test_base_name(spark, path, name):
    assert one(spark, B.base_name("p"), p=path) == name


@pytest.mark.parametrize("bad", ["", "/", None])
def test_empty_image_name_fails(spark, bad):
    with pytest.raises(PySparkException, match="image name is empty"):
        one(spark, B.checked_name("p"), p=bad)


def test_absolute_path(spark):
    assert one(spark, B.absolute_path("p"), p="/x/a.jpg") == "/x/a.jpg"
    assert one(spark, B.absolute_path("p"), p=None) is None
    with pytest.raises(PySparkException, match="not absolute"):
        one(spark, B.absolute_path("p"), p="x/a.jpg")


@pytest.mark.parametrize("prefix, name, key", [
    ("", "a.jpg", "a.jpg"), ("img", "a.jpg", "img/a.jpg"), ("img", "img/a.jpg", "img/a.jpg"),
    ("img", "img1.jpg", "img1.jpg"),  # a plain string test
])
def test_object_key(spark, prefix, name, key):
    assert one(spark, B.object_key(prefix, "n"), n=name) == key


@pytest.mark.parametrize("prefix, key, name", [
    ("p/q", "p/q/2026-01/a.jpg", "2026-01/a.jpg"), ("p/q", "p/q//a.jpg", "a.jpg"), ("p/q", "p/q/", ""), ("", "/a", "/a"),
])
def test_relative_key(spark, prefix, key, name):
    assert one(spark, B.relative_key(prefix, "k"), k=key) == name


def test_storage_option(spark):
    text = "region=eu&prefix=&prefix=a%2Fb+c&endpoint_url=http%3A%2F%2Fh"
    assert one(spark, B.storage_option("o", "prefix"), o=text) == "a/b c"
    assert one(spark, B.storage_option("o", "endpoint_url"), o=text) == "http://h"
    assert one(spark, B.storage_option("o", "prefix"), o=None) == ""
    assert one(spark, B.storage_option("o", "prefix"), o="xprefix=1") == ""


@pytest.mark.parametrize("text, micros", [
    ("1970-01-01T00:00:01", 1_000_000), ("1970-01-01T00:00:01Z", 1_000_000),
    ("1970-01-01T00:00:01.5Z", 1_500_000), ("1970-01-01 03:00:01+03:00", 1_000_000),
    ("1970-01-01T03:00:01+0300", 1_000_000), ("1970-01-02", 86_400_000_000),
    ("", None), ("junk", None), ("12:00:00", None), (None, None), ("2026-13-45", None),
])
def test_parse_time(spark, text, micros):
    assert one(spark, F.unix_micros(B.parse_time("t")), t=text) == micros


@pytest.mark.parametrize("text, hours", [("1970-01-01T10:00:00+00", 10), ("1970-01-01 10:00:00+03", 7), ("1970-01-01T10:00:00.5-02", 12)])
def test_offsets_of_hours(spark, text, hours):
    assert one(spark, F.unix_seconds(B.parse_time("t")), t=text) == hours * 3600


def test_parse_time_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, F.unix_micros(B.parse_time("t")), t="1970-01-01T00:00:00") == 0
        assert one(spark, F.unix_micros(B.parse_time("t")), t="1970-01-02") == 86_400_000_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("created, owner, name", [
    ("ann", None, "ann"), ("", "bob", "bob"), (None, None, ""),
    ('{"username":"u","name":"n"}', None, "u"), ('{"username":"","name":"n"}', None, "n"),
    (None, '{"name":"o"}', "o"), ('{"id":3}', None, ""),
])
def test_creator_name(spark, created, owner, name):
    assert one(spark, B.creator_name("c", "o"), c=created, o=owner) == name


def test_updated_date(spark):
    assert one(spark, B.updated_date("a", "b"), a=None, b="x") == "x"
    assert one(spark, B.updated_date("a", "b"), a=None, b=None) == ""


def test_repeated_attribute_keeps_place_and_last_value(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["1", "ю", '3"'])], "n array<string>, v array<string>")
    text = df.select(B.attributes_json(B.attributes_map("n", "v"))).first()[0]
    assert text == '{"a": "3\\"", "b": "ю"}'


def test_attributes_json_of_nothing(spark):
    df = spark.createDataFrame([(None,), ({},)], "m map<string,string>")
    assert [r[0] for r in df.select(B.attributes_json("m")).collect()] == ["{}", "{}"]


@pytest.mark.parametrize("name, stem, suffix", [
    ("a.jpg", "a", ".jpg"), ("a.b.JPG", "a.b", ".JPG"), (".hidden", ".hidden", ""), ("a", "a", ""), ("a.", "a.", ""),
])
def test_stem_and_suffix(spark, name, stem, suffix):
    assert one(spark, F.struct(B.stem("n"), B.suffix("n")), n=name) == (stem, suffix)


def test_label_paths(spark):
    assert one(spark, B.labels_folder("p"), p="images/train/images") == "labels/train/labels"
    assert one(spark, B.label_file_path("p"), p="images/train/x.jpg") == "labels/train/x.txt"
    assert one(spark, B.label_file_path("p"), p="val/x.jpg") == "labels/val/x.txt"


@pytest.mark.parametrize("name, slug", [
    ("My Task (1)", "my-task-1"), ("--a  b--", "a-b"), ("???", "task"), ("Привет мир", "привет-мир"),
])
def test_slug(spark, name, slug):
    assert one(spark, B.slug("n"), n=name) == slug


def test_colours_and_names(spark):
    assert one(spark, B.hex_colour("c"), c="#AAbb0C") == "#aabb0c"
    assert one(spark, B.hex_colour("c"), c="#AAbb0") is None
    assert one(spark, B.same_name("a", "b"), a="CaT", b="cAt") is True
    assert one(spark, B.month_name("n", "2026-02"), n="a.jpg") == "2026-02/a.jpg"


def test_frame_file_name_beyond_six_digits(spark):
    df = spark.sql("select 3 c, s, timestamp'2024-01-01 00:00:07.179575' t from values (42L), (1234567L) v(s)")
    names = [r[0] for r in df.select(B.frame_file_name("c", "s", "t")).collect()]
    assert names == ["cam3_000042_20240101T000007_179575.jpg", "cam3_1234567_20240101T000007_179575.jpg"]


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(3)
    values = [rng.uniform(-3000, 3000) for _ in range(4000)] + [i / 8 for i in range(-400, 400)]
    values += [i / 1000 + 0.005 for i in range(2000)] + [0.285, 1.005, 2.675, -0.001]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(B.exact_round("x"), B.fixed("x", 6)).collect()
    for v, (r, text) in zip(values, got):
        assert r == round(v, 2) and math.copysign(1, r) == math.copysign(1, round(v, 2)), v
        assert text == f"{v:.6f}", v


def test_box_formulas_are_inverse(spark):
    df = spark.createDataFrame([(10.0, 20.0, 110.0, 220.0, 640, 480)], "a double,b double,c double,d double,w int,h int")
    n = df.select(*[c.alias(k) for c, k in zip(B.to_normalised("a", "b", "c", "d", "w", "h"), "pqrs")], "w", "h")
    assert tuple(n.first())[:4] == (60 / 640, 120 / 480, 100 / 640, 200 / 480)
    back = n.select(*B.to_pixels("p", "q", "r", "s", "w", "h")).first()
    assert [round(v, 9) for v in back] == [10, 20, 110, 220]


def test_short_points_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "p array<double>")
    with pytest.raises(PySparkException, match="fewer than 4"):
        rows(df.select(*B.corners("p")))


def test_clone_key(spark):
    assert one(spark, B.clone_key("pre/fix", "sub", "t"), t="sub/a.jpg") == "pre/fix/sub/sub/a.jpg"
    assert one(spark, B.clone_key("", "sub", "t"), t="a.jpg") == "sub/a.jpg"


def test_folding_of_every_letter(spark):
    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and (chr(c).casefold() != chr(c) or c % 997 == 0)]
    table = spark.createDataFrame([(c, f"a{c}B{c}") for c in letters] + [("", ""), (None, None)], "c string, name string")
    for r in table.select("c", "name", B.folded("name").alias("key")).collect():
        assert r.key == (r.name.casefold() if r.name is not None else None), r.c
    assert one(spark, B.same_name("a", "b"), a="Straße ΣΑΣ", b="STRASSE σας") is True
