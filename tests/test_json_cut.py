"""Documents of any layout, cut at their brackets."""

import json
import random

import pytest
from conftest import rows

from boxmill.sources import json_cut
from boxmill.sources.documents import broken_documents, good_documents, read_documents


def blocks(data, size):
    return [data[k : k + size] for k in range(0, len(data), size)]


def value(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind == 0:
        return rng.choice([1, 2.5, None, True])
    if kind < 3:
        return "".join(rng.choice('{}[]"\\,: aé\n') for _ in range(rng.randrange(9)))
    if kind == 3:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {value(rng, 0).__repr__(): value(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_random_documents_in_random_layouts():
    rng = random.Random(5)
    for _ in range(300):
        made = [{"k": value(rng, 4)} for _ in range(rng.randrange(1, 5))]
        spelled = [json.dumps(d, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) for d in made]
        if rng.random() < 0.3:
            text = " [" + " , ".join(spelled) + "]\n"
        else:
            text = rng.choice(["", "\n", " \r\n"]).join(spelled)
        data = text.encode()
        for size in (1, 2, 7, len(data)):
            assert [json.loads(d) for d in json_cut.documents(blocks(data, size))] == made


@pytest.mark.parametrize("text, want", [
    ("", []), (" \n", []), ("[]", []), ('{"a":1', ['{"a":1']), ('{"a":1}}{"b":2}', ['{"a":1}', "}", '{"b":2}']),
    ('{"a":1} x {"b":2}', ['{"a":1}', "x", '{"b":2}']), ('[{"a":1}, 5]', ['{"a":1}', "5"]), ('[{"a":1}', ['{"a":1}', "["]),
    ('{"a":"\\\\"}{"b":"\\""}', ['{"a":"\\\\"}', '{"b":"\\""}']), ("nothing", ["nothing"]),
])
def test_pieces(text, want):
    for size in (1, 3, 100):
        assert [d.decode() for d in json_cut.documents(blocks(text.encode(), size))] == want


def task(k, **more):
    return {"task": {"id": k, "name": f"t}}{{{k}"}, **more}


def test_every_document_of_every_layout(spark, tmp_path):
    layouts = {
        "lines.json": "\n".join(json.dumps(task(k)) for k in range(3)) + "\n\n",
        "pretty.json": "\n".join(json.dumps(task(k), indent=2) for k in range(10, 12)),
        "same line.json": json.dumps(task(20)) + json.dumps(task(21)),
        "lines and more.json": json.dumps(task(30)) + "\n" + json.dumps(task(31)) + " " + json.dumps(task(32)) + "\n"
        + json.dumps(task(33)) + "," + json.dumps(task(34)) + "\n" + json.dumps(task(35)) + ",\n",
        "array.json": json.dumps([task(40), task(41)], indent=1),
        # a line of it is a whole object by itself
        "inner.json": '{"task": {"id": 50}, "annotations": {"shapes": [\n{"id": 1}\n]}}',
        "empty.json": "",
        "blank.json": "\n \n",
    }
    for name, text in layouts.items():
        (tmp_path / name).write_text(text)
    want = [0, 1, 2, 10, 11, 20, 21, 30, 31, 32, 33, 34, 35, 40, 41, 50]
    for options in ({}, {"on_error": "skip"}, {"multi_line": True}):
        got = read_documents(spark, str(tmp_path), **options)
        assert sorted(r.task.id for r in got.collect()) == want
    assert read_documents(spark, str(tmp_path / "inner.json")).first().annotations.shapes[0].id == 1
    lines = read_documents(spark, str(tmp_path / "lines and more.json"), multi_line=False)
    assert sorted(r.task.id for r in lines.collect()) == [30, 31, 32, 33, 34, 35]
    (tmp_path / "cut.json").write_text(json.dumps(task(60), indent=1) + '\n{"task": {"id": 61')
    (tmp_path / "late.json").write_text(json.dumps(task(70)) + "\n" + json.dumps(task(71), indent=1))
    for bad in ("cut.json", "late.json"):
        with pytest.raises(Exception, match="(?i)malformed"):
            read_documents(spark, str(tmp_path / bad)).collect()
    kept = read_documents(spark, str(tmp_path), on_error="skip")
    assert sorted(r.task.id for r in good_documents(kept).collect()) == [*want, 60, 70]
    assert {n.rsplit("/", 1)[1] for (n,) in rows(broken_documents(kept))} == {"cut.json", "late.json"}
