"""CSV with quoted line breaks, read in blocks, against the whole-file reader."""

import csv
import io
import random

import pytest
from conftest import rows

from boxmill.sources import csv_cut
from boxmill.sources.csv_cut import BEFORE, composed, blocks_of, read_cut_csv
from boxmill.sources.tables import read_dataset_csv

FIELDS = ["plain", "a,b", 'say "so"', "two\nlines", '"', '""\n""', "ü\r\nß", "x" * 40, "\n\n,\n", "", None]


def table(n, seed=5):
    rng = random.Random(seed)
    return [[f"i{i}", *rng.choices(FIELDS, k=3)] for i in range(n)]


def written(data):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    writer.writerows([["image_name", "b", "c", "d"], *data])
    return out.getvalue()


def test_maps_of_bytes_compose():
    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choices(b'",\nab\r', k=rng.randrange(30)))
        state = start = rng.randrange(4)
        for byte in data:
            state = csv_cut._next_state(state, byte)
        at = rng.randrange(len(data) + 1)
        assert composed(data) >> 2 * start & 3 == state
        assert composed(data[at:], composed(data[:at])) == composed(data)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_blocks_own_every_record_once(monkeypatch, block):
    monkeypatch.setattr(csv_cut, "STEP_BYTES", 5)
    data = table(40)
    text = written(data).encode()
    # the states by the plain way
    state, wanted = BEFORE, []
    for at, byte in enumerate(text):
        if at % block == 0:
            wanted.append((at, state))
        state = csv_cut._next_state(state, byte)
    got = []
    for low, state in wanted:
        part = io.BytesIO(text)
        got += csv_cut._records(part, low, min(low + block, len(text)), state, ["image_name", "b", "c", "d"], True)
    assert got == [[v or None for v in r] for r in data]


def test_one_file_by_many_tasks(spark, tmp_path):
    data = table(300)
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.csv").write_bytes(written(data[:200]).encode("utf-8-sig"))
    (tmp_path / "f/b c.csv").write_bytes(written(data[200:]).encode())
    (tmp_path / "f/empty.csv").write_bytes(b"")
    cut = read_cut_csv(spark, str(tmp_path / "f"), ["image_name", "b", "c", "d"], block=500)
    assert cut.rdd.getNumPartitions() == blocks_of(spark, str(tmp_path / "f"), 500).count() > 20
    want = sorted([tuple(v or None for v in r) for r in data], key=str)
    assert sorted(map(tuple, cut.collect()), key=str) == want
    assert sorted(map(tuple, read_dataset_csv(spark, str(tmp_path / "f")).collect()), key=str) == want


def test_a_quote_in_a_plain_field_is_a_letter(spark, tmp_path):
    (tmp_path / "a.csv").write_text('image_name,n\n5" pipe,1\n"two\nlines",2\n6" pipe,3\n')
    for block in (3, 8, 100):
        got = rows(read_cut_csv(spark, str(tmp_path / "a.csv"), ["image_name", "n"], block))
        assert got == [('5" pipe', "1"), ('6" pipe', "3"), ("two\nlines", "2")]


def test_uneven_rows_and_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('image_name,n\nx\n\n"y\n",2,3\n')
    assert rows(read_cut_csv(spark, str(tmp_path / "a.csv"), ["image_name", "n"])) == [("x", None), ("y\n", "2")]
    with pytest.raises(Exception, match="header"):
        read_cut_csv(spark, str(tmp_path / "a.csv"), ["image_name", "k"]).collect()
