"""The order of the mix through the written table, and texts that share an id."""

import pytest

import corpus_pipeline
from boxmill.llm import pfair

FOLDER = "/root/testdata/sf0.001"


def written(spark, tmp_path, monkeypatch, weights):
    """(ids of the mixed table as it was written, ids of the encoded rows by their places)."""
    monkeypatch.setattr(corpus_pipeline, "MIX_WEIGHTS", weights)
    # a row of each size: the reader takes large files first
    rows = [(k, f"{k} " + "word " * (k * 37 % 400), "en", f"src{k % 3}", k) for k in range(700)]
    rows += [(None, None, None, None, None), (7, "again", "en", "src1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix(spark, docs, FOLDER)
    path = str(tmp_path / "-".join(map(str, weights.values())))
    mixed.write.parquet(path)
    out = corpus_pipeline.encode(spark, spark.read.parquet(path), FOLDER).collect()
    assert sorted(r.place for r in out) == list(range(len(rows)))
    return [r.doc_id for r in mixed.collect()], [r.doc_id for r in sorted(out, key=lambda r: r.place)]


def test_order_of_the_mix_is_read_back(spark, tmp_path, monkeypatch):
    want, got = written(spark, tmp_path, monkeypatch, {"src0": 6, "src1": 1, "src2": 1, pfair.OTHER: 1})
    assert got == want
    even, read = written(spark, tmp_path, monkeypatch, {"src0": 1, "src1": 1, "src2": 1, pfair.OTHER: 1})
    assert read == even and even != want


def test_parts_go_by_number():
    names = ["part-100000-a-c000.snappy.parquet", "part-99999-a-c000.snappy.parquet", "part-00002-a-c001.parquet", "part-00002-a-c000.parquet"]
    assert sorted(names, key=corpus_pipeline._part) == names[::-1]
    with pytest.raises(ValueError):
        corpus_pipeline._part("other.parquet")


def test_near_copies_of_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (5, None), (5, None), (5, ""), (9, a), (9, None), (12, c), (13, c), (14, " "), (None, a), (None, a)]
    docs = spark.createDataFrame([(*r, "en", "src1", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, FOLDER)
    want = [(5, a), (5, b), (5, None), (5, ""), (9, None), (12, c), (14, " "), (None, a), (None, a)]
    assert sorted((tuple(r[:2]) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_stages_with_clashing_names_and_maps(spark):
    """Columns that are called as something inside a stage, and a column of a type without an order."""
    names = ["rows", "print", "row", "quality", "file", "start", "place", "_rows", "_quality", "_row"]
    rows = [(k // 2, f"text {k // 2} " * 9, "en", "src1", 1, {"k": k % 2}, *["x"] * len(names)) for k in range(40)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, tags map<string, int>, "
    docs = spark.createDataFrame(rows, kinds + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() > 0
    out = corpus_pipeline.drop_near_copies(spark, docs, FOLDER).collect()
    assert len({r.doc_id for r in out}) == len({r.text for r in out})
    assert corpus_pipeline.encode(spark, docs, FOLDER).count() == 40
    assert corpus_pipeline.keep_good(spark, docs, FOLDER).columns == docs.columns
