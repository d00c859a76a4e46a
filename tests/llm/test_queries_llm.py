"""The registered queries on the driver tables, and the pipeline stage by stage."""

import os
import re
import zlib
from html import unescape

import numpy as np
import pytest

import __spark_entry__ as entry
import brute
import corpus_pipeline
from boxmill.llm import bpe, pfair, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def table(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_all_are_registered():
    found = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, name):
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(entry.__file__)), "tools"))
    check = pytest.importorskip("check")
    ok, note = check.compare(spark, check.connect(FOLDER), name, FOLDER)
    assert ok, note


def test_main_text_of_the_pages(spark):
    """In these tables the text is what <article> holds, block by block."""
    pages = {r.page_id: r.html for r in table(spark, "pages").collect()}
    for r in queries.op1_html_cut(spark, FOLDER).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_near_duplicates_of_the_documents(spark):
    want = brute.near_classes([(r.doc_id, r.text) for r in table(spark, "documents").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_minmax(spark, FOLDER).collect()}
    assert got == want


@pytest.mark.parametrize("name, label, parts, held, least", [
    ("op4_byte_cnn", "quality", 4, 2, 0.95), ("op5_nnpu", "toxic", 3, 1, 0.9),
])
def test_held_out_accuracy(spark, name, label, parts, held, least):
    folder = FOLDER.replace("0.001", "0.01")
    truth = {r.doc_id: r[label] for r in table(spark, "labels", folder).collect()}
    rows = getattr(queries, name)(spark, folder).collect()
    assert len(rows) == table(spark, "documents", folder).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held) for r in rows)
    known = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(known) >= least


def test_nearest_recall(spark):
    rows = table(spark, "embeddings").collect()
    ids, held = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.op3_hilbert(spark, FOLDER).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = wanted = 0
    for n in np.flatnonzero(ids % 20 == 0):
        score = held @ held[n]
        score[n] = -9
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hits, wanted = hits + len(best & got[ids[n]]), wanted + len(best)
    assert hits >= 0.9 * wanted


def test_pipeline_stage_by_stage(spark):
    """Each stage against what it should do to its own input."""
    docs = table(spark, "documents")
    extra = docs.limit(0).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (10**6, "", None, "src1", 0), (10**6, "", None, "src1", 0)], docs.schema))
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "encode":
            assert out.columns == docs.columns
        seen[name] = ([tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()])
        docs = out.cache()
    before, after = seen["quality"]
    assert set(after) <= set(before) and len(after) >= 0.6 * len(before)
    before, after = seen["site lines"]
    want = brute.site_lines([(r[3], r[1]) for r in before], 0.1, 5)
    assert sorted(map(repr, [(r[0], w[2]) for r, w in zip(before, want)])) == sorted(repr(r[:2]) for r in after)
    before, after = seen["near copies"]
    classes = brute.near_classes([(r[0], r[1]) for r in before if r[0] is not None])
    kept = sorted(r[0] for r in after if r[0] is not None)
    assert kept == sorted(k for k, (_, top) in classes.items() if k == top)
    assert sum(r[0] is None for r in after) == sum(r[0] is None for r in before)
    before, after = seen["mix"]
    assert sorted(map(repr, before)) == sorted(map(repr, after))
    sizes = {}
    for r in after:
        k = r[3] if r[3] in queries.MIX_WEIGHTS else pfair.OTHER
        sizes[k] = sizes.get(k, 0) + 1
    want = brute.earliest_deadline({k: -(-n // pfair.BLOCK_ROWS) for k, n in sizes.items()}, queries.MIX_WEIGHTS)
    order = [k for k, _ in want for _ in range(pfair.BLOCK_ROWS)]
    runs = [r[3] if r[3] in queries.MIX_WEIGHTS else pfair.OTHER for r in after]
    assert [k for n, k in enumerate(runs) if n == 0 or runs[n - 1] != k] == [
        k for n, k in enumerate(order) if n == 0 or order[n - 1] != k
    ]
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    table_of = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_of, special_tokens={})
    before, after = seen["encode"]
    assert sorted(repr((r[0], len(plain.encode_ordinary(r[1] or "")))) for r in before) == sorted(repr(r[:2]) for r in after)
