"""Pages, archives and vectors against plain versions."""

import io
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxmill.llm import hilbert, html_cut, warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><div class="logo">Site name</div><nav><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></nav></header>
<div class="cookie-notice">We use cookies to improve your visit. Accept?</div>
<div id="main" class="content"><h1>The title of the page</h1>
<p><b>First paragraph of the story with quite some words in it,<br> to make it long enough &amp so on.
<p>Short.</p><div class="ad-box">Buy now! The best offer of the year, today only, for all of our readers.</div>
<p>Second   paragraph&nbsp;with <a href=z>a link</a> and &lt;markup&gt; in it, and an ending.</p>
<form><label>Your name and whatever else you would like to tell us</label><input><button>Send</button></form></div>
<aside><p>A sidebar paragraph that is about as long as a real paragraph of the article would be, with a stop.</p></aside>
<section class="comments"><div class="comment"><p>Reader one says that this is the best article that they ever read.</p></div></section>
<footer><p>Copyright 2020 the site. All rights reserved by the company that made this long footer.</p></footer>
<script>if (a<b) {document.write("<p>x</p>")}</script></body></html>"""
TEXT = """The title of the page
First paragraph of the story with quite some words in it, to make it long enough & so on.
Short.
Second paragraph with a link and <markup> in it, and an ending."""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/\r\nx y", PAGE), (2, None, None), (3, "u", ""), (4, "http://b/1", PAGE), (5, "http://c/é", "<p>" + "long text. " * 50_000)]
    rows += [(4, "http://b/1", PAGE), (6, "u", ""), (None, "u", PAGE), (None, None, "only without an id")]
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")


def test_main_text(pages, spark):
    got = html_cut.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    assert found[1].text == TEXT and found[1].n_chars == len(TEXT)
    assert found[2].text == found[3].text == "" and found[2].n_chars == 0
    assert found[5].text == ("long text. " * 50_000).strip()
    assert got.count() == 9
    assert html_cut.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("page", ["<", "<p", "</p></div>", "<!--", "<script>a", "<a href='", "&#xffffffff;&bogus; &", "<p " + "a=\"" * 2000, "x" * 10, "<div>" * 3000])
def test_broken_markup(page):
    assert isinstance(html_cut.main_text(page), str)


def test_article_beats_chrome():
    page = "<article><header><h1>Title</h1></header><p>One.</p><p>Two.<div class='related'><a>More of it</a></div></article><div class=sidebar>Other things.</div>"
    assert html_cut.main_text(page) == "Title\nOne.\nTwo."


def test_cut_is_the_least():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        leaning = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side):
            own = sum(abs(x) for x, s in zip(leaning, side) if (x > 0) != bool(s))
            return own + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost(s) for s in itertools.product([0, 1], repeat=n))
        assert cost(html_cut.min_cut(leaning, edges)) == pytest.approx(best)


def test_archives(pages, spark, tmp_path):
    archives = warc.write_archives(pages, str(tmp_path / "out"), archive_bytes=1000)
    assert archives.agg(F.sum("records")).first()[0] == 9 and archives.count() > 2
    read = warc.read_archives(archives).collect()
    assert len(read) == 9
    payload = {r.record_id: bytes(r.payload).decode() for r in read if r.record_type == "response"}
    assert payload["urn:page:4"] == PAGE and payload["urn:page:none"] == "only without an id"
    got = sorted(
        ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(spark, pages).collect()), key=repr
    )
    n, m = len(PAGE.encode()), len("<p>" + "long text. " * 50_000)
    assert got == sorted(
        [(1, n, "revisit", 4), (4, n, "response", None), (4, n, "response", None), (None, n, "revisit", 4),
         (2, 0, "revisit", 6), (3, 0, "revisit", 6), (6, 0, "response", None), (5, m, "response", None),
         (None, 18, "response", None)], key=repr)
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_small_payloads_stay_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    read = warc.read_archives(warc.write_archives(pages, str(tmp_path / "out"), min_bytes=3))
    assert {r.record_id[9:]: r.record_type for r in read.collect()} == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_one_member_per_record_and_damage():
    whole = [warc._member(warc._record("response", f"urn:page:{k}", "http://x", b"p" * k * 900_000, None, warc.DATE)) for k in range(4)]
    data = b"".join(whole)
    got = list(warc.records(io.BytesIO(data), "f"))
    assert [r["payload_bytes"] for r in got] == [0, 900_000, 1_800_000, 2_700_000]
    assert got[0]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(io.BytesIO(data[:-9]), "f"))
    record = warc._record("response", "urn:page:1", "u", b"abc", None, warc.DATE)
    with pytest.raises(ValueError, match="does not match"):
        list(warc.records(io.BytesIO(warc._member(record.replace(b"abc", b"abd"))), "f"))
    with pytest.raises(ValueError, match="does not end"):
        list(warc.records(io.BytesIO(warc._member(record + b"x")), "f"))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(io.BytesIO(warc._member(b"GET / HTTP/1.1\r\n\r\n")), "f"))


def test_hilbert_curve_is_one_path():
    for bits, axes in ((1, 2), (3, 2), (3, 3), (2, 4), (4, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        place = hilbert.hilbert_index(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1).max() == 1


def exact(rows, asked, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or len(v) != 8 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, tuple(v)), tuple(v))
    ids, held = np.array(sorted(good)), np.array([good[i] for i in sorted(good)])
    out = {}
    for n, q in enumerate(ids):
        if asked(q):
            score = (held * held[n]).sum(axis=1)
            order = [m for m in np.lexsort((ids, -score)) if m != n][:k]
            out[int(q)] = [(int(ids[m]), float(score[m])) for m in order]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(int(i), [float(x) for x in centres[i % 12] + rng.normal(size=8) * 0.3]) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(60)]  # a group of copies
    rows += [(2**60 + 20 * i, rows[1 + i][1]) for i in range(3)]  # ids beyond the whole numbers of a double
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7)]
    rows += [(905, [1.0, 2.0]), (906, []), (None, rows[3][1]), rows[40], rows[40], (-3, [-x for x in rows[5][1]])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(5)
    got = {}
    for r in hilbert.nearest(vectors, F.col("id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(rows, lambda q: q % 20 == 0, 20)
    assert set(got) == set(want) and 900 not in got
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
        hits += len({f[1] for f in found} & {w[0] for w in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))
    # all copies of query 0's vector are as near; the smallest ids come first
    assert [f[1] for f in got[0]][:3] == [w[0] for w in want[0]][:3]


def test_fewer_candidates_than_wanted(spark):
    vectors = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.5]), (40, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hilbert.nearest(vectors, F.col("id") % 20 == 0).collect())
    assert got == [(20, 1, 21, 0.5), (20, 2, 40, 0.0), (40, 1, 21, 0.5), (40, 2, 20, 0.0)]
    assert hilbert.nearest(vectors.limit(0), F.col("id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert hilbert.nearest(one, F.col("id") % 20 == 0).count() == 0


def test_nearest_in_bounded_groups(spark, monkeypatch):
    """Small blocks, all rows queries, a copied vector: a group meets one block and one stretch; results are exact."""
    rng = np.random.default_rng(8)
    points = rng.normal(size=(600, 8)).astype(np.float32)
    points[400:] = points[0]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(hilbert, "SMALL_BLOCK", 16)
    monkeypatch.setattr(hilbert, "BLOCK", 16 * 8)
    monkeypatch.setattr(hilbert, "STRETCH", 64)
    plain = hilbert._best

    def bounded(pdf, k):
        assert (~pdf["asks"]).sum() <= 16 and pdf["asks"].sum() <= 64
        return plain(pdf, k)

    monkeypatch.setattr(hilbert, "_best", bounded)
    found = {}
    for r in hilbert.nearest(vectors, F.lit(True), k=5, reach=1.0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(found) == 600
    exact = points.astype(np.float64)
    hits = 0
    for query, got in found.items():
        score = (exact * exact[query]).sum(axis=1)
        want = sorted((-s, i) for i, s in enumerate(score.tolist()) if i != query)[:5]
        got.sort()
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(g[2] == score[g[1]] for g in got)
        hits += len({i for _, i in want} & {g[1] for g in got})
    assert hits >= 0.9 * 5 * 600
