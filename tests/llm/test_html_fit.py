"""The classifier of the main text: fitted by Newton steps, told from marked pages, held out on unmarked ones."""

import os
import random
import re
from html import unescape

import numpy as np
import pytest

from boxmill.llm import html_cut

FOLDER = "/root/testdata/sf0.01"


def test_fit_has_no_slope_left():
    rng = random.Random(2)
    taught = [
        ([("bias", 1.0), ("length", rng.random() * 4), ("p", float(rng.random() < 0.5))], rng.random() < 0.6) for _ in range(500)
    ]
    weights = html_cut.fitted(taught)

    def loss(w):
        total = 0.0
        for measures, inside in taught:
            z = sum(w[n] * v for n, v in measures)
            total += np.logaddexp(0.0, -z if inside else z)
        return html_cut.EVIDENCE * total / len(taught) + sum((w[n] - html_cut.PRIOR[n]) ** 2 for n in w) / 2

    for name in weights:
        up, down = dict(weights), dict(weights)
        up[name] += 1e-4
        down[name] -= 1e-4
        assert abs(loss(up) - loss(down)) / 2e-4 < 1e-3, name
    # the size of the sample has no say
    assert html_cut.fitted(taught * 3) == pytest.approx(weights, abs=1e-6)


def test_nothing_to_learn_from(spark):
    prior = html_cut.PRIOR
    assert html_cut.fitted([]) == prior
    for rows in ([], [(None,), ("",), ("<p>No article here.",)]):
        assert html_cut.learn(spark.createDataFrame(rows, "html string")) == prior
    assert html_cut.lessons("<nav>Menu</nav>") == html_cut.lessons("") == []


def test_lessons_hide_the_mark():
    page = "<nav><a href=x>Home</a></nav><ARTICLE class='x'><h1>T</h1><p>One <b>two</b>.</p></ARTICLE><div role='main'><p>Three.</p></div>"
    taught = html_cut.lessons(page)
    assert [inside for _, inside in taught] == [False, True, True, True]
    assert all("article" not in dict(measures) for measures, _ in taught)
    assert html_cut.unmarked("<main id=m>x</main><mainly>") == "<div id=m>x</div><mainly>"


def test_copies_teach_once(spark):
    page = "<nav><a href=x>Home</a></nav><article><p>One {} with some words in it.</p></article>"
    once = [(page.format(k),) for k in range(20)]
    many = once + [once[0]] * 300
    assert html_cut.learn(spark.createDataFrame(once, "html string")) == html_cut.learn(spark.createDataFrame(many, "html string"))


def test_edges_outweigh_an_unsure_classifier():
    # a short line among paragraphs stays, the same line among links goes
    words = "<p>A paragraph with quite a few words in it, which is surely a part of the text.</p>"
    link = "<div><a href=x>A link to some other place</a></div>"
    assert "\nSee" in html_cut.main_text(f"{words}<p>See</p>{words}")
    assert "See" not in html_cut.main_text(f"{link}<p>See</p>{link}")


def test_the_tag_is_within_reach_of_the_edges():
    around = 2 * html_cut.NEXT / 3
    assert html_cut.PRIOR["article"] < around


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_held_out_pages_without_the_tag(spark):
    table = spark.read.parquet(f"{FOLDER}/pages.parquet")
    taught, held = table.where("page_id % 2 = 0"), table.where("page_id % 2 = 1").collect()
    weights = html_cut.learn(taught)
    right = 0
    for r in held:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(x for x in parts if x)
        assert html_cut.main_text(r.html, weights) == want
        right += html_cut.main_text(html_cut.unmarked(r.html), weights) == want
    assert right >= 0.97 * len(held)
