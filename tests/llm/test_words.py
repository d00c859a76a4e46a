"""Licence scans, spelling variants and periodic runs against plain versions."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import brute
from boxmill.llm import licences, periodic, queries, spelling

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
EDGES = [None, "", " \n\t ", "a", "é", "x " * 30, "the the the the the the"]


def documents(spark, texts):
    return spark.createDataFrame([(k, t, [1], {"a": k}) for k, t in enumerate(texts)], "doc_id long, text string, runs array<int>, score map<string, int>")


# ---- licences

LICENCE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    words = LICENCE_WORD.findall((text or "").translate(brute.LOWERED))
    found = []
    for phrase, label in licences.BASE.items():
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), sorted(found)


@needs_tables
def test_licence_places_of_the_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op11_licences(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places = base_places(texts[r.doc_id])
        starts = [p for p, _ in places]
        base = sorted({x for _, x in places})
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(base)
        labels = [x for x in r.labels.split(",") if x]
        assert labels == sorted(set(labels)) and set(base) <= set(labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def test_licence_edges(spark):
    texts = [*EDGES, "MIT\n* License!", "cc by by cc-by", "İMIT license", "mit licenseé", "Apache License; Apache-License " * 3000]
    docs = documents(spark, texts)
    rows = licences.scan_licences(docs).orderBy("doc_id").collect()
    assert [(r.n_words, [(p.word, p.label) for p in r.places]) for r in rows] == [base_places(t) for t in texts]
    assert licences.scan_licences(docs.limit(0)).count() == 0
    assert licences.scan_licences(docs).columns[:2] == ["doc_id", "runs"]


@pytest.mark.parametrize("text, want, terms", [
    ("MIT", "mit", "permissive"),
    ("MIT OR GPL-3.0-only", "mit OR gpl-3.0-only", "permissive"),
    ("MIT AND GPL-3.0-only", "mit AND gpl-3.0-only", "copyleft"),
    ("(MIT OR Apache-2.0) AND BSD-3-Clause", "(mit OR apache-2.0) AND bsd-3-clause", "permissive"),
    ("MIT OR ISC AND GPL-2.0+", "mit OR isc AND gpl-2.0+", "permissive"),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl-2.0-only WITH classpath-exception-2.0", "weak copyleft"),
    ("CC0-1.0 and then some prose", "cc0-1.0", "public domain"),
    ("LicenseRef-Own or MIT with nothing", "licenseref-own OR mit", "permissive"),
    ("((ISC))", "isc", "permissive"),
    ("(MIT or", None, None), ("and MIT", None, None), ("the best", None, None), ("", None, None),
])
def test_expressions(text, want, terms):
    found = licences.parse(text.lower().encode())
    assert (found and found.text, found and licences.GRADES[found.grade]) == (want, terms)


def _evaluate(tree):
    """(names, grade) of nested tuples."""
    if isinstance(tree, str):
        return {tree}, licences.GRADE_OF[tree]
    op, a, b = tree
    (na, ga), (nb, gb) = _evaluate(a), _evaluate(b)
    return na | nb, min(ga, gb) if op == "or" else max(ga, gb)


def test_random_expressions():
    rng = random.Random(4)
    names = ["mit", "gpl-3.0", "lgpl-2.1", "unlicense", "json"]

    def made(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(names)
        return rng.choice(["and", "or"]), made(depth - 1), made(depth - 1)

    def spelled(tree):
        return tree if isinstance(tree, str) else f"({spelled(tree[1])} {tree[0]} {spelled(tree[2])})"

    for _ in range(300):
        tree = made(5)
        found = licences.parse(spelled(tree).encode())
        assert (found.names, found.grade) == _evaluate(tree)
        again = licences.parse(found.text.lower().encode())
        assert (again.text, again.names, again.grade) == (found.text, found.names, found.grade)


def test_tags_in_texts():
    found = licences.automaton()
    for text, names in [
        ("# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\ncode", ["apache-2.0"]),
        ('{"license": "ISC", "x": 1}', ["isc"]),
        ("license = 'MIT OR Apache-2.0'", ["apache-2.0", "mit"]),
        ("The license is: MIT", []),
        ("license\t:\n\nmit", ["mit"]),
    ]:
        assert [x for x in licences.scan(text, found)["labels"]] == names
    assert licences.scan("license: " + "mit and (" * 5000 + "isc" + ")" * 5000, found)["labels"] == ["isc", "mit"]


# ---- spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def word_counts(docs, drop=97):
    n = {}
    for key, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(brute.LOWERED)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def variants(n):
    """{word: (form, root, n, n_near, form_n)} by a table of words with one letter left out."""
    holders = {}
    for w in n:
        for i in range(len(w)):
            holders.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    rows = {}
    for w, k in n.items():
        by_gap = {x for i in range(len(w)) for x in holders[w[:i] + w[i + 1 :]]}
        others = {x for x in by_gap | holders.get(w, set()) | {w[:i] + w[i + 1 :] for i in range(len(w))} if x in n and near(w, x)}
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 2 * k else None
        rows[w] = (form, k, len(others), n[form] if form else None)
    out = {}
    for w, (form, k, many, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out[w] = (form, root, k, many, form_n)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@needs_tables
def test_spelling_of_the_documents(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert rows_of(queries.op12_spelling(spark, FOLDER)) == variants(word_counts(texts))


def random_words(rng, many):
    bases = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([5, 6, 7, 9]))) for _ in range(many)]
    return {w: rng.choice([3, 3, 4, 7, 20, 90]) for w in bases}


@pytest.mark.parametrize("coarse, group", [(8192, 32_768), (20, 50)])
def test_variants_in_small_leaves_and_blocks(spark, monkeypatch, coarse, group):
    """Also with many coarse leaves, and leaves cut into blocks of points and of queries."""
    monkeypatch.setattr(spelling, "COARSE", coarse)
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(8)
    n = random_words(rng, 1500) | {"a" * k: 5 + k for k in range(5, 300, 7)} | {"z" * 70: 3, "z" * 71: 9, "z" * 69 + "y": 30}
    n |= {"".join(p): 3 for p in {tuple(rng.sample("abcdefg", 7)) for _ in range(400)}}  # equal vectors
    table = spark.createDataFrame(list(n.items()), "word string, n int")
    assert rows_of(spelling.group_variants(table)) == variants(n)


def test_word_counts_and_empty_tables(spark):
    texts = ["Ärger Ärger ärger ÄRGER hello-hello HELLO", None, "", "hell\u00f7o÷ worlds", "worlds worlds x" * 3, "hallo " * 9, "hallow " * 3]
    docs = documents(spark, [t for t in texts for _ in range(4)])
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", docs.doc_id * None))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.word: r.n for r in spelling.count_words(docs).collect()}
    assert got == word_counts(rows)
    got = {r.word: r.n for r in spelling.count_words(docs, drop=2).collect()}
    assert got == word_counts(rows, 2)
    empty = spelling.group_variants(spelling.count_words(docs.limit(0)))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


# ---- periodic runs


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        t = 0
        while t + q < n:
            first = t
            while t + q < n and words[t] == words[t + q]:
                t += 1
            length = t - first + q
            if t > first and length >= max(6, 4 * q):
                own = words[first : first + length]
                if not any(own[p:] == own[: length - p] for p in range(1, q)):
                    found.append((first, length, q))
            t += t == first
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_random_runs():
    rng = random.Random(6)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            a = rng.choice([1, 2, 3, 40])
            words = [rng.randrange(a) for _ in range(rng.randint(0, 50))]
            part = [rng.randrange(a) for _ in range(rng.randint(1, 15))]
            docs.append((words[:20] + (part * 8)[: rng.randint(0, 90)] + words[20:]) * rng.choice([1, 1, 5]))
        size = np.array([len(d) for d in docs])
        ends = np.cumsum(size)
        ids = np.array([x for d in docs for x in d], np.int64)
        got = periodic.runs(ids, np.repeat(np.arange(len(docs)), size), ends - size, ends)
        assert got == [(k, *r) for k, d in enumerate(docs) for r in plain_runs(d)]


def test_run_edges(spark):
    texts = [*EDGES, "a b " * 500 + "c " + "a b c " * 4, "one two three four " * 4, "x\x0by " * 9, "word " * 200_000, "a b c d e f g " * 40_000]
    docs = documents(spark, texts)
    rows = periodic.find_runs(docs).orderBy("doc_id").collect()
    for text, r in zip(texts[:-2], rows):
        words = brute.WORD.findall(text or "")
        want = plain_runs(words)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(words)
        assert bytes(r.collapsed).decode() == collapse(words, want)
    assert [tuple(x) for x in rows[-2].runs] == [(0, 200_000, 1)] and bytes(rows[-1].collapsed) == b"a b c d e f g"
    assert periodic.find_runs(docs.limit(0)).count() == 0


@needs_tables
def test_runs_of_the_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op13_periodic(spark, FOLDER).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 5
    for r in rows:
        words = brute.WORD.findall(texts[r.doc_id] or "")
        g, last = divmod(zlib.crc32(str(r.doc_id).encode()), 10)
        if not last and words:
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 4000:
            continue  # the plain version takes quadratic time
        runs = plain_runs(words)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
