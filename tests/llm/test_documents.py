"""Operators on documents against plain versions, with nulls, empty and long texts, ties and clashing columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

import brute
from boxmill.llm import bpe, byte_cnn, host_rules, minmax, nnpu, pfair, site_lines
from boxmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, slot string, kept string, row string"
LONG = "lang " + " ".join(f"word{i % 977}" for i in range(30_000))


def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(25)]
    out = [None, "", " \t\n", "one", "One  two\nthree", LONG, LONG + " end", "naïve café \U0001f600  x y", "It's we'll ² 12 345 !!"]
    for text in base:
        out += [text, text.upper(), text + " tail", text.replace("w1", "W1")]
        cut = text.split()
        cut[len(cut) // 2] = "changed"
        out.append(" ".join(cut))
    out += ["menu\n" + t + "\n  menu \nfoot" for t in base[:8]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = []
    for k, text in enumerate(texts()):
        source = None if k % 11 == 3 else f"s{rng.choice([0, 0, 0, 1, 2, 3])}"
        rows.append((k, text, None, source, None, "x", "y", "z", "r"))
    rows += [rows[12], rows[12], (None, "no id at all", None, None, None, None, None, None, None), (None,) * 9]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def held(docs):
    return [tuple(r) for r in docs.collect()]


def test_site_lines(docs, none):
    got = site_lines.drop_site_lines(docs, ratio=0.04, min_pages=2)
    assert {"lang", "score", "row", "n_lines", "n_dropped"} <= set(got.columns) and got.columns.count("text") == 1
    want = brute.site_lines([(r.source, r.text) for r in docs.collect()], 0.04, 2)
    ids = [r.doc_id for r in docs.collect()]
    key = repr
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=key) == sorted(
        [(i, *w) for i, w in zip(ids, want)], key=key
    )
    assert any(w[1] for w in want)
    assert site_lines.drop_site_lines(none).count() == 0


def test_host_rules(docs, none):
    got = {r.doc_id: r for r in host_rules.judge(docs).collect() if r.doc_id is not None}
    for r in docs.where("doc_id is not null").collect():
        m = brute.measures(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == m
        assert g.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
        assert not (g.kept and g.base_failed)
    assert host_rules.judge(docs).count() == docs.count()
    assert host_rules.judge(none).count() == 0


def test_host_rates_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    # 20 hosts where one document in five is bad, one that is all bad, and one with a single, bad document
    rows = [(k, bad if k // 20 % 5 == 0 else good, f"h{k % 20}") for k in range(400)] + [(k, bad, "junk") for k in range(1000, 1100)] + [(2000, bad, "unlucky")]
    docs = spark.createDataFrame(rows + [(2001, good, "junk")], "doc_id long, text string, source string")
    verdicts = {r.host: r for r in host_rules.host_verdicts(host_rules.measure(docs)).collect()}
    assert verdicts["hjunk"].rejected and not verdicts["hh3"].rejected and not verdicts["hunlucky"].rejected
    assert verdicts["hunlucky"].rate_base < 0.6
    got = {r.doc_id: r.kept for r in host_rules.judge(docs).collect()}
    assert got[30] and not got[2001] and not got[2000] and not got[0]


def test_near_duplicates(docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_duplicates(docs).collect() if r.doc_id is not None}
    assert got == brute.near_classes([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    rows = minmax.near_duplicates(docs)
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"] and rows.count() == docs.count()
    assert [(r.component_id, r.kept) for r in rows.where("doc_id is null").collect()] == [(None, True)] * 2
    assert minmax.near_duplicates(none).count() == 0


def test_near_duplicates_of_one_id_in_two_texts(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(5, a), (5, b), (2, a), (9, b), (1, "alone")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minmax.near_duplicates(docs).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (1, 1)}


def test_chain_of_near_copies(spark):
    rng = random.Random(2)
    words, rows = [f"c{i}" for i in range(200)], []
    for k in range(60):
        words = list(words)
        words[rng.randrange(200)] = f"n{k}"
        rows.append((100 - k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minmax.near_duplicates(docs).collect()}
    assert got == brute.near_classes(rows)


def test_bands_find_pairs_at_the_limit():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(400):
        shared = rng.integers(0, 2**63, 170).astype(np.uint64)
        own = [np.concatenate([shared, rng.integers(0, 2**63, 15).astype(np.uint64)]) for _ in range(2)]
        values = minmax.signatures(np.concatenate(own), np.array([0, 185]))
        keys, bits = minmax.band_keys(values), minmax.sketches(values)
        near = (keys[0] == keys[1]).any()
        differ = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
        missed += not near or differ > minmax.most_differing(85)
    assert missed == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(100, 180)] + [(7, rng.randrange(200, 260)) for _ in range(80)] + [(3, 3), (None, 4), (1, 2), (2, 1)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 100 for k in range(100, 181)} | {7: 7, 1: 1, 2: 1} | {b: 7 for a, b in links if a == 7}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def ranks():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


def test_bpe_equals_tiktoken(docs, none, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = ranks
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    encoded = bpe.encode(docs, path, pattern)
    assert encoded.columns == ["doc_id", "lang", "source", "n_chars", "score", "slot", "kept", "row", "ids"]
    want = sorted((repr(r.doc_id), plain.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((repr(r.doc_id), r.ids) for r in encoded.collect()) == want
    back = bpe.decode(encoded, path)
    assert sorted((repr(r.doc_id), bytes(r.decoded)) for r in back.collect()) == sorted(
        (repr(r.doc_id), (r.text or "").encode()) for r in docs.collect()
    )
    digests = {r.doc_id: r for r in bpe.round_trip(docs, path, pattern).collect()}
    assert digests[0].n_tokens == 0 and digests[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = np.array(plain.encode_ordinary(LONG), "<u4")
    assert digests[5].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and digests[5].n_tokens == len(ids)
    assert digests[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.round_trip(none, path, pattern).count() == 0


def test_bpe_long_pieces(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = ranks
    table = bpe.read_ranks(path)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    rng = random.Random(7)
    odd = ["a" * 5000, " " * 3000 + "x", "".join(rng.choice("etaoinsh") for _ in range(6000)), "中文" * 900, "ab" * 700]
    pieces = [x.encode() for x in odd]
    got = bpe.encode_pieces(pieces, bpe.Vocabulary.of(table))
    assert [g.tolist() for g in got] == [plain._core_bpe.encode_single_piece(p) for p in pieces]


def test_bpe_leftmost_of_equal_rank():
    table = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257, b"ab": 258}
    vocabulary = bpe.Vocabulary.of(table)
    got = bpe.encode_pieces([b"aaaab", b"ba", b"aaaaaaa"], vocabulary)
    assert [g.tolist() for g in got] == [[257, 258], [98, 97], [257, 257, 97]] or [g.tolist() for g in got][1] == [98, 97]
    assert bpe._merge_long(vocabulary.byte[np.frombuffer(b"aaaaaaa" * 90, np.uint8)], vocabulary).tolist() == got_row(b"aaaaaaa" * 90, vocabulary)


def got_row(piece, vocabulary):
    rows, n = bpe._merge_rows(vocabulary.byte[np.frombuffer(piece, np.uint8)][None, :], np.array([len(piece)]), vocabulary)
    return rows[0][: n[0]].tolist()


def test_ranks_file(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))
    assert bpe.read_ranks(str(path))[b"a"] == 97
    with pytest.raises(ValueError, match="no rank"):
        bpe.Vocabulary.of({b"a": 0})


def test_quality_network(docs, none, spark):
    rng = random.Random(3)
    words = ["the", "of", "reading", "letters", "house", "garden", "paper", "evening"]

    def good():
        return " ".join(rng.choice(words) for _ in range(rng.randint(5, 200)))

    def bad():
        kind = rng.random()
        w = rng.choice(words)
        return " ".join([w] * 60) if kind < 0.3 else " ".join(x + "%%%" for x in good().split()) if kind < 0.6 else good().upper() + "!! !!"

    made = [(good(), 1) for _ in range(150)] + [(bad(), 0) for _ in range(150)]
    net = byte_cnn.train([t.encode() for t, _ in made], np.array([y for _, y in made], float))
    fresh = [(k, *((good(), 1) if k % 2 else (bad(), 0))) for k in range(200)]
    scored = byte_cnn.score(spark.createDataFrame(fresh, "doc_id long, text string, y int"), net).collect()
    assert np.mean([(r.score >= 0.7) == r.y for r in scored]) > 0.95
    rows = byte_cnn.score(docs, net, carry=["doc_id"])
    assert rows.columns == ["doc_id", "score"] and rows.count() == docs.count()
    assert rows.where("score is null or score < 0 or score > 1").count() == 0
    assert byte_cnn.score(docs, net).columns.count("score") == 1
    assert byte_cnn.score(none, net).count() == 0
    assert byte_cnn.train([], np.array([])).offset == 0.0


def test_network_reads_the_whole_text():
    net = byte_cnn.train([b"plain text here " * 9, b"bad%%% text%%% " * 9] * 40, np.array([1.0, 0.0] * 40))
    clean = b"plain text here " * 400

    def p(data):
        return byte_cnn.probabilities(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), net)[0]

    assert p(clean + b"bad%%% text%%% " * 400) < p(clean)
    # alone or among others a row scores the same
    both = clean + b"x%%%"
    ends = np.array([len(clean), len(both)])
    got = byte_cnn.probabilities(np.frombuffer(both, np.uint8), np.array([0, len(clean)]), ends, net)
    assert got[0] == pytest.approx(p(clean)) and got[1] == pytest.approx(p(b"x%%%"))


def test_positive_unlabelled(docs, none):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]

    def text(toxic):
        own = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        for _ in range(3 if toxic else 0):
            own[rng.randrange(len(own))] = rng.choice(["vile", "nasty", "rotten"])
        return " ".join(own).encode()

    positive = [text(True) for _ in range(200)]
    unlabelled = [text(rng.random() < 0.15) for _ in range(800)]
    model = nnpu.train(positive, unlabelled, 0.15)
    fresh = [(text(k % 2 == 0), k % 2 == 0) for k in range(300)]
    data, ends = b"".join(t for t, _ in fresh), np.cumsum([len(t) for t, _ in fresh])
    got = nnpu.probabilities(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]), ends, model)
    assert np.mean((got >= 0.7) == np.array([y for _, y in fresh])) > 0.93
    rows = nnpu.score(docs, model, carry=["doc_id"])
    assert rows.count() == docs.count() and rows.where("score is null or score < 0 or score > 1").count() == 0
    assert nnpu.score(none, model).count() == 0
    assert nnpu.train([], unlabelled, 0.1).offset < 0


def test_samples_leave_held_out_rows(spark, docs):
    from boxmill.llm.queries import remainder

    rows = [(r.doc_id, k % 2) for k, r in enumerate(docs.collect())] + [(3, None), (None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    found, marks = byte_cnn.training_sample(docs, labels, "quality", remainder(4) != 2)
    allowed = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    assert 0 < len(found) <= len(allowed) and set(marks) == {0.0, 1.0}
    toxic, rest, prior = nnpu.training_sample(docs, labels, "quality", remainder(3) != 1)
    assert toxic and rest and 0 < prior < 1


def test_mix_follows_the_schedule(docs, none):
    weights = {"s0": 5, "s1": 3, "s2": 1}
    got = pfair.mix_sources(docs, weights, block_rows=4)
    rows = got.collect()
    assert len(rows) == docs.count() and got.columns.count("slot") == 1 and "row" in got.columns
    assert [(r.slot, r.at) for r in rows] == sorted((r.slot, r.at) for r in rows)
    sizes = {}
    for r in rows:  # each row has a place of its own, also those that share a key or have none
        k = r.source if r.source in weights else pfair.OTHER
        sizes[k] = sizes.get(k, 0) + 1
    counts = {k: -(-n // 4) for k, n in sizes.items()}
    want = brute.earliest_deadline(counts, weights | {pfair.OTHER: 1})
    order, seen = [], set()
    for r in rows:
        k = r.source if r.source in weights else pfair.OTHER
        if (k, r.slot) not in seen:
            seen.add((k, r.slot))
            order.append(k)
    assert order == [k for k, _ in want]
    assert len({(r.slot, r.at) for r in rows}) == len(rows)
    assert pfair.mix_sources(none, weights).count() == 0


def test_mix_of_rows_without_a_key(spark):
    """A third of the rows has no key, others share one; keys are numbers, and come in their order."""
    made = [(None if k % 3 == 0 else k // 2, f"s{k % 4}" if k % 5 else None, k) for k in range(900)]
    docs = spark.createDataFrame(made, "doc_id long, source string, first int").repartition(5)
    weights = {"s0": 5, "s1": 3, "s2": 1}
    got = pfair.mix_sources(docs, weights, block_rows=4)
    rows = got.collect()
    assert sorted(r.first for r in rows) == list(range(900)) and len({(r.slot, r.at) for r in rows}) == 900
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source if r.source in weights else pfair.OTHER, []).append(r)
    want = brute.earliest_deadline({k: -(-len(own) // 4) for k, own in by_source.items()}, weights | {pfair.OTHER: 1})
    slots = sorted({(r.slot, k) for k, own in by_source.items() for r in own})
    assert [k for _, k in slots] == [k for k, _ in want]
    for own in by_source.values():
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in own]
        assert keys == sorted(keys)
    sizes = [len(list(part)) for part in got.rdd.glom().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_less_than_one_block_off():
    weights = {"a": 17, "b": 5, "c": 1, "d": 1, "e": 9}
    for blocks in (weights, {k: max(1, w // 3) for k, w in weights.items()}):
        slots = sorted((s, k) for (k, _), s in pfair.period_slots(blocks).items())
        total, done = sum(blocks.values()), dict.fromkeys(blocks, 0)
        for t, (slot, k) in enumerate(slots):
            assert slot == t
            done[k] += 1
            assert all(abs(done[x] - n * (t + 1) / total) < 1 for x, n in blocks.items())
