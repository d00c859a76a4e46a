"""The numpy models against plain loops and numerical slopes."""

import random

import numpy as np

from boxmill.llm import byte_cnn, bytetext, nnpu


def flat(texts):
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], ends[:-1])), ends


def network(rng):
    return byte_cnn.Network(
        rng.normal(0, 0.3, (byte_cnn.WIDTH, byte_cnn.SYMBOLS, byte_cnn.FILTERS)).astype(np.float32),
        rng.normal(0, 0.1, byte_cnn.FILTERS).astype(np.float32),
        rng.normal(0, 0.3, 2 * byte_cnn.FILTERS).astype(np.float32),
        0.1,
    )


def plain_symbols(text):
    out, before, k = list(text), None, 0
    while k < len(text):
        if bytetext.SPACE[text[k]]:
            k += 1
            continue
        stop = k
        while stop < len(text) and not bytetext.SPACE[text[stop]]:
            stop += 1
        if text[k:stop] == before:
            out[k:stop] = [c + 256 for c in text[k:stop]]
        before, k = text[k:stop], stop
    return out


def plain_probability(text, net):
    held = plain_symbols(text)
    room = max(len(text), byte_cnn.WIDTH)
    held += [0] * (room + byte_cnn.WIDTH - 1 - len(held))
    chunks, low = [], 0
    while True:
        high = min(low + byte_cnn.CHUNK, room)
        best = [
            max(0.0, net.bias[f] + max(sum(net.filters[k, held[t + k], f] for k in range(byte_cnn.WIDTH)) for t in range(low, high)))
            for f in range(byte_cnn.FILTERS)
        ]
        chunks.append(best)
        if high == room:
            break
        low += byte_cnn.STRIDE
    made = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1 / (1 + np.exp(-(made @ net.head + net.offset)))


def test_network_equals_plain_loops(monkeypatch):
    net, rng = network(np.random.default_rng(2)), random.Random(2)
    texts = [b"", b"a", b"ab ab ab cd", b"x" * 255, b"y z " * 64, bytes(rng.randrange(32, 126) for _ in range(700)), "é à ü ü".encode() * 40]
    want = [plain_probability(t, net) for t in texts]
    assert np.allclose(byte_cnn.probabilities(*flat(texts), net), want, atol=1e-5)
    monkeypatch.setattr(byte_cnn, "BLOCK_CHUNKS", 2)
    assert np.allclose(byte_cnn.probabilities(*flat(texts), net), want, atol=1e-5)


def test_network_slopes_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(byte_cnn, "BLOCK_CHUNKS", 3)
    net, rng = network(np.random.default_rng(3)), random.Random(3)
    texts = [bytes(rng.randrange(97, 110) for _ in range(n)) for n in (5, 300, 900)]
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    filters, bias, head, offset = byte_cnn._gradients(texts, labels, weight, net)

    def loss():
        p = byte_cnn.probabilities(*flat(texts), net)
        own = -(labels * np.log(p) + (1 - labels) * np.log(1 - p)) * weight
        return own.mean() + 0.5e-4 * float((net.head**2).sum()) + 0.5e-5 * float((net.filters**2).sum())

    for held, slope, at in ((net.bias, bias, 3), (net.head, head, 5), (net.head, head, 20), (net.filters, filters, (2, 100, 4))):
        before, step = held[at], 2e-3
        held[at] = before + step
        up = loss()
        held[at] = before - step
        down = loss()
        held[at] = before
        assert abs((up - down) / (2 * step) - slope[at]) < 2e-3
    net.offset += 1e-3
    up = loss()
    net.offset -= 2e-3
    assert abs((up - loss()) / 2e-3 - offset[0]) < 2e-3


def plain_risk(z, toxic, prior, weight):
    """The two parts of the risk: positives called clean, and clean ones called toxic."""
    on_toxic = prior * np.mean([np.log1p(np.exp(-x)) for x, t in zip(z, toxic) if t])
    clean = np.mean([np.log1p(np.exp(x)) for x, t in zip(z, toxic) if not t])
    clean -= prior * np.mean([np.log1p(np.exp(x)) for x, t in zip(z, toxic) if t])
    return on_toxic, clean


def test_risk_slope_is_that_of_the_risk():
    rng = np.random.default_rng(5)
    toxic = np.arange(12) < 4
    row, column = np.nonzero(rng.random((12, 5)) < 0.5)
    for shift, negative in ((0.0, False), (4.0, True)):
        weight = rng.normal(0, 1, 5)

        def z_of(weight):
            z = np.full(12, -1.0)
            z[:4] += shift
            for r, c in zip(row, column):
                z[r] += weight[c]
            return z

        prior = 0.3
        parts = plain_risk(z_of(weight), toxic, prior, weight)
        assert (parts[1] < 0) == negative
        got, _ = nnpu.risk_slope(z_of(weight), toxic, prior, row, column, np.zeros(5))
        for k in range(5):
            step = np.eye(5)[k] * 1e-5
            up, down = (plain_risk(z_of(weight + s), toxic, prior, weight) for s in (step, -step))
            slopes = [(a - b) / 2e-5 for a, b in zip(up, down)]
            # where the estimate is below zero the step goes back along it
            want = slopes[0] + (slopes[1] if not negative else -nnpu.BACK_STEP * slopes[1])
            assert abs(got[k] - want) < 1e-6


def test_toxicity_equals_plain_loops():
    rng = np.random.default_rng(6)
    weight = np.where(rng.random((1 << nnpu.BITS) + nnpu.LEVELS) < 0.5, rng.normal(0, 0.2, (1 << nnpu.BITS) + nnpu.LEVELS), 0)
    model = nnpu.Linear(weight.astype(np.float32), -0.5)
    texts = [b"", b"  ", b"word", b"word Word, (word) longer-words", b"a b c d e f g h i j k l m n o p q " * 3, "été éléphantesque".encode()]
    got = nnpu.probabilities(*flat(texts), model)

    def code(part, kind):
        data = np.frombuffer(part, np.uint8)
        hashed = bytetext.word_hashes(data, np.array([0]), np.array([len(data)]))
        return int(bytetext.mix(hashed + np.uint64(kind))[0] >> np.uint64(64 - nnpu.BITS))

    for text, p in zip(texts, got):
        words = text.split()
        found = set()
        for word in words:
            for _ in range(3):
                word = word[1:] if len(word) > 1 and nnpu._PUNCTUATION[word[0]] else word
                word = word[:-1] if len(word) > 1 and nnpu._PUNCTUATION[word[-1]] else word
            found.add(code(word, 0))
            found |= {code(word[:cut], kind) for kind, cut in ((1, 5), (2, 4)) if len(word) > cut}
        z = model.offset + sum(float(model.weight[f]) for f in found)
        level = 0
        while words and 2 ** (level + 1) <= len(words):
            level += 1
            z += float(model.weight[(1 << nnpu.BITS) + level - 1])
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-5


def test_samples_hold_whole_texts_and_one_text_an_id(spark):
    from pyspark.sql import functions as F

    long = "fine words here " * 30_000 + "insult " * 3
    rows = [(k, ("insult rude " if k % 3 == 0 else "plain calm ") * (5 + k), "x") for k in range(60)]
    rows += [(5, "another text of the same id", "x"), (7, long, "x"), (None, "no id", "x"), (61, None, "x"), (62, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(63)] + [(None, 1)], "doc_id long, toxic int")
    texts, marks = byte_cnn.training_sample(docs, labels, "toxic", F.lit(True))
    assert sorted(texts) == sorted(min(t or "" for k, t, _ in rows if k == key).encode() for key in {k for k, _, _ in rows if k is not None})
    fewer, _ = byte_cnn.training_sample(docs, labels, "toxic", F.lit(True), size=3000)
    assert fewer and sum(map(len, fewer)) <= 3000 and set(fewer) <= set(texts)
    first, second = (nnpu.training_sample(d, labels, "toxic", F.lit(True)) for d in (docs, docs.repartition(2)))
    assert first[2] == second[2] == 21 / 63
    for a, b in zip(first[:2], second[:2]):
        assert len(a) == len(b) and all((x == y).all() for x, y in zip(a, b))
    nothing = nnpu.training_sample(docs.limit(0), labels.limit(0), "toxic", F.lit(True))
    assert nothing == ([], [], 0.1) and nnpu.fit(*nothing).offset == -6.0
