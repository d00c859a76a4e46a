"""Quality classifier: a byte-level convolutional network in numpy.

A document is its UTF-8 bytes; each byte is a symbol of 9 bits, the byte and whether its word is the same as
the word before.  Filters several symbols wide slide over overlapping chunks that cover the whole document.
Each chunk keeps the largest answer of every filter (max pooling); the mean and the maximum of these over
the document's chunks go through one logistic unit to a probability.

Training (numpy, Adam, on the driver) works on whole texts of a sample of labelled rows, bounded in rows and in
bytes together; gradients flow through the pooled positions only, so a text of any length takes a block of its answers
at a time.  Scoring is one pass over Arrow batches, a slice of bounded bytes at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.llm import bytetext
from boxmill.llm.ship import ship
from boxmill.session import settle

CHUNK, STRIDE = 256, 192
WIDTH, FILTERS = 6, 16
TRAIN_ROWS = 2000  # labelled rows that are trained on, at most
TRAIN_BYTES = 16 << 20  # bytes of their whole texts together, at most
BLOCK_CHUNKS = 1024  # chunks whose answers are held at a time
SYMBOLS = 512


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, SYMBOLS, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    head: np.ndarray  # (2 * FILTERS,)
    offset: float


def symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Each byte, plus 256 where its word is that before it in the same row."""
    out = data.astype(np.int16)
    begin, stop, row = bytetext.words(data, start, end)
    if len(begin) < 2:
        return out
    code = bytetext.word_hashes(data, begin, stop, lower=False)
    again = np.flatnonzero((code[1:] == code[:-1]) & (row[1:] == row[:-1])) + 1
    step = np.zeros(len(data) + 1, np.int8)
    step[begin[again]] += 1
    step[stop[again]] -= 1
    out[np.cumsum(step[:-1]) > 0] += 256
    return out


def _laid_out(sym: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(symbols with room after each row, first position of each chunk, its end, row of each chunk)."""
    size = end - start
    room = np.maximum(size, WIDTH)
    base = np.cumsum(room + WIDTH - 1) - (room + WIDTH - 1)
    held = np.zeros(int((room + WIDTH - 1).sum()), np.int16)
    if len(sym):
        held[np.arange(len(sym)) + np.repeat(base - start, size)] = sym
    # chunks start every STRIDE bytes; the last one reaches the end of the row
    chunks = 1 + np.maximum(0, -(-(room - CHUNK) // STRIDE))
    row = np.repeat(np.arange(len(size)), chunks)
    place = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    low = base[row] + place * STRIDE
    return held, low, np.minimum(low + CHUNK, base[row] + room[row]), row


def _answers(held: np.ndarray, net: Network) -> np.ndarray:
    n = len(held) - WIDTH + 1
    at = held.astype(np.intp)
    out = net.filters[0].take(at[:n], axis=0)
    more = np.empty_like(out)
    for k in range(1, WIDTH):
        out += net.filters[k].take(at[k : k + n], axis=0, out=more, mode="clip")
    return out


def _pooled(held: np.ndarray, low: np.ndarray, high: np.ndarray, net: Network) -> np.ndarray:
    """Largest answer of every filter in each chunk, after the bias and the rectifier."""
    best = []
    for k in range(0, len(low), BLOCK_CHUNKS):
        a, b = low[k : k + BLOCK_CHUNKS], high[k : k + BLOCK_CHUNKS]
        answers = _answers(held[a[0] : b[-1] + WIDTH], net)
        cut = np.stack([a - a[0], np.minimum(b - a[0], len(answers) - 1)], axis=1).ravel()
        best.append(np.maximum.reduceat(answers, cut, axis=0)[::2])
    return np.maximum(np.concatenate(best) + net.bias, 0)


def _peaks(held: np.ndarray, low: np.ndarray, high: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """(place, answer) of the largest answer of every filter in each chunk."""
    places, values = [], []
    for k in range(0, len(low), BLOCK_CHUNKS):
        a, b = low[k : k + BLOCK_CHUNKS], high[k : k + BLOCK_CHUNKS]
        answers = _answers(held[a[0] : b[-1] + WIDTH], net)
        # all chunks as rows of equal width
        at = np.minimum(a[:, None] + np.arange(CHUNK), b[:, None] - 1) - a[0]
        peak = np.take_along_axis(at, answers[at].argmax(axis=1), 1)
        places.append(peak + a[0])
        values.append(answers[peak, np.arange(FILTERS)])
    return np.concatenate(places), np.concatenate(values)


def _combined(pooled: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    first = np.searchsorted(row, np.arange(n))
    mean = np.add.reduceat(pooled, first, axis=0) / np.bincount(row, minlength=n)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(pooled, first, axis=0)], axis=1)


def probabilities(data: np.ndarray, start: np.ndarray, end: np.ndarray, net: Network) -> np.ndarray:
    """One probability per row; the rows fit in memory together, see ``score``."""
    held, low, high, row = _laid_out(symbols(data, start, end), start, end)
    made = _combined(_pooled(held, low, high, net), row, len(start))
    return 1 / (1 + np.exp(-(made.astype(np.float64) @ net.head.astype(np.float64) + net.offset)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5, rounds: int = 12, batch: int = 64) -> Network:
    """Fit the network; rows count so that both labels weigh the same.  One label alone gives a constant."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
        0.0,
    )
    share = float(np.mean(labels)) if len(labels) else 0.5
    if not 0 < share < 1:
        net.head[:] = 0
        net.offset = float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -6, 6))
        return net
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = [net.filters, net.bias, net.head, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for turn in range(rounds):
        order = rng.permutation(len(texts))
        rate = 0.02 * (1 - turn / rounds) + 0.001
        for low in range(0, len(order), batch):
            own = order[low : low + batch]
            grads = _gradients([texts[k] for k in own], labels[own], weight[own], net)
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            net.offset = float(params[3][0])
    return net


def _gradients(texts: list[bytes], labels: np.ndarray, weight: np.ndarray, net: Network) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = np.concatenate(([0], end[:-1]))
    held, low, high, row = _laid_out(symbols(data, start, end), start, end)
    peak, raw = _peaks(held, low, high, net)
    raw += net.bias
    pooled = np.maximum(raw, 0)
    n = len(texts)
    made = _combined(pooled, row, n)
    guess = 1 / (1 + np.exp(-(made @ net.head + net.offset)))
    slope = ((guess - labels) * weight / n).astype(np.float32)
    head = made.T @ slope + 1e-4 * net.head
    back = slope[:, None] * net.head[None, :]
    count = np.bincount(row, minlength=n)
    flow = back[row, :FILTERS] / count[row, None]
    top = pooled == made[row, FILTERS:]
    flow = (flow + back[row, FILTERS:] * top) * (raw > 0)
    filters = 1e-5 * net.filters
    column = np.broadcast_to(np.arange(FILTERS), peak.shape)
    for k in range(WIDTH):
        np.add.at(filters[k], (held[peak + k], column), flow)
    return [filters, flow.sum(axis=0), head, np.array([slope.sum()], np.float32)]


def _scores(batches, net: Network, text: str, out: str, carry: list[str]):
    for batch in batches:
        for piece in bytetext.slices(batch, text, 256 << 10):
            found = probabilities(*bytetext.flat(piece.column(piece.schema.get_field_index(text))), net)
            kept = [piece.column(piece.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], [*carry, out])


def score(
    docs: DataFrame, net: Network, text: str = "text", carry: list[str] | None = None, out: str = "score"
) -> DataFrame:
    """The columns ``carry`` (default: all) and ``out``, 0 to 1, for every row.

    The whole text is read; a NULL text counts as the empty one, which is one chunk of zeros.  A column
    already called as ``out`` is replaced.
    """
    ship()
    # some 200 KB, whatever the data; arrays and numbers only, which executors without the package can read
    held = docs.sparkSession.sparkContext.broadcast((net.filters, net.bias, net.head, net.offset))
    kept = [c for c in (docs.columns if carry is None else carry) if c != out]
    bare = docs.select(*dict.fromkeys([*kept, text])).withColumn(text, docs[text].cast("string"))
    kinds = dict(zip(bare.columns, (f.dataType.simpleString() for f in bare.schema)))
    schema = "".join(f"`{c}` {kinds[c]}, " for c in kept) + f"`{out}` double"
    return bare.mapInArrow(lambda batches: _scores(batches, Network(*held.value), text, out, kept), schema)


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, key: str = "doc_id", text: str = "text",
    rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES,
) -> tuple[list[bytes], np.ndarray]:
    """(whole texts, labels) of at most ``rows`` labelled rows that ``allowed`` admits, by a hash of their key.

    Half of them for each label as far as there are so many.  Rows without key or label take no part; keys with two
    labels neither.  A key with several texts counts with the first in byte order.  Rows are taken in the order of the
    hash as long as their texts have ``size`` bytes together; one that would go over is left out.
    """
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & allowed).groupBy(key).agg(
        F.min(label).alias("_y"), F.max(label).alias("_z")
    ).where("_y = _z and _y in (0, 1)").select(key, F.col("_y").cast("int").alias("_y"))
    order = F.xxhash64(F.col(key), F.lit("sample"))
    halves = [one.where(F.col("_y") == y).orderBy(order, key).limit(rows // 2) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1])
    found = settle(
        docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
        .join(F.broadcast(chosen), key)  # at most ``rows`` rows of two numbers
        .groupBy(key, "_y")
        .agg(F.min("_t").alias("_t"))
        .select(order.alias("_o"), "_y", F.col("_t").cast("binary").alias("_t"))
    )
    sizes = found.select("_o", F.length("_t").alias("_n")).orderBy("_o").collect()
    taken, total = [], 0
    for r in sizes:
        if total + r["_n"] <= size:
            taken.append(r["_o"])
            total += r["_n"]
    if len(taken) < len(sizes):
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in taken], "_o long")), "_o")
    held = found.select("_o", "_t", "_y").orderBy("_o").collect()
    return [bytes(r["_t"]) for r in held], np.array([r["_y"] for r in held], np.float64)
