"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text is unlabelled, toxic or not.  With the share of
toxic texts (the class prior) known, the risk on clean texts is that on unlabelled ones less what the toxic
ones among them add.  That difference is estimated, and where it is below zero
the steps undo it, which keeps a flexible model from learning the positives by heart.

The model is a linear unit over the presence of word features, hashed: the word, and its first five and four
bytes, which catch words of one stem.  A word that only toxic texts have stands in them 1 / prior times
as often as in unlabelled texts; a feature counts from ``LIFT`` of that ratio on, and if it is also more than
``SIGMAS`` standard deviations from chance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.llm import bytetext
from boxmill.llm.ship import ship
from boxmill.session import settle

BITS = 20
MIN_TEXTS = 4
LIFT, SIGMAS = 0.4, 5.0
BACK_STEP = 0.1  # how far a step goes back where the estimated risk on clean texts is negative
POSITIVES, UNLABELLED = 1500, 4500  # training rows, at most
LEVELS = 24  # powers of two of the number of words that have a weight
TURNS = 8  # random orders by which near copies among them are told


@dataclass
class Linear:
    weight: np.ndarray  # (1 << BITS) + LEVELS, float32, zero where nothing was learned
    offset: float


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed feature, row) of every word, itself and its first five and four bytes; and the level of each row.

    ASCII punctuation at both ends of a word does not count.  A row of n words is of the level log2(n), rounded down.
    """
    begin, stop, row = bytetext.words(data, start, end)
    level = np.frexp(np.bincount(row, minlength=len(start)))[1] - 1
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), level
    for _ in range(3):
        begin = begin + ((begin < stop - 1) & _PUNCTUATION[data[begin]])
        stop = stop - ((begin < stop - 1) & _PUNCTUATION[data[stop - 1]])
    found, rows = [], []
    for kind, cut in enumerate((None, 5, 4)):
        has = slice(None) if cut is None else np.flatnonzero(stop - begin > cut)
        ends = stop[has] if cut is None else begin[has] + cut
        code = bytetext.word_hashes(data, begin[has], ends)
        found.append((bytetext.mix(code + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[has])
    return np.concatenate(found), np.concatenate(rows), level


def level_features(level: int) -> np.ndarray:
    """The features of a row of that level: every power of two that it reaches."""
    return (1 << BITS) + np.arange(min(max(level, 0), LEVELS))


# fixed values: ASCII punctuation
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True


def _presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (feature, row) of the texts, by row; and the level of each text."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.cumsum([len(t) for t in texts])
    feature, row, level = features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], end[:-1])), end)
    both = np.unique(row << BITS | feature)
    return both & ((1 << BITS) - 1), both >> BITS, level


def _leasts(feature: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The first feature of each row in each of ``TURNS`` random orders; ``row`` ascends, rows without features get zeros."""
    out = np.zeros((rows, TURNS), np.uint64)
    if len(feature):
        filled, first = np.unique(row, return_index=True)
        code = bytetext.mix(feature.astype(np.uint64))
        for k, turn in enumerate(bytetext._numbers(TURNS, 11) | np.uint64(1)):
            out[filled, k] = np.minimum.reduceat(code * turn, first)
    return out


def _first_copies(leasts: np.ndarray) -> list[int]:
    """Rows that are no near copies of an earlier one, whose chance words would look like evidence.

    Two rows are near copies if five of the random orders have the same first feature in both.  Rows without features
    (all zeros) say nothing and go.
    """
    kept, holders = [], [{} for _ in range(TURNS)]
    for k, values in enumerate(leasts.tolist()):
        if not any(values):
            continue
        met: dict[int, int] = {}
        for held, value in zip(holders, values):
            for other in held.get(value, ()):
                met[other] = met.get(other, 0) + 1
        if max(met.values(), default=0) < 5:
            kept.append(k)
            for held, value in zip(holders, values):
                held.setdefault(value, []).append(k)
    return kept


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 800) -> Linear:
    """Minimise the non-negative risk with Adam; a row is its distinct features.

    Without positives, or without others, every text scores the same.
    """
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return Linear(np.zeros((1 << BITS) + LEVELS, np.float32), -6.0 if not n_p else 0.0)
    rows = [*positive, *unlabelled]
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, column = np.unique(np.concatenate(rows), return_inverse=True)
    weight, offset = np.zeros(len(used)), np.log(prior / (1 - prior))
    moment, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    toxic = np.arange(n_p + n_u) < n_p
    for step in range(1, steps + 1):
        z = offset + np.bincount(row, weight[column], n_p + n_u)
        grad = np.concatenate(risk_slope(z, toxic, prior, row, column, weight))
        moment += 0.1 * (grad - moment)
        square += 0.01 * (grad * grad - square)
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weight -= move[:-1]
        offset -= move[-1]
    full = np.zeros((1 << BITS) + LEVELS, np.float32)
    full[used] = weight
    return Linear(full, float(offset))


def risk_slope(
    z: np.ndarray, toxic: np.ndarray, prior: float, row: np.ndarray, column: np.ndarray, weight: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the risk by the weights, and by the offset; against the negative part where that part is below zero."""
    n_p, n_u = int(toxic.sum()), int((~toxic).sum())
    s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss_clean = np.logaddexp(0, z)
    rest = loss_clean[~toxic].mean() - prior * loss_clean[toxic].mean()
    if rest >= 0:
        slope = np.where(toxic, prior * (s - 1) / n_p - prior * s / n_p, s / n_u)
    else:
        slope = np.where(toxic, prior * (s - 1) / n_p + BACK_STEP * prior * s / n_p, -BACK_STEP * s / n_u)
    return np.bincount(column, slope[row], len(weight)) + 1e-5 * weight, np.array([slope.sum()])


def picked(in_p, in_u, n_p: int, n_u: int, prior: float):
    """Which features positives have beyond chance, by the rows that have them; for arrays or for columns.

    Texts of any length then have few features.
    """
    rate = (in_u + 1) / (n_u + 2.0)
    beyond = in_p - n_p * rate
    often = (in_p >= MIN_TEXTS) & (prior * in_p / n_p >= LIFT * rate)
    return often & (beyond >= 0) & (beyond * beyond >= SIGMAS**2 * n_p * rate * (1 - rate))


def train(positive: list[bytes], unlabelled: list[bytes], prior: float, steps: int = 800) -> Linear:
    """The model of texts at hand; without positives every text scores the same, near 0."""
    sides = []
    for texts in (positive, unlabelled):
        feature, row, level = _presence(texts)
        parts = np.split(feature, np.searchsorted(row, np.arange(1, len(texts)))) if texts else []
        sides.append([(parts[k], level[k]) for k in _first_copies(_leasts(feature, row, len(texts)))])
    n_p, n_u = map(len, sides)
    if n_p and n_u:
        many = 1 << BITS
        in_p, in_u = (np.bincount(np.concatenate([f for f, _ in side]), minlength=many) for side in sides)
        told = picked(in_p, in_u, n_p, n_u, prior)
        sides = [[np.append(f[told[f]], level_features(level)) for f, level in side] for side in sides]
    return fit(*sides, prior, steps)


def probabilities(data: np.ndarray, start: np.ndarray, end: np.ndarray, model: Linear) -> np.ndarray:
    feature, row, level = features(data, start, end)
    told = np.flatnonzero(model.weight[feature])
    both = np.unique(row[told] << BITS | feature[told])
    z = np.bincount(both >> BITS, model.weight[both & ((1 << BITS) - 1)], len(start)) + model.offset
    z += np.concatenate(([0.0], np.cumsum(model.weight[1 << BITS :])))[np.clip(level, 0, LEVELS)]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _scores(batches, model: Linear, text: str, out: str, carry: list[str]):
    for batch in batches:
        for piece in bytetext.slices(batch, text):
            found = probabilities(*bytetext.flat(piece.column(piece.schema.get_field_index(text))), model)
            kept = [piece.column(piece.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], [*carry, out])


def score(
    docs: DataFrame, model: Linear, text: str = "text", carry: list[str] | None = None, out: str = "score"
) -> DataFrame:
    """The columns ``carry`` (default: all) and ``out``, 0 to 1, for every row.

    The whole text is read; a NULL text counts as the empty one, which has no features.  A column already
    called score is replaced.
    """
    ship()
    # 4 MB, whatever the data; arrays and numbers only, which executors without the package can read
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.offset))
    kept = [c for c in (docs.columns if carry is None else carry) if c != out]
    bare = docs.select(*dict.fromkeys([*kept, text])).withColumn(text, docs[text].cast("string"))
    kinds = dict(zip(bare.columns, (f.dataType.simpleString() for f in bare.schema)))
    schema = "".join(f"`{c}` {kinds[c]}, " for c in kept) + f"`{out}` double"
    return bare.mapInArrow(lambda batches: _scores(batches, Linear(*held.value), text, out, kept), schema)


def _described(batches):
    """(row, toxic, distinct features, first feature in each random order) of a batch row, toxic, text."""
    for batch in batches:
        for piece in bytetext.slices(batch, "text"):
            data, start, end = bytetext.flat(piece.column(2))
            feature, row, level = features(data, start, end)
            both = np.unique(row << BITS | feature)
            row, feature = both >> BITS, both & ((1 << BITS) - 1)
            ends = np.searchsorted(row, np.arange(len(start) + 1)).astype(np.int32)
            leasts = _leasts(feature, row, len(start)).view(np.int64)
            steps = np.arange(len(start) + 1, dtype=np.int32) * TURNS
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0),
                    piece.column(1),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(steps), pa.array(leasts.ravel())),
                    pa.array(level.astype(np.int32)),
                ],
                ["row", "toxic", "features", "leasts", "level"],
            )


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, key: str = "doc_id", text: str = "text",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """(picked features of toxic rows, those of unlabelled rows, share of toxic ones) for ``fit``.

    At most ``positives`` toxic and ``unlabelled`` other rows, by a hash of the key, with their whole texts.

    Only labels of rows that ``allowed`` admits are read; the share of toxic ones among them is the prior.  A key with
    two labels is toxic.  Unlabelled rows are admitted rows too, whatever their label says.  A key with several texts
    counts with the first in byte order; rows without a key, or whose texts have no words, take no part.
    """
    ship()
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & allowed)
    one = known.groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    share = one.agg(F.avg(F.col("_y").cast("double"))).first()[0]
    prior = float(np.clip(share if share is not None else 0.1, 0.005, 0.95))
    toxic = one.where("_y = 1").select(key, F.lit(True).alias("toxic"), F.xxhash64(F.col(key), F.lit("sample")).alias("_o"))
    other = docs.where(F.col(key).isNotNull() & allowed).select(key).distinct()
    other = other.select(key, F.lit(False).alias("toxic"), F.xxhash64(F.col(key), F.lit("unlabelled")).alias("_o"))
    drawn = toxic.orderBy("_o", key).limit(positives).unionByName(other.orderBy("_o", key).limit(unlabelled))
    drawn = settle(drawn)  # two bounded lists of keys
    texts = docs.select(F.col(key), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), key)
    texts = texts.groupBy(key, "toxic", "_o").agg(F.min("text").alias("text"))
    name = F.xxhash64(F.col(key).cast("string"), "toxic").alias("row")
    order = settle(texts.select(name, "toxic", "text").mapInArrow(_described, "row long, toxic boolean, features array<int>, leasts array<long>, level int"))
    rows = order.select("row", "toxic", "leasts", "level").toArrow()  # a few numbers for each row of the bounded sample
    by_side = {}
    for side in (True, False):
        own = rows.filter(pc.equal(rows.column("toxic"), side)).sort_by("row")
        leasts = np.array(own.column("leasts").to_pylist(), np.int64).reshape(-1, TURNS).view(np.uint64)
        by_side[side] = own.take(pa.array(_first_copies(leasts), pa.int64())).to_pylist()
    n_p, n_u = len(by_side[True]), len(by_side[False])
    both = by_side[True] + by_side[False]
    if not n_p or not n_u:
        own = [level_features(r["level"]) for r in both]
        return own[:n_p], own[n_p:], prior
    numbered = [(r["row"], r["toxic"], n) for n, r in enumerate(both)]
    table = F.broadcast(spark.createDataFrame(numbered, "row long, toxic boolean, n int"))
    told = order.join(table, ["row", "toxic"]).select("n", "toxic", F.explode("features").alias("feature"))
    in_p, in_u = (F.count(F.when(F.col("toxic") == side, 1)).cast("double") for side in (True, False))
    counted = told.groupBy("feature").agg(in_p.alias("in_p"), in_u.alias("in_u"))
    chosen = counted.where(picked(F.col("in_p"), F.col("in_u"), n_p, n_u, prior)).select("feature")
    found = told.join(chosen, "feature", "left_semi").select("feature", "n").toArrow()
    feature, row = (found.column(c).to_numpy().astype(np.int64) for c in ("feature", "n"))
    order = np.lexsort((feature, row))
    parts = np.split(feature[order], np.searchsorted(row[order], np.arange(1, n_p + n_u)))
    parts = [np.append(own, level_features(r["level"])) for own, r in zip(parts, both)]
    return parts[:n_p], parts[n_p:], prior
