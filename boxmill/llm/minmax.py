"""Near-duplicate documents by min-max hashing of word shingles.

Of each of some random orders a document keeps both the smallest and the largest of its shingles, two values
a pass.  A band is the two values of three orders; documents that share one of the bands are candidates.  There
are as many bands (32 at a similarity of 0.85, 50 at 0.80) as let two documents at the limit miss each other
with a probability of at most 3e-7.  One bit each of 128 values goes along: candidates whose bits differ more than those of documents at the limit ever do (less
than one such pair in 10^9) are not fetched for the comparison of their sets.

Documents of the same shingle set are one class from the start, so copies never meet in a band.  In a band
every document is compared with one hub, not with every other; links to a hub join the classes.  What bands
still hold documents of several classes then goes by its rarest shingles: two linked documents share one of
the rarest ones of both, and its place among them bounds what else they can share.  Under each such shingle
the most typical document is the hub of one more round, and only what then can still be linked meets each
other.  No candidate is left out, and a band of near copies costs one comparison a document.  Links are
confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.llm import bytetext
from boxmill.llm.components import components
from boxmill.llm.ship import ship
from boxmill.operators.skew import lookup_join
from boxmill.session import settle

ORDERS = 96
BANDS = 32
BAND_ORDERS = 3
MISSED = 3e-7
SKETCH_BITS = 128
WIDTH = 5
PERCENT = 85

_SIGNED = "id long, n_shingles long, print binary, bands array<long>, sketch array<long>"


def signatures(codes: np.ndarray, cut: np.ndarray, orders: int = ORDERS) -> np.ndarray:
    """Smallest and largest of each run of shingle hashes (starting at ``cut``), one row per run.

    Columns 2k and 2k + 1 are the minimum and the maximum under order k, by their upper 32 bits.
    """
    out = np.empty((len(cut), 2 * orders), np.uint64)
    turn = bytetext._numbers(orders, 7) | np.uint64(1)
    for k in range(orders):
        ordered = codes * turn[k]
        out[:, 2 * k] = np.minimum.reduceat(ordered, cut) >> np.uint64(32)
        out[:, 2 * k + 1] = np.maximum.reduceat(ordered, cut) >> np.uint64(32)
    return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band, each of ``columns / bands`` neighbouring values and the band's number."""
    per = values.shape[1] // bands
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(values), 1))
    for k in range(per):
        keys = bytetext.mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k::per])
    return keys.view(np.int64)


def sketches(values: np.ndarray) -> np.ndarray:
    """The lowest bits of the first ``SKETCH_BITS`` values, as two 64-bit numbers a row."""
    bits = (values[:, :SKETCH_BITS] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def bands_for(percent: int) -> int:
    """Bands by which two sets at the similarity ``percent`` miss each other at most once in 1 / ``MISSED``."""
    if not 0 < percent <= 100:
        raise ValueError("percent is from 1 to 100")
    alike = (percent / 100) ** (2 * BAND_ORDERS)
    return max(1, ceil(log(MISSED) / log1p(-alike))) if alike < 1 else 1


def most_differing(percent: int) -> int:
    """Sketch bits in which two sets at the similarity ``percent`` may differ, but for one pair in 10^9."""
    differ, left = (1 - percent / 100) / 2, 1.0
    for d in range(SKETCH_BITS + 1):
        left -= comb(SKETCH_BITS, d) * differ**d * (1 - differ) ** (SKETCH_BITS - d)
        if left < 1e-9:
            return d
    return SKETCH_BITS


def _sets(piece: pa.RecordBatch, width: int):
    """(distinct shingles of every row, sorted; their number) of a piece of a batch id, text."""
    data, start, end = bytetext.flat(piece.column(1))
    codes, row = bytetext.shingles(data, start, end, width)
    cut = np.searchsorted(row, np.arange(len(start) + 1))
    sets = [np.unique(codes[a:b]) for a, b in zip(cut, cut[1:])]
    return sets, np.fromiter(map(len, sets), np.int64, len(sets))


def _sign(batches, width: int, n_bands: int):
    # sketches need their values, however few bands there are
    orders = max(n_bands * BAND_ORDERS, SKETCH_BITS // 2)
    for batch in batches:
        for piece in bytetext.slices(batch, "text"):
            sets, n = _sets(piece, width)
            full = np.flatnonzero(n)
            keys, bits = np.zeros((0, n_bands), np.int64), np.zeros((0, 2), np.int64)
            if len(full):
                cut = np.concatenate(([0], np.cumsum(n[full])))[:-1]
                values = signatures(np.concatenate(sets), cut, orders)
                keys, bits = band_keys(values[:, : 2 * BAND_ORDERS * n_bands], n_bands), sketches(values)
            filled = np.concatenate(([0], np.cumsum(n > 0))).astype(np.int32)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).cast(pa.int64()),
                    pa.array(n),
                    pa.array(prints, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(filled * np.int32(n_bands)), pa.array(keys.ravel())),
                    pa.ListArray.from_arrays(pa.array(filled * np.int32(2)), pa.array(bits.ravel())),
                ],
                ["id", "n_shingles", "print", "bands", "sketch"],
            )


def _full_sets(batches, width: int):
    for batch in batches:
        for piece in bytetext.slices(batch, "text"):
            sets, n = _sets(piece, width)
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), held], ["id", "shingles"])


def _crowded(rows: DataFrame) -> DataFrame:
    """The rows of keys that still hold two classes (columns key, id, n, class, s1, s2)."""
    sizes = rows.groupBy("key").agg(
        F.min("class").alias("_low"), F.max("class").alias("_high"), F.count("*").alias("_rows")
    )
    several = sizes.where("_low < _high").select("key", "_rows")
    return settle(lookup_join(rows, several, ["key"], "inner", weight="_rows").drop("_rows"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full shingle sets are alike enough; ``sets`` is written, one row per set."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_right"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_left", "_right"))
    every = F.size("_left") + F.size("_right") - shared
    return both.where(F.lit(100).cast("long") * shared >= F.lit(percent).cast("long") * every).drop("_left", "_right")


def _near(row: str, other: str, percent: int, placed: bool) -> Column:
    """Whether two rows of a key can be linked, by class, size, sketch and (if ``placed``) place of the key."""
    a, b = (lambda c: F.col(f"{row}{c}")), (lambda c: F.col(f"{other}{c}"))
    differ = F.bit_count(a("s1").bitwiseXOR(b("s1"))) + F.bit_count(a("s2").bitwiseXOR(b("s2")))
    near = (
        (a("class") != b("class"))
        & (F.least(a("n"), b("n")) * 100 >= F.greatest(a("n"), b("n")) * F.lit(percent))
        & (differ <= most_differing(percent))
    )
    if placed:
        # at the first shingle they share, all they share comes from there on
        shared = F.least(a("n") - a("pos"), b("n") - b("pos"))
        near = near & (shared * (100 + percent) >= (a("n") + b("n")) * F.lit(percent))
    return near


def _pairs(met: DataFrame, row: str, other: str) -> DataFrame:
    """Written table of the distinct pairs a, b, with their classes."""
    one, two = (F.struct(F.col(f"{p}id").alias("id"), F.col(f"{p}class").alias("class")) for p in (row, other))
    low, high = F.least(one, two), F.greatest(one, two)
    ends = [low["id"].alias("a"), high["id"].alias("b"), low["class"].alias("class_a"), high["class"].alias("class_b")]
    return settle(met.select(*ends).distinct())


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Written links a, b between the classes of confirmed pairs."""
    links = _confirmed(pairs, sets, percent).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    return settle(links.distinct())


def _with_hubs(rows: DataFrame, sets: DataFrame, percent: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """One round: (links to the hub of each key, the rows of keys that are not done, under their new classes)."""
    fields = [*by, *[c for c in rows.columns if c not in (*by, "key")]]
    hubs = settle(rows.groupBy("key").agg(F.min(F.struct(*fields)).alias("hub")))
    met = rows.join(hubs, "key").where(_near("", "hub.", percent, "pos" in fields))
    links = _linked(_pairs(met, "", "hub."), sets, percent)
    # an id with two sets has two rows, told apart by their sketches
    done = hubs.select("key", "hub.id", "hub.s1", "hub.s2")
    rest = rows.join(done, ["key", "id", "s1", "s2"], "left_anti")
    classes = components(links).withColumnRenamed("id", "class")
    rest = rest.join(classes, "class", "left").withColumn("class", F.coalesce("component", "class")).drop("component")
    return links, _crowded(rest)


def _rarest(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The documents of ``rows`` under the shingles that a link of theirs must go through; ``pos`` is the place.

    Shingles are ordered by the number of these documents that have them, so those of one document come
    first; two documents at the limit share one of the first ``n - ceil(n * percent / 100) + 1`` of each.
    """
    own = settle(rows.drop("key").distinct())
    held = sets.join(own.select("id"), "id", "left_semi").select("id", F.explode("shingles").alias("key"))
    common = held.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    ranked = lookup_join(held, common, ["key"], "inner", weight="rows")
    ordered = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rows", "key"))).alias("keys"))
    first = own.join(own.groupBy("id").agg(F.count("*").alias("sets")), "id").join(ordered, "id")
    last = F.col("n") - F.ceil(F.col("n") * percent / 100)
    # places below ``alone`` belong to shingles that nobody shares; an id with two sets has all its shingles,
    # as if each came first
    alone = F.when(F.col("sets") == 1, F.col("n") - F.size("keys"))
    kept = F.when(F.col("sets") > 1, F.col("keys")).otherwise(
        F.slice("keys", 1, F.greatest(last - F.col("alone") + 1, F.lit(0)).cast("int"))
    )
    spread = first.withColumn("alone", alone).select("id", "n", "class", "s1", "s2", "alone", F.posexplode(kept).alias("at", "k"))
    place = F.coalesce(F.col("alone") + F.col("at"), F.lit(0).cast("long")).alias("pos")
    return _crowded(spread.select(F.col("k.key").alias("key"), "id", "n", "class", "s1", "s2", place))


def _class_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between classes that start as single documents; ``rows`` and ``sets`` are written."""
    by_band, rest = _with_hubs(rows, sets, percent, ["id"])
    by_rarity, rest = _with_hubs(_rarest(rest, sets, percent), sets, percent, ["pos", "id"])
    other = rest.select("key", F.struct(*[c for c in rest.columns if c != "key"]).alias("other"))
    met = rest.join(other, "key").where((F.col("id") < F.col("other.id")) & _near("", "other.", percent, True))
    return by_band.unionByName(by_rarity).unionByName(_linked(_pairs(met, "", "other."), sets, percent))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes that are no ASCII white space, with A-Z lowered.  A document's set is that of its
    ``width``-word shingles; one with fewer words has all of them as its only shingle.  Documents with
    ``100 * shared >= percent * all`` shingles are linked; ``component_id`` is the smallest id reachable and
    ``kept`` says that it is the document's own.  A document without words, or of NULL text, has 0 shingles
    and is linked with nothing.  Rows that repeat an id are one document with several texts, each of which
    can link it.  A row without an id has its number of shingles, no component, and is kept.
    """
    ship()
    bare = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    n_bands = bands_for(percent)
    signed = settle(bare.mapInArrow(lambda batches: _sign(batches, width, n_bands), _SIGNED))
    named = signed.where("id is not null and n_shingles > 0")
    # one row per shingle set: its smallest document stands for all copies
    sets = settle(named.groupBy("print").agg(F.min("id").alias("head"), F.count("*").alias("rows")))
    heads = lookup_join(named, sets, ["print"], "inner", weight="rows", written=True).where("id = head")
    spread = settle(
        heads.dropDuplicates(["print"]).select(
            F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n"),
            F.col("sketch")[0].alias("s1"), F.col("sketch")[1].alias("s2"),
        )
    )
    rows = _crowded(spread.withColumn("class", F.col("id")))
    wanted = rows.select("id").distinct()
    # the same plan at every size: a list of ids that happens to fit in memory is not broadcast
    held = bare.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(
        lambda batches: _full_sets(batches, width), "id long, shingles array<long>"
    )
    links = _class_links(rows, settle(held), percent)
    # copies of one document id in two sets tie the sets together, as do links between heads
    ties = named.join(sets, "print").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    twice = named.groupBy("id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y").select("id")
    ties = ties.join(twice, F.col("a") == F.col("id"), "left_semi")
    joined = components(links.unionByName(ties))
    classes = sets.join(joined.withColumnRenamed("id", "head"), "head", "left")
    classes = classes.select("print", "rows", F.coalesce("component", "head").alias("component"))
    labelled = lookup_join(signed, classes, ["print"], "left", weight="rows")
    component = F.coalesce(F.col("component"), F.col("id"))
    return labelled.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
