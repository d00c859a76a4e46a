"""Nearest neighbours by inner product along shifted Hilbert curves.

Every vector is projected onto a few random directions, several times over, each time with its own shift, and
gets its place on a Hilbert curve through each projection.  The table is range-partitioned and numbered along
every curve and cut into blocks of neighbouring places.  A query meets the blocks within a window of its own
place, on all curves; each block gives its best, and the best of all blocks are ranked again.  A task meets
one block with one stretch of queries at a time, both of bounded size.

How wide the window has to be depends on the vectors alone, so it is measured: for a bounded sample of
queries the exact neighbours are found against all rows, and the window is the distance along the nearest
curve that takes in ``reach`` of them.  Vectors with structure get a narrow one; vectors without any, as
random ones, a share of all rows, since no order of them can do better.

Equal vectors are one entry with their smallest ids, so copies neither fill the windows nor meet in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxmill.llm.ship import ship
from boxmill.operators.ordered import number_within
from boxmill.operators.skew import lookup_join
from boxmill.session import settle

CURVES, DIRECTIONS, BITS = 16, 6, 10
SAMPLE = 128  # queries the window is measured on
REACH = 0.95  # share of their neighbours that the window takes in
SMALL_BLOCK, BLOCK = 256, 1 << 21  # entries a block has at least, and numbers in its vectors at most
STRETCH = 4096  # queries that meet a block at once; one more block's at most
SCORES = 1 << 22  # inner products held at once
COPIES = 8  # parts in which the ids of equal vectors are cut down first


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of whole numbers below ``2 ** bits`` on the Hilbert curve of its dimension."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for axis in x:
            high = (axis & bit) != 0
            # reflect the first axis where this one is in its upper half, else swap the two
            swap = np.where(high, np.uint64(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(high, low, swap)
            if axis is not x[0]:
                axis ^= swap
    for axis in range(1, len(x)):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(level)) & one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    place = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            place = place << one | (axis >> np.uint64(level)) & one
    return place.astype(np.int64)


def _frames(size: int, curves: int, seed: int = 17) -> list[tuple[np.ndarray, np.ndarray]]:
    """(orthonormal directions, shift) of every curve."""
    rng = np.random.default_rng(seed)
    axes = min(DIRECTIONS, size)
    return [(np.linalg.qr(rng.normal(size=(size, axes)))[0], rng.uniform(0, 1, axes)) for _ in range(curves)]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Columns id, v of the rows that take part, one per id."""
    v = F.col(vector).cast("array<double>")
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x < limit) & (x > -limit))
    whole = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine & F.exists(v, lambda x: x != 0))
    single = dict(vectors.dtypes)[vector] == "array<float>"  # kept as it comes, at half the size
    kept = F.transform(v, lambda x: x + F.lit(0.0)).cast("array<float>" if single else "array<double>")
    rows = whole.select(F.col(key).cast("long").alias("id"), kept.alias("v"))
    # an id that comes with several vectors has the smallest of them
    one = rows.groupBy("id").agg(F.min("v").alias("v"))
    return one


def _same_size(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows of the commonest length (of the shorter one in a tie), and that length."""
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "size").limit(1).collect()
    size = top[0]["size"] if top else 1
    return rows.where(F.size("v") == size), size


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Written table v, ids: each distinct vector with its ``k + 1`` smallest ids."""
    part = F.pmod(F.xxhash64("id"), F.lit(COPIES)).alias("part")
    best = rows.select("id", "v", part)
    for by in (["v", "part"], ["v"]):
        order = Window.partitionBy(*by).orderBy("id")
        best = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    ids = F.sort_array(F.collect_list("id")).alias("ids")
    return settle(best.groupBy("v").agg(ids).withColumn("entry", F.col("ids")[0]))


def _exact(batches, sample: np.ndarray, own: np.ndarray, k: int):
    """The ``k`` nearest of each sample query in every batch."""
    for batch in batches:
        if not len(batch):
            continue
        v = np.array(batch["v"].tolist(), np.float64)
        entry = batch["entry"].to_numpy()
        nearness = sample @ v.T
        nearness[own[:, None] == entry[None, :]] = -np.inf
        top = np.argpartition(-nearness, min(k, v.shape[0] - 1), axis=1)[:, :k]
        query = np.repeat(np.arange(len(sample)), top.shape[1])
        yield pd.DataFrame({"query": query, "entry": entry[top].ravel(), "score": np.take_along_axis(nearness, top, 1).ravel()})


def _window(placed: DataFrame, entries: DataFrame, k: int, reach: float) -> int:
    """Half width along a curve; reads all entries once for ``SAMPLE`` of them."""
    order = F.xxhash64("entry", F.lit("sample"))
    drawn = entries.orderBy(order, "entry").limit(SAMPLE).select("entry", "v").collect()
    own = np.array([r["entry"] for r in drawn], np.int64)
    sample = np.array([r["v"] for r in drawn], np.float64)
    near = entries.select("entry", "v").mapInPandas(
        lambda batches: _exact(batches, sample, own, k), "query long, entry long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    # at most SAMPLE * k rows, each found on every curve
    truth = near.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") > float("-inf"))).select("query", "entry")
    pairs = [(r["query"], r["entry"]) for r in truth.collect()]
    if not pairs:
        return 1
    wanted = sorted({int(e) for _, e in pairs} | {int(e) for e in own})
    spark = entries.sparkSession
    listed = spark.createDataFrame([(e,) for e in wanted], "entry long")
    found = placed.select("curve", "entry", "at").join(F.broadcast(listed), "entry").collect()
    at = {(r["curve"], r["entry"]): r["at"] for r in found}
    curves = sorted({c for c, _ in at})
    gap = [min(abs(at[c, int(own[q])] - at[c, e]) for c in curves) for q, e in pairs]
    return max(1, int(np.quantile(gap, reach, method="higher")))


def _best(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best ids of one block for every vector that meets it, its own included.

    Rows that ``asks`` marks look for neighbours, the others are the block's entries.
    """
    empty = pd.DataFrame({"query": pd.Series([], dtype="int64"), "found": pd.Series([], dtype="object")})
    entries, queries = pdf[~pdf["asks"]], pdf[pdf["asks"]]
    if not len(entries) or not len(queries):
        return empty
    v = np.array(entries["v"].tolist(), np.float64)
    ids = entries["ids"].tolist()
    asked = queries["query"].to_numpy(np.int64)
    out = []
    step = max(1, SCORES // len(entries))
    for low in range(0, len(asked), step):
        q = np.array(queries["v"].iloc[low : low + step].tolist(), np.float64)
        rough = q @ v.T
        keep = min(k, len(ids))
        edge = np.partition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep]
        # what the product of matrices rounds differently is compared again below
        close = rough >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None]
        for n, query in enumerate(asked[low : low + step]):
            at = np.flatnonzero(close[n])
            score = (v[at] * q[n]).sum(axis=1)
            told = sorted((-s, i) for s, e in zip(score.tolist(), at) for i in ids[e])
            out.append((query, [{"far": s, "id": i} for s, i in told[:k]]))
    return pd.DataFrame(out, columns=["query", "found"])


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    curves: int = CURVES,
    reach: float = REACH,
) -> DataFrame:
    """The ``k`` nearest rows found of each query: query_id, rank (from 1), vec_id, score.

    ``is_query`` says of a row, by its column ``id``, whether it is a query; all other rows with other ids
    are candidates, queries too.  The score is the inner product of the original vectors in double precision.
    Vectors that are NULL, zero or empty, or hold a NULL or a number that is not finite, take no part; nor do
    rows without an id, or of another length than most.  Rows that repeat an id count once.  Ties go to the
    smaller id.  A query has fewer rows only if there are fewer candidates within its window.
    """
    ship()
    rows, size = _same_size(settle(usable(vectors, key, vector)))
    entries = _entries(rows, k)
    frames = _frames(size, curves)
    bound = entries.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    scale = float(bound) ** 0.5 if bound else 1.0

    def places(batches):
        for batch in batches:
            v = np.array(batch["v"].tolist(), np.float64).reshape(len(batch), -1)
            for curve, (axes, shift) in enumerate(frames):
                # 3 / sqrt(size) is about the largest projection of a random vector
                unit = (v @ axes) / scale * np.sqrt(size) / 6 + 0.5
                cells = np.clip((np.clip(unit, 0, 1) + shift) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
                place = hilbert_index(cells.astype(np.int64), BITS)
                yield pd.DataFrame({"entry": batch["entry"], "curve": curve, "place": place})

    # the curves order and number entries; their vectors are fetched once, into the blocks
    laid = entries.select("v", "entry").mapInPandas(places, "entry long, curve int, place long")
    placed = settle(number_within(settle(laid), ["curve"], ["place", "entry"], "at", start=0))
    window = _window(placed, entries, k, reach)
    block = min(max(window, SMALL_BLOCK), max(SMALL_BLOCK, BLOCK // size))
    around = -(-window // block)
    located = placed.select("curve", F.floor(F.col("at") / F.lit(block)).alias("block"), "entry")
    queries = rows.where(is_query).select(F.col("id").alias("query"), "v")
    # equal queries are one search, for one neighbour more than wanted, as each leaves itself out
    distinct = queries.groupBy("v").agg(F.count("*").alias("askers"))
    wanted = settle(entries.select("entry", "v").join(distinct, "v"))
    home = settle(located.join(wanted.select("entry"), "entry"))
    crowd = home.groupBy("curve", "block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    # so many blocks one after another are a stretch: its queries are few enough to meet a block at once
    run = max(1, STRETCH // crowd)

    def across(low, high):
        return F.explode(F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long")))

    at_run = F.floor(F.col("block") / F.lit(run)).alias("run")
    goal = across(F.col("block") - around, F.col("block") + around).alias("block")
    meeting = across((F.col("block") - around) / F.lit(run), (F.col("block") + around) / F.lit(run)).alias("run")
    asked = home.join(wanted, "entry").select("curve", at_run, goal, F.lit(True).alias("asks"), F.col("entry").alias("query"), "v", F.array().cast("array<long>").alias("ids"))
    held = located.join(entries, "entry").select("curve", meeting, "block", F.lit(False).alias("asks"), F.col("entry").alias("query"), "v", "ids")
    met = held.unionByName(asked).groupBy("curve", "block", "run")
    found = met.applyInPandas(lambda pdf: _best(pdf, k + 1), "query long, found array<struct<far: double, id: long>>")
    # one exchange by query; what a query found is sorted on disk if need be, never one array
    each = found.select("query", F.explode("found").alias("f")).select("query", "f.id", "f.far").repartition("query")
    once = each.groupBy("query", "id").agg(F.min("far").alias("far"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("far", "id"))
    best = once.withColumn("n", place).where(F.col("n") <= k + 1)
    merged = best.groupBy(F.col("query").alias("entry")).agg(F.array_sort(F.collect_list(F.struct("far", "id"))).alias("f"))
    answers = merged.join(wanted, "entry").select("v", "askers", "f")
    own = lookup_join(queries, answers, ["v"], "inner", weight="askers")
    others = F.slice(F.filter("f", lambda x: x["id"] != F.col("query")), 1, k)
    ranked = own.select("query", F.posexplode(others).alias("n", "f"))
    return ranked.select(
        F.col("query").alias("query_id"), (F.col("n") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.far")).alias("score")
    )
