"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks.  A period has one slot per unit of weight, so a source of weight w
gets w slots of each period.  Block j of the w blocks a source has in a period of C slots is released at slot
floor(j C / w) and due before slot ceil((j + 1) C / w); among the released blocks the earliest deadline goes
first.  Such a schedule always exists, and at every slot each source then has less than one block more or
less than its share of the slots so far.

The schedule repeats: the pattern of one period, a table of at most ``sum(weights)`` slots that depends on
the weights alone, says where each block goes, however many periods there are.  When a source runs out, its
last blocks are spread over one more period and the others go on in their proportions, so there are at most
two more patterns per source and every row is placed.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.operators.ordered import number_within
from boxmill.operators.skew import lookup_join
from boxmill.session import settle

BLOCK_ROWS = 32
SLICE_ROWS = 1 << 20  # rows of a written slice, about, at any size of the table
OTHER = "other sources"


def period_slots(blocks: Mapping[str, int]) -> dict[tuple[str, int], int]:
    """Earliest-deadline-first slots of one period: (source, block) -> slot."""
    total = sum(blocks.values())
    released: dict[int, list] = {}
    for name, n in blocks.items():
        for j in range(n):
            due = -(-(j + 1) * total // n)
            released.setdefault(j * total // n, []).append((due, name, j))
    slots, waiting = {}, []
    for slot in range(total):
        for block in released.get(slot, ()):
            heapq.heappush(waiting, block)
        due, name, j = heapq.heappop(waiting)
        if due <= slot:
            raise AssertionError("a block missed its deadline")
        slots[name, j] = slot
    return slots


def _runs(counts: Mapping[str, int], weights: Mapping[str, int]) -> list[int]:
    """First periods of the runs; within a run all periods hold the same blocks."""
    cuts = {0}
    for name, n in counts.items():
        cuts |= {n // weights[name], -(-n // weights[name])}
    return sorted(cuts)


def schedule(counts: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple]:
    """Rows (source, run, place, start, size, slot) that hold the whole schedule.

    ``place`` is the block's number among those its source has in a period, ``start`` the first slot of the
    run, ``size`` the slots of one of its periods and ``slot`` the block's slot in the period.
    """
    bounds, rows, start = _runs(counts, weights), [], 0
    for run, (low, high) in enumerate(zip(bounds, bounds[1:])):
        mix = {k: min(weights[k], n - low * weights[k]) for k, n in counts.items() if n > low * weights[k]}
        size = sum(mix.values())
        rows += [(k, run, j, start, size, slot) for (k, j), slot in period_slots(mix).items()]
        start += (high - low) * size
    return rows


def _stream(source: Column, weights: Mapping[str, int]) -> Column:
    """The name a source is mixed under: its own if it has a weight, else the common one."""
    own = [F.lit(k) for k in sorted(weights) if k != OTHER]
    name = source.cast("string")
    return F.when(name.isin(own), name).otherwise(F.lit(OTHER)) if own else F.lit(OTHER)


def _key(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))


def _first_places(names: DataFrame) -> DataFrame:
    """Written table stream, key, first, rows of a table stream, key, order: rows of a key take places from first on."""
    numbered = number_within(names, ["stream"], ["order"], "n", start=0)
    return settle(numbered.groupBy("stream", "key").agg(F.min("n").alias("first"), F.count("*").alias("rows")))


def _slots(rows: DataFrame, counts: Mapping[str, int], weights: Mapping[str, int], block_rows: int) -> DataFrame:
    """``rows`` with a column slot and a column at, by their stream and their number n in it."""
    table, bounds = schedule(counts, weights), _runs(counts, weights)
    kind = "stream string, run int, place long, start long, size long, first_period long, period_slot long"
    pattern = rows.sparkSession.createDataFrame(
        [(k, run, j, start, size, bounds[run], slot) for k, run, j, start, size, slot in table], kind
    )
    weight = F.coalesce(*[F.when(F.col("stream") == k, F.lit(w)) for k, w in weights.items()])
    block = F.floor(F.col("n") / F.lit(block_rows))
    dealt = rows.withColumn("block", block).withColumns(
        {"period": F.floor(F.col("block") / weight), "place": F.pmod("block", weight)}
    )
    run = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("period"))) - 1
    # the pattern has at most sum(weights) rows for each of the 2 * len(weights) + 1 runs
    found = dealt.withColumn("run", run).join(F.broadcast(pattern), ["stream", "run", "place"])
    slot = F.col("start") + (F.col("period") - F.col("first_period")) * F.col("size") + F.col("period_slot")
    return found.select(*rows.columns, slot.alias("slot"), F.pmod("n", F.lit(block_rows)).alias("at"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, int],
    key: str = "doc_id",
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """All rows of ``docs`` in mixed order, plus ``slot`` (of the block) and ``at`` (place in the block).

    ``weights`` gives whole numbers: slots of a source in a period.  Sources without one, and the NULL
    source, are mixed as one under the weight of ``OTHER`` (1 if not given).  Within a source rows come in
    the order of ``key``, those without a key first; rows that share source and key follow each other, each with a place
    of its own.  No row is left out or repeated.  The order is that of the partitions, and of the rows in them; an empty
    table gives an empty table.  Columns already called slot or at are replaced.

    The schedule is made from source and key alone; whole rows move twice, to their place and into order.
    """
    weights = {str(k): int(w) for k, w in weights.items()}
    weights.setdefault(OTHER, 1)
    if min(weights.values()) < 1 or block_rows < 1:
        raise ValueError("weights and block_rows are whole numbers from 1")
    name, entry = _stream(docs[source], weights).alias("stream"), _key(docs[key]).alias("key")
    places = _first_places(docs.select(name, entry, docs[key].alias("order")))
    # one row per weight, a number that the caller fixed
    sizes = places.groupBy("stream").agg(F.sum("rows").alias("n")).collect()
    counts = {r["stream"]: -(-r["n"] // block_rows) for r in sizes}
    rows = docs.select(name, entry, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # the same plan at every size: a table of places that happens to fit in memory is not broadcast
    placed = lookup_join(rows, places.hint("merge"), ["stream", "key"], "inner", weight="rows", written=True)
    single = placed.where("rows = 1").select("row", "stream", "key", F.col("first").alias("n"))
    if not places.where("rows > 1").isEmpty():
        # written before it is numbered, and dealt by slices, so neither a key with many rows nor a lost executor matters
        shared = number_within(placed.where("rows > 1"), ["stream", "key"], [], "rank", start=0)
        single = single.unionByName(shared.select("row", "stream", "key", (F.col("first") + F.col("rank")).alias("n")))
    found = _slots(single, counts, weights, block_rows)
    # enough slices for any number of rows, and places alike in all of them
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sum(counts.values())
    parts = max(parts, -(-total * block_rows // SLICE_ROWS))
    part = F.floor(F.col("slot") * F.lit(parts) / F.lit(max(total, 1))).cast("int")
    ordered = found.repartitionById(parts, part).sortWithinPartitions("slot", "at")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("slot", "at")]
    return ordered.select(*kept, "slot", "at")
