"""Connected components of a link table by alternating large and small stars.

Each step points vertices at the smallest neighbour known; after a number of steps that grows with the
logarithm of the longest chain every vertex points at the smallest of its component.  Steps are joins and
aggregates over the links; a vertex with very many links is spread by ``lookup_join``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.operators.skew import lookup_join
from boxmill.session import settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step; ``links`` has columns u, v, both never equal."""
    if large:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = lookup_join(links, lowest, ["u"], "inner", weight="n")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        out = joined.select(F.inline(ends))
    return settle(out.where("u <> v").distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Written table id, component: the smallest id reachable, for every id that has a link to another.

    Links may be repeated or given in both directions; those with a NULL or to themselves say nothing.
    """
    edges = settle(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = _star(_star(edges, large=True), large=False)
    pointed = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return settle(pointed.unionByName(roots))
