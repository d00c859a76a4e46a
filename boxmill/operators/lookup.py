"""Ranked name lookups: which of several candidates answers to a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.functions import base_name
from boxmill.operators.skew import lookup_join


def name_index(
    entries: DataFrame, name: str, value: str, order: list[str], keys: list[str] | None = None
) -> DataFrame:
    """``keys, lookup, value``: what a listing answers for full names and base names.

    A full relative name beats a base name.  Among equal full names the last
    listed entry wins, among equal base names the first listed.
    """
    keys = keys or []
    base = base_name(name)
    position = F.struct(*[F.col(o) for o in order]).alias("at")
    both = F.array(
        F.struct(F.col(name).alias("lookup"), F.lit(True).alias("full")),
        F.struct(base.alias("lookup"), F.lit(False).alias("full")),
    )
    own = F.array(F.struct(F.col(name).alias("lookup"), F.lit(True).alias("full")))
    answers = F.when(base == F.col(name), own).otherwise(both)
    flat = entries.select(*keys, F.col(value).alias("_value"), position, F.inline(answers))
    if order == [value]:
        # the value is its own place: buffers of fixed width for numbers
        last_full = F.max(F.when(F.col("full"), F.col("_value")))
        first_base = F.min(F.when(~F.col("full"), F.col("_value")))
    else:
        last_full = F.max_by("_value", F.when(F.col("full"), F.col("at")))
        first_base = F.min_by("_value", F.when(~F.col("full"), F.col("at")))
    return flat.groupBy(*keys, "lookup").agg(F.coalesce(last_full, first_base).alias(value))


def attach_by_name(
    rows: DataFrame, index: DataFrame, name: str, value: str, keys: list[str] | None = None
) -> DataFrame:
    """Left join of rows on a ``name_index``: the name itself, else its base name.

    Meant for one row per name, such as the distinct images of a dataset.
    """
    keys = keys or []
    nested = F.instr(name, "/") > 0
    direct = index.select(*keys, F.col("lookup").alias("_l"), F.col(value).alias("_direct"))
    out = rows.withColumn("_l", F.col(name)).join(direct, [*keys, "_l"], "left").drop("_l")
    by_base = index.select(*keys, F.col("lookup").alias("_l"), F.col(value).alias("_base"))
    out = out.withColumn(
        "_l", F.when(nested & F.col("_direct").isNull(), base_name(name))
    ).join(by_base, [*keys, "_l"], "left").drop("_l")
    return out.withColumn(value, F.coalesce("_direct", "_base")).drop("_direct", "_base")


def first_found(files: DataFrame, ranks: list[str], by: str = "name", value: str = "path") -> DataFrame:
    """Path of the best-ranked candidate per name (search folders in order)."""
    return files.groupBy(by).agg(F.min_by(value, F.struct(*ranks, value)).alias(value))


def newest_object(objects: DataFrame) -> DataFrame:
    """``base, name, copies``: the lexicographically last name per base name, that
    is the latest month folder."""
    return objects.groupBy(base_name("name").alias("base")).agg(
        F.max("name").alias("name"), F.count("*").alias("copies")
    )


def duplicate_objects(objects: DataFrame) -> DataFrame:
    """Every object whose base name is listed more than once, with the one used."""
    newest = newest_object(objects).where("copies > 1").withColumnRenamed("name", "used")
    named = objects.select(base_name("name").alias("base"), "name")
    return lookup_join(named, newest, ["base"], "inner", weight="copies").select(
        "base", "name", "copies", (F.col("name") == F.col("used")).alias("is_used")
    )
