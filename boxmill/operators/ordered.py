"""Dense numbering and neighbours over a global order.

A window without (or with a hot) partition key would put the rows in one task.
Here the rows are range-partitioned on the order, sorted inside each slice and
written once; what a slice needs from the slices before it is one small row per
slice.  The range cut uses all order columns, so one hot leading value is spread
over as many slices as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxmill.session import settle

SLICE, POS, NUMBER = "_slice", "_pos", "_number"
_POS_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number there


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sorted_slices(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` plus slice number and position inside the slice.

    The range cut samples the input first, so ``df`` is evaluated twice: keep costly
    expressions for after the numbering, or ``settle`` the input.

    Rows alike in all of ``order`` are told apart by an arbitrary running id, so
    many equal rows still spread over slices.
    """
    keys = [_col(o) for o in order]
    tagged = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tagged.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    return settle(
        ranged.select(
            *df.columns,
            F.spark_partition_id().alias(SLICE),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_BITS)).alias(POS),
        )
    )


def _with_global_number(sliced: DataFrame) -> DataFrame:
    # one row per slice, so neither the window nor the broadcast grows with the data
    sizes = sliced.groupBy(SLICE).agg(F.count("*").alias("_n"))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        sliced.join(F.broadcast(offsets), SLICE)
        .withColumn(NUMBER, F.col("_before") + F.col(POS))
        .drop("_before")
    )


def number_rows(
    df: DataFrame, order: list[Column | str], name: str = "n", start: int = 1
) -> DataFrame:
    """Dense running number over the whole table in the given order."""
    numbered = _with_global_number(sorted_slices(df, order))
    return numbered.select(*df.columns, (F.col(NUMBER) + F.lit(start)).alias(name))


def number_within(
    df: DataFrame,
    group: list[str],
    order: list[Column | str],
    name: str = "n",
    start: int = 1,
) -> DataFrame:
    """Dense running number inside each group.

    The group's first number is joined back on (slice, group): a slice is bounded,
    so this join stays balanced however large one group is.
    """
    numbered = _with_global_number(sorted_slices(df, [*group, *order]))
    heads = numbered.groupBy(SLICE, *group).agg(F.min(NUMBER).alias("_low"))
    per_group = Window.partitionBy(*group)  # at most one row per slice in here
    heads = heads.select(SLICE, *group, F.min("_low").over(per_group).alias("_first"))
    renamed = heads.select(
        F.col(SLICE).alias("_s"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first"
    )
    match = F.col(SLICE) == F.col("_s")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return numbered.join(renamed, match).select(
        *df.columns, (F.col(NUMBER) - F.col("_first") + F.lit(start)).alias(name)
    )


def with_previous(
    df: DataFrame, group: list[str], order: list[Column | str], value: str, name: str = "previous"
) -> DataFrame:
    """Value of the row just before, NULL for the first row of a group."""
    sliced = sorted_slices(df, [*group, *order])
    here = F.struct(F.struct(*[F.col(g) for g in group]).alias("g"), F.col(value).alias("v"))
    tails = sliced.groupBy(SLICE).agg(F.max_by(here, POS).alias("_tail"))
    # one row per slice
    tails = tails.select(SLICE, F.lag("_tail").over(Window.orderBy(SLICE)).alias("_carry"))
    inside = Window.partitionBy(SLICE).orderBy(POS)
    joined = sliced.join(F.broadcast(tails), SLICE).withColumn("_lag", F.lag(here).over(inside))
    prev = F.when(F.col(POS) == 0, F.col("_carry")).otherwise(F.col("_lag"))
    same = prev["g"].eqNullSafe(F.struct(*[F.col(g) for g in group]))
    return joined.select(*df.columns, F.when(same, prev["v"]).alias(name))
