"""One row per key, chosen by an explicit order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# bits of the types whose values can stand in a packed key
_BITS = {"boolean": 1, "tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_PACKED_BITS = 126  # what 38 digits hold


def order_key(df: DataFrame, order: list[str]) -> Column:
    """One column that sorts as the columns ``order`` do (NULLs first).

    Whole numbers of at most 126 bits together become one decimal, whose aggregate
    buffers have a fixed width, so that minima are taken by hashing.  Other orders
    become a struct, which costs a sort.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    widths = [_BITS.get(types[c], _PACKED_BITS + 1) for c in order]
    if sum(w + 1 for w in widths) > _PACKED_BITS:
        return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    key = F.lit(0).cast("decimal(38,0)")
    for c, width in zip(order, widths):
        # 0 for NULL, the values of the type above it
        place = F.coalesce(F.col(c).cast("bigint").cast("decimal(20,0)") + F.lit(Decimal(2 ** (width - 1) + 1)), F.lit(0))
        key = (key * F.lit(Decimal(2 ** (width + 1)))).cast("decimal(38,0)") + place.cast("decimal(38,0)")
        key = key.cast("decimal(38,0)")
    return key


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Keep the row with the smallest ``order`` per key (NULLs come first).

    An aggregate, not a window: each map task passes on one row per key, so a key
    holding a large part of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[_col(o) for o in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Keep the row with the largest ``order`` per key (NULLs come last)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[_col(o) for o in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")
