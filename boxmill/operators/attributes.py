"""Attribute values of shapes against attribute definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.operators.skew import lookup_join
from boxmill.session import settle

_ROW = "_row"
FEW_SPECS = 200  # that are looked up one after another inside the row


def with_spec_targets(rows: DataFrame, specs: DataFrame, values: str = "attributes") -> DataFrame:
    """Turn ``values`` into structs ``spec_id, value, target``.

    ``specs`` is ``spec_id, target`` with one row per spec id, however many.  A few specs are looked up
    inside the row.  For more, the rows get a number and are written with it, so that it stays the same for both
    uses; their values are unnested, joined and put together again under it.  Rows need no key of their own, and
    may repeat.
    """
    kind = dict(specs.dtypes)["target"]
    known = settle(specs)
    if known.limit(FEW_SPECS + 1).count() <= FEW_SPECS:
        # a row of its own that every task gets: rows need no number then
        pairs = known.where(F.col("spec_id").isNotNull()).agg(
            F.map_from_entries(F.collect_list(F.struct("spec_id", "target"))).alias("_targets")
        )
        named = F.transform(
            values,
            lambda a: F.struct(
                a["spec_id"].alias("spec_id"), a["value"].alias("value"), F.element_at("_targets", a["spec_id"]).alias("target")
            ),
        )
        empty = F.array().cast(f"array<struct<spec_id:bigint,value:string,target:{kind}>>")
        return rows.crossJoin(F.broadcast(pairs)).withColumn(values, F.coalesce(named, empty)).select(*rows.columns)
    numbered = settle(rows.withColumn(_ROW, F.monotonically_increasing_id()))
    one = numbered.where(F.size(values) > 0).select(_ROW, F.posexplode(values).alias("_i", "_a"))
    joined = lookup_join(one.select(_ROW, "_i", "_a.*"), known, ["spec_id"], written=True)
    # as many entries as one row has attributes
    entry = F.struct("_i", "spec_id", "value", "target")
    packed = joined.groupBy(_ROW).agg(F.array_sort(F.collect_list(entry)).alias("_packed"))
    none = F.array().cast(f"array<struct<_i:int,spec_id:bigint,value:string,target:{kind}>>")
    restored = F.transform(
        F.coalesce("_packed", none),
        lambda a: F.struct(a["spec_id"].alias("spec_id"), a["value"].alias("value"), a["target"].alias("target")),
    )
    found = numbered.join(packed, _ROW, "left").withColumn(values, restored)
    return found.select(*rows.columns)
