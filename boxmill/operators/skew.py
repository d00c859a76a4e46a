"""Many-to-one joins that hold when a few keys own much of the table.

The adaptive skew join acts only when both sides of a join are plain shuffles.  A
side aggregated on the join key keeps the distribution of its aggregate and takes
that chance away.  So the per-key side is written first: it has one row per key, is
then read in its own right, and tells which keys are hot before the join is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.session import settle

# A key with more rows than this is spread.  At most total_rows / HOT_ROWS keys can
# be hot, which bounds the broadcast list of hot keys: 250,000 of 10^12 rows.
HOT_ROWS = 4_000_000
_NULL_SALTS = 1024


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "left",
    weight: str | None = None,
    written: bool = False,
) -> DataFrame:
    """Join ``rows`` to ``table``, which has one row per key.

    ``weight`` names the table column that says how many ``rows`` a key has.  When
    some key is hot, it gets one copy of its table row per ``HOT_ROWS`` rows, and its
    rows are dealt to the copies by the task that reads them, which stays the same
    when a task is run again.  Without hot keys, or without weights, this is a plain
    join that the adaptive skew join can split.  ``written`` says that the table
    comes straight from a scan already.
    """
    table = table if written else settle(table)
    if weight is None:
        return rows.join(table, keys, how)
    is_hot = F.col(weight) > HOT_ROWS
    if table.where(is_hot).isEmpty():
        return rows.join(table, keys, how)
    copies = F.ceil(F.col(weight) / F.lit(HOT_ROWS)).cast("int")
    hot = table.where(is_hot).select(*keys, copies.alias("_copies"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    task = F.spark_partition_id()
    # rows without a key match nothing and need no company
    salt = (
        F.when(missing, F.lit(-1) - F.pmod(task, F.lit(_NULL_SALTS)))
        .when(F.col("_copies").isNotNull(), F.pmod(task, F.col("_copies")))
        .otherwise(F.lit(0))
    )
    salted = marked.withColumn("_salt", salt.cast("int")).drop("_copies")
    slots = F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1)
    spread = table.withColumn("_salt", F.explode(slots))
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
