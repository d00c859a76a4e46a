"""Two dataset versions and a deletion list -> one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.functions import parse_time
from boxmill.operators.skew import lookup_join

OLD, NEW = "old", "new"


def _sides(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Narrow union of both versions: what the decision per image needs."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        has = set(rows.columns)
        date = parse_time("task_updated_date") if "task_updated_date" in has else F.lit(None)
        split = F.col("split") if "split" in has else F.lit(None)
        at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]) if order else split
        return rows.where(F.col("image_name").isNotNull()).select(
            "image_name",
            F.lit(name).alias("side"),
            date.cast("timestamp").alias("at"),
            F.nullif(split.cast("string"), F.lit("")).alias("split"),
            at.alias("place"),
        )

    return side(old, OLD).unionByName(side(new, NEW))


def image_winners(
    old: DataFrame,
    new: DataFrame,
    deleted: DataFrame | None = None,
    by_time: bool = False,
    order: list[str] | None = None,
) -> DataFrame:
    """One row per image: which side stays, how many rows it has, its old split.

    ``winner`` is ``old``, ``new`` or NULL for an image on the deletion list.
    Without ``by_time`` the new version wins a shared image; with it the side
    with the later update does, the new one on a tie or an unreadable date.
    The old split is the first one set in ``order``.
    """
    is_old, is_new = F.col("side") == OLD, F.col("side") == NEW
    per_image = _sides(old, new, order or []).groupBy("image_name").agg(
        F.count_if(is_old).alias("old_rows"),
        F.count_if(is_new).alias("new_rows"),
        F.max(F.when(is_old, F.col("at"))).alias("old_at"),
        F.max(F.when(is_new, F.col("at"))).alias("new_at"),
        F.min_by("split", F.when(is_old & F.col("split").isNotNull(), F.col("place"))).alias("old_split"),
        F.max(F.when(is_new, F.col("split"))).isNotNull().alias("new_has_split"),
    )
    if deleted is None:
        listed = per_image.withColumn("listed", F.lit(False))
    else:
        names = deleted.select("image_name").distinct().withColumn("_hit", F.lit(True))
        listed = per_image.join(names, "image_name", "left").withColumn(
            "listed", F.coalesce("_hit", F.lit(False))
        )
    old_is_later: Column = F.lit(False)
    if by_time:
        old_is_later = F.coalesce(F.col("old_at") > F.col("new_at"), F.lit(False))
    both = (F.col("old_rows") > 0) & (F.col("new_rows") > 0)
    winner = (
        F.when(F.col("listed"), F.lit(None).cast("string"))
        .when(both & old_is_later, OLD)
        .when(F.col("new_rows") > 0, NEW)
        .otherwise(OLD)
    )
    return listed.select(
        "image_name", "old_rows", "new_rows", "old_split", "new_has_split", "listed",
        winner.alias("winner"),
    )


def merge_datasets(
    old: DataFrame,
    new: DataFrame,
    deleted: DataFrame | None = None,
    by_time: bool = False,
    order: list[str] | None = None,
) -> DataFrame:
    """Rows of the winning side of every image.

    Rows without a split get the old one of their image.  No image of the
    deletion list stays.
    """
    winners = image_winners(old, new, deleted, by_time, order).select(
        "image_name", "winner", "old_split", (F.col("old_rows") + F.col("new_rows")).alias("_rows")
    )
    rows = S.widen(old.withColumn("_side", F.lit(OLD)), new.withColumn("_side", F.lit(NEW)))
    # one pass over both versions against one row per image
    kept = lookup_join(rows, winners, ["image_name"], "inner", weight="_rows")
    kept = kept.where(F.col("_side") == F.col("winner"))
    columns = [c for c in rows.columns if c != "_side"]
    if "split" in columns:
        split = F.coalesce(F.nullif(F.col("split"), F.lit("")), F.col("old_split"))
        kept = kept.withColumn("split", split)
    return kept.select(*columns)


def merge_summary(winners: DataFrame) -> DataFrame:
    """Counters of a merge, from the per-image table alone."""
    both = (F.col("old_rows") > 0) & (F.col("new_rows") > 0)
    live = ~F.col("listed")
    kept = F.when(F.col("winner") == OLD, F.col("old_rows")).when(
        F.col("winner") == NEW, F.col("new_rows")
    )
    return winners.agg(
        F.count_if(live & (F.col("new_rows") == 0)).alias("only_old"),
        F.count_if(live & (F.col("old_rows") == 0)).alias("only_new"),
        F.count_if(live & both & (F.col("winner") == NEW)).alias("conflict_new"),
        F.count_if(live & both & (F.col("winner") == OLD)).alias("conflict_old"),
        F.count_if("listed").alias("deleted"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("total_rows"),
        F.count_if(both & F.col("old_split").isNotNull() & F.col("new_has_split")).alias("split_conflicts"),
    )
