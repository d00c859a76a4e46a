"""History of annotations -> dataset, obsolete, in progress and deleted.

Per image only a few numbers decide: the latest annotation event, the latest
deletion event and the latest completed task.  They come from one aggregate, so
an image that fills a large part of the table is combined before the shuffle.
The aggregate also counts the rows of an image, and the join back onto the rows
spreads the images that have very many.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType
from pyspark.sql.window import Window

from boxmill import schema as S
from boxmill.functions import parse_time
from boxmill.operators.skew import lookup_join
from boxmill.session import settle

_NO_DATE = -(10**17) * 9  # microseconds; before every date
_TASK_SHIFT = Decimal(10) ** 19  # above every task id

DATASET, OBSOLETE, IN_PROGRESS = "dataset", "obsolete", "in_progress"


def counted_state(annotations: DataFrame, deleted: DataFrame) -> DataFrame:
    """What decides per image, written once, for callers that want both the parts and the deleted images."""
    return settle(_counted_state(annotations, deleted))


def _counted_state(annotations: DataFrame, deleted: DataFrame) -> DataFrame:
    done = F.col("task_status") == S.COMPLETED
    seen = annotations.select(
        "image_name",
        parse_time("task_updated_date").alias("seen_at"),
        F.lit(None).cast("timestamp").alias("gone_at"),
        F.lit(0).alias("deletion"),
        F.when(done, F.col("task_id")).alias("done_task"),
    )
    gone = deleted.select(
        "image_name",
        F.lit(None).cast("timestamp").alias("seen_at"),
        parse_time("task_updated_date").alias("gone_at"),
        F.lit(1).alias("deletion"),
        F.lit(None).cast("long").alias("done_task"),
    )
    # date and task in one number: the aggregate then has buffers of fixed width
    at = F.coalesce(F.unix_micros("seen_at"), F.lit(_NO_DATE)).cast("decimal(18,0)")
    task = F.col("done_task").cast("decimal(19,0)") + F.lit(_TASK_SHIFT)
    latest_done = F.max(F.when(F.col("done_task").isNotNull(), at * F.lit(2 * _TASK_SHIFT) + task))
    state = seen.unionByName(gone).groupBy("image_name").agg(
        F.max("seen_at").alias("seen_at"),
        F.max("gone_at").alias("gone_at"),
        F.max("deletion").alias("deletion"),
        F.count_if(F.col("deletion") == 0).alias("n_rows"),
        latest_done.alias("done"),
    )
    later = F.coalesce(F.col("gone_at") >= F.col("seen_at"), F.col("seen_at").isNull())
    return state.select(
        "image_name",
        ((F.col("deletion") == 1) & later).alias("is_gone"),
        "gone_at",
        (F.pmod("done", F.lit(2 * _TASK_SHIFT)) - F.lit(_TASK_SHIFT)).cast("long").alias("current_task"),
        "n_rows",
    )


def image_state(annotations: DataFrame, deleted: DataFrame) -> DataFrame:
    """``image_name, is_gone, current_task`` for every image seen anywhere.

    The latest event decides; a deletion wins a tie of dates, and unreadable
    dates come before all others.  ``current_task`` is the latest completed task
    (highest id among equal dates).
    """
    return _counted_state(annotations, deleted).drop("n_rows", "gone_at")


def partition_annotations(
    annotations: DataFrame, deleted: DataFrame, state: DataFrame | None = None
) -> DataFrame:
    """``annotations`` with a ``part`` column; ``state`` is their ``counted_state``, if it is there already.

    Both the decision and the rows read ``annotations``; ``settle`` them first when
    they come out of costly joins.
    """
    written = state is not None
    state = (state if written else _counted_state(annotations, deleted)).drop("gone_at")
    part = (
        F.when(F.coalesce("is_gone", F.lit(False)), OBSOLETE)
        .when(F.coalesce(F.col("task_status") != S.COMPLETED, F.lit(True)), IN_PROGRESS)
        .when(F.col("task_id") == F.col("current_task"), DATASET)
        .otherwise(OBSOLETE)
    )
    return (
        lookup_join(annotations, state, ["image_name"], weight="n_rows", written=written)
        .select(*annotations.columns, part.alias("part"))
    )


def deleted_images(
    annotations: DataFrame, deleted: DataFrame, order: list[str] | None = None, state: DataFrame | None = None
) -> DataFrame:
    """One deletion record per image whose latest event is a deletion.

    It is the record of the latest deleting task; the first listed one (by
    ``order``) among equals.
    """
    state = _counted_state(annotations, deleted) if state is None else state
    gone = state.where("is_gone").select(
        F.col("image_name").alias("_image"), F.col("gone_at").alias("_gone")
    )
    # NULL stands for images without a readable date
    newest = deleted.join(
        gone,
        (F.col("image_name") == F.col("_image"))
        & parse_time("task_updated_date").eqNullSafe(F.col("_gone")),
        "left_semi",
    )
    order = order or ["task_id", "frame_id"]
    # columns with a hash of their own settle ties; a map has none
    plain = [f.name for f in deleted.schema if isinstance(f.dataType, AtomicType)]
    first = Window.partitionBy("image_name").orderBy(*[F.col(c) for c in order], F.xxhash64(*plain))
    # a limit per window: each task passes on one row per image
    return newest.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def partition_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count("*").alias("n_rows"))


def partition_summary(parts: DataFrame, gone: DataFrame) -> DataFrame:
    """Row counts of the three parts and the number of deleted images."""
    images = gone.agg(F.count("*").alias("n_rows")).select(F.lit(S.DELETED).alias("part"), "n_rows")
    return partition_counts(parts).unionByName(images)
