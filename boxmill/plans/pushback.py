"""Annotation rows -> shapes and deletions of existing tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.operators.lookup import name_index
from boxmill.operators.selection import complete_boxes
from boxmill.operators.skew import lookup_join
from boxmill.sources.documents import frames_table

PUSHED, NO_FRAME, NO_LABEL = "pushed", "no_frame", "no_label"


def frame_index(frames: DataFrame) -> DataFrame:
    """``task_id, lookup, frame_id``: frames by full name (last one) or base name
    (first one, when no frame has that full name)."""
    return name_index(
        frames.select("task_id", "frame_id", "name"), "name", "frame_id", ["frame_id"], ["task_id"]
    )


def match_shapes(annotations: DataFrame, frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Complete box rows with ``frame_id, label_id`` of the task and a ``status``.

    A row without a frame counts as such, whatever its label.
    """
    index = frame_index(frames).withColumnRenamed("lookup", "image_name")
    by_name = labels.groupBy(F.col("label_name").alias("instance_label")).agg(
        F.max("label_id").alias("label_id")
    )
    rows = complete_boxes(annotations).drop("frame_id", "label_id")
    placed = lookup_join(rows, index, ["task_id", "image_name"])
    # a short list of definitions: Spark broadcasts it where it is small, and splits hot labels otherwise
    found = placed.join(by_name, "instance_label", "left")
    status = (
        F.when(F.col("frame_id").isNull(), NO_FRAME)
        .when(F.col("label_id").isNull(), NO_LABEL)
        .otherwise(PUSHED)
    )
    return found.withColumn("status", status)


def to_shapes(annotations: DataFrame, frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Shapes ready to push: ``task_id, frame_id, label_id, type, points``."""
    return match_shapes(annotations, frames, labels).where(F.col("status") == PUSHED).select(
        "task_id", "frame_id", "label_id",
        F.lit(S.RECTANGLE).alias("type"),
        F.array("bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br").alias("points"),
    )


def push_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("status").agg(F.count("*").alias("n_rows"))


def mark_deleted(frames: DataFrame, deleted: DataFrame, names: DataFrame) -> DataFrame:
    """Deleted frames of every task after adding the named images.

    ``names`` is ``image_name`` and optionally ``task_id``; the result is the
    distinct union of the present and the new deletions.
    """
    keys = ["task_id", "image_name"] if "task_id" in names.columns else ["image_name"]
    index = frame_index(frames).withColumnRenamed("lookup", "image_name")
    added = lookup_join(index, names.select(*keys).distinct(), keys, "left_semi")
    return deleted.select("task_id", "frame_id").union(added.select("task_id", "frame_id")).distinct()


def mark_documents_deleted(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The same on whole documents: their sorted deletion lists are rewritten.

    A document without a named image stays as it is.  The list gathered per task is
    no longer than the frame list the document row holds already.
    """
    keys = ["task_id", "image_name"] if "task_id" in names.columns else ["image_name"]
    index = frame_index(frames_table(docs)).withColumnRenamed("lookup", "image_name")
    hits = index.join(names.select(*keys).distinct(), keys, "left_semi")
    more = hits.groupBy(F.col("task_id").alias("_task")).agg(F.collect_set("frame_id").alias("_more"))
    joined = docs.join(more, F.col("task.id") == F.col("_task"), "left")
    old = F.coalesce("data_meta.deleted_frames", F.array().cast("array<int>"))
    new = F.when(F.col("_more").isNull(), F.col("data_meta.deleted_frames")).otherwise(
        F.array_sort(F.array_union(old, "_more"))
    )
    return joined.withColumn("data_meta", F.col("data_meta").withField("deleted_frames", new)).select(
        *docs.columns
    )
