"""Snapshots -> flat annotation rows and deleted-image rows.

Two inputs are understood.  Flat tables (tasks, frames, deleted frames, shapes)
are the form for large projects: boxes are counted per frame first, which tells
unannotated frames and lets the join spread frames with very many boxes.  Whole
documents, one row per task, are handled inside the row without any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.functions import attributes_map, checked_name, corners
from boxmill.operators.attributes import with_spec_targets
from boxmill.operators.selection import completed, drop_ignored, rectangles, select_tasks
from boxmill.operators.skew import lookup_join
from boxmill.session import settle
from boxmill.sources import documents as D

_TASK = ("task_name", "task_status", "task_updated_date", "subset")
_FRAME = ["task_id", "frame_id"]
_STEP = 1000


@dataclass(frozen=True)
class Snapshot:
    """Flat snapshot tables (see ``schema`` for their columns)."""

    tasks: DataFrame
    frames: DataFrame
    deleted: DataFrame
    shapes: DataFrame
    labels: DataFrame
    tracks: DataFrame | None = None
    # the tables but the tasks are unnested from documents that are written already
    unnested: bool = False

    @staticmethod
    def of_documents(docs: DataFrame | list[DataFrame], labels: DataFrame) -> "Snapshot":
        """Tables of documents, or of portions of them (``sinks.snapshots.in_portions``)."""
        # written once: every table takes its fields from the same parsed documents
        good = settle(*map(D.good_documents, docs if isinstance(docs, list) else [docs]))
        return Snapshot(
            D.tasks_table(good), D.frames_table(good), D.deleted_frames_table(good),
            D.shapes_table(good), labels, D.tracks_table(good), unnested=True,
        )

    def written(self) -> "Snapshot":
        """The tables written once; those that are read from written documents anyway are not written again."""
        if self.unnested:
            return replace(self, tasks=settle(self.tasks))
        return Snapshot(
            settle(self.tasks), settle(self.frames), settle(self.deleted), settle(self.shapes), self.labels,
            None if self.tracks is None else settle(self.tracks),
        )

    def of_tasks(self, tasks: DataFrame) -> "Snapshot":
        """The same snapshot reduced to the given tasks."""
        return replace(self, tasks=tasks)


@dataclass(frozen=True)
class Records:
    """What a snapshot holds: annotation rows (box and none) and deleted images."""

    annotations: DataFrame
    deleted: DataFrame

    def raw(self) -> DataFrame:
        return self.annotations.unionByName(self.deleted)


def spec_names(labels: DataFrame) -> DataFrame:
    """``spec_id, target``: attribute names by id; the last label wins."""
    one = labels.select("label_id", F.posexplode("attributes").alias("_i", "_a"))
    return one.groupBy(F.col("_a.id").alias("spec_id")).agg(
        F.max_by("_a.name", F.struct("label_id", "_i")).alias("target")
    )


def _label_names(labels: DataFrame) -> DataFrame:
    # a definition that comes twice must not double the boxes
    return labels.groupBy("label_id").agg(F.max("label_name").alias("label_name"))


def _named_attributes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    if "attributes" not in rows.columns:
        return rows.withColumn("attributes", S.empty_attributes())
    if "attributes" not in labels.columns:
        specs = labels.sparkSession.createDataFrame([], "spec_id long, target string")
    else:
        specs = spec_names(labels)
    known = with_spec_targets(rows, specs)
    names = F.transform("attributes", lambda a: F.coalesce(a["target"], a["spec_id"].cast("string")))
    values = F.transform("attributes", lambda a: a["value"])
    return known.withColumn("attributes", attributes_map(names, values))


def _box_columns(shape_columns: set[str]) -> list[Column]:
    def own(name: str, default):
        return F.col(name) if name in shape_columns else F.lit(default)

    return [
        F.lit(S.BOX).alias("instance_shape"),
        F.coalesce("label_name", F.lit(S.UNKNOWN)).alias("instance_label"),
        *corners("points"),
        own("created_by", "").alias("created_by_username"),
        own("occluded", False).alias("occluded"),
        own("z_order", 0).alias("z_order"),
        own("rotation", 0.0).alias("rotation"),
        own("source", "").alias("source"),
        own("id", None).cast("long").alias("annotation_id"),
        F.col("attributes"),
    ]


def _image_columns() -> list[Column]:
    return [
        checked_name("name").alias("image_name"),
        F.col("width").alias("image_width"),
        F.col("height").alias("image_height"),
    ]


def counted_frames(snapshot: Snapshot, deletions: bool = True) -> DataFrame:
    """Frames of the tasks with task fields, ``n_boxes`` and ``n_deleted`` (NULL without boxes, without deletions).

    Deletion records of frames nobody knows are rows of their own, without a frame's fields.  Without ``deletions``
    there is no ``n_deleted`` and there are no such rows.  Written once: all rows of a snapshot are made from it, and
    each kind takes its frames without looking at the others.
    """
    # task fields join the frames, of which there are fewer than shapes
    tasks = snapshot.tasks.select("task_id", *_TASK)
    boxes = rectangles(snapshot.shapes).groupBy(*_FRAME).agg(F.count("*").alias("n_boxes"))
    # counts first: tables grouped by frame are dealt for that already
    frames = snapshot.frames.join(boxes, _FRAME, "left")
    if deletions:
        gone = snapshot.deleted.groupBy(*_FRAME).agg(F.count("*").alias("n_deleted"))
        frames = frames.join(gone, _FRAME, "full")
    return settle(frames.join(tasks, "task_id"))


def box_rows(snapshot: Snapshot, frames: DataFrame | None = None) -> DataFrame:
    """One row per rectangle on a known frame, deleted frames included."""
    frames = counted_frames(snapshot, deletions=False) if frames is None else frames
    shapes = _named_attributes(rectangles(snapshot.shapes), snapshot.labels)
    boxed = frames.where(F.col("n_boxes").isNotNull())
    joined = lookup_join(shapes, boxed, _FRAME, "inner", weight="n_boxes", written=True).join(
        _label_names(snapshot.labels), "label_id", "left"
    )
    return S.conform(
        joined.select(
            *_image_columns(), *_box_columns(set(shapes.columns)),
            "task_id", *_TASK, "frame_id",
        )
    )


def unannotated_rows(snapshot: Snapshot, frames: DataFrame | None = None) -> DataFrame:
    """One row per frame that is neither deleted nor holds a rectangle."""
    frames = counted_frames(snapshot) if frames is None else frames
    free = frames.where(F.col("n_boxes").isNull() & F.col("n_deleted").isNull())
    return S.conform(
        free.select(*_image_columns(), F.lit(S.NONE).alias("instance_shape"), "task_id", *_TASK, "frame_id")
    )


def deleted_rows(snapshot: Snapshot, frames: DataFrame | None = None) -> DataFrame:
    """One row per deletion record; a frame nobody knows is ``<unknown>``, 0 x 0.

    ``frames`` are the counted ones, where they were made already.
    """
    tasks = snapshot.tasks.select("task_id", *_TASK)
    columns = ["task_id", "frame_id", "name", "width", "height"]
    if frames is None:
        known = snapshot.deleted.join(snapshot.frames.select(*columns), _FRAME, "left").join(tasks, "task_id")
    else:
        # counted frames hold the fields of their task, also where a record has no frame; a frame comes as often as it
        # is recorded, in two steps so that no row holds a long list
        upto = lambda n: F.sequence(F.lit(1), n.cast("int"))
        gone = frames.where(F.col("n_deleted").isNotNull()).select(*columns, *_TASK, "n_deleted")
        rest = F.col("n_deleted") - (F.col("_step") - 1) * F.lit(_STEP)
        steps = gone.withColumn("_step", F.explode(upto(F.ceil(F.col("n_deleted") / F.lit(_STEP)))))
        known = steps.withColumn("_record", F.explode(upto(F.least(rest, F.lit(_STEP)))))
    named = known.select(
        "task_id", "frame_id", *_TASK,
        F.when(F.col("width").isNull() & F.col("name").isNull(), F.lit(S.UNKNOWN))
        .otherwise(F.col("name")).alias("name"),
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
    )
    return S.conform(
        named.select(*_image_columns(), F.lit(S.DELETED).alias("instance_shape"), "task_id", *_TASK, "frame_id")
    )


def extract_records(snapshot: Snapshot) -> Records:
    frames = counted_frames(snapshot)
    annotations = box_rows(snapshot, frames).unionByName(unannotated_rows(snapshot, frames))
    return Records(annotations, deleted_rows(snapshot, frames))


def extract_documents(docs: DataFrame, labels: DataFrame) -> Records:
    """Extraction from whole documents, one row per task, inside the row.

    For documents that were cut into parts use ``Snapshot.of_documents``.
    """
    no_shapes = F.array().cast(S.DOCUMENT["annotations"].dataType["shapes"].dataType)
    no_ids = F.array().cast("array<int>")
    task = D.good_documents(docs).select(
        *D.task_columns(),
        D.clean_frames().alias("frames"),
        F.coalesce("data_meta.deleted_frames", no_ids).alias("gone"),
        F.coalesce("annotations.shapes", no_shapes).alias("shapes"),
    )
    frame_fields = ["frame.name", "frame.width", "frame.height"]

    def frame_at(i: Column) -> Column:
        # ids may be given explicitly; they equal the position otherwise
        here = F.get("frames", i)
        by_id = F.get(F.filter("frames", lambda f: f["frame_id"] == i), F.lit(0))
        return F.when(here["frame_id"] == i, here).otherwise(by_id)

    one = task.select(
        "task_id", *_TASK, "frames",
        F.posexplode(F.filter("shapes", lambda s: s["type"] == S.RECTANGLE)).alias("ord", "shape"),
    ).withColumn("frame", frame_at(F.col("shape.frame")))
    shapes = one.where(F.col("frame").isNotNull()).select(
        "task_id", "ord", *_TASK, *frame_fields, *D.shape_columns(F.col("shape"))
    )
    named = _named_attributes(shapes, labels)
    boxes = S.conform(
        named.join(_label_names(labels), "label_id", "left").select(
            *_image_columns(), *_box_columns(set(named.columns)), "task_id", *_TASK, "frame_id"
        )
    )
    boxed = F.transform(
        F.filter("shapes", lambda s: s["type"] == S.RECTANGLE), lambda s: s["frame"]
    )
    free = task.select(
        "task_id", *_TASK,
        F.explode(
            F.filter("frames", lambda f: ~F.array_contains(F.concat("gone", boxed), f["frame_id"]))
        ).alias("frame"),
    )
    none = S.conform(
        free.select("task_id", *_TASK, "frame.frame_id", *frame_fields).select(
            *_image_columns(), F.lit(S.NONE).alias("instance_shape"), "task_id", *_TASK, "frame_id"
        )
    )
    dead = task.select("task_id", *_TASK, "frames", F.explode("gone").alias("frame_id"))
    dead = dead.withColumn("frame", frame_at(F.col("frame_id"))).select(
        "task_id", *_TASK, "frame_id",
        F.when(F.col("frame").isNull(), F.lit(S.UNKNOWN)).otherwise(F.col("frame.name")).alias("name"),
        F.coalesce("frame.width", F.lit(0)).alias("width"),
        F.coalesce("frame.height", F.lit(0)).alias("height"),
    )
    deleted = S.conform(
        dead.select(*_image_columns(), F.lit(S.DELETED).alias("instance_shape"), "task_id", *_TASK, "frame_id")
    )
    return Records(boxes.unionByName(none), deleted)


def choose_tasks(
    tasks: DataFrame,
    ignored: DataFrame | None = None,
    selectors: list | None = None,
    completed_only: bool = False,
) -> DataFrame:
    """Ignore list first, then selectors, then status: an ignored task that is
    selected by name counts as not found."""
    if ignored is not None:
        tasks = drop_ignored(tasks, ignored)
    if selectors is not None:
        tasks = select_tasks(tasks, selectors).drop("pick")
    if completed_only:
        tasks = completed(tasks)
    return tasks


def fetch_project(
    snapshot: Snapshot,
    ignored: DataFrame | None = None,
    selectors: list | None = None,
    completed_only: bool = False,
) -> Records:
    """Extraction of the chosen tasks of a project."""
    tasks = choose_tasks(snapshot.tasks, ignored, selectors, completed_only)
    return extract_records(snapshot.of_tasks(tasks))


def fetch_annotations(snapshot: Snapshot, **choice) -> DataFrame:
    """The 26-column table of boxes and images without boxes."""
    return fetch_project(snapshot, **choice).annotations


def fetch_summary(records: Records) -> DataFrame:
    return records.raw().groupBy("instance_shape").agg(F.count("*").alias("n_rows"))
