"""Flat snapshot tables -> nested documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.functions import slug
from boxmill.plans.extract import Snapshot
from boxmill.session import settle


# A task with more rows than this is dealt to several parts, and so are the shapes of a chunk with more.  At most
# total_rows / TOGETHER of either can be, which bounds the broadcast lists of them.
TOGETHER = 100_000
_HASHES = 1 << 16
PORTION_SHAPES = 100_000_000


def snapshot_documents(
    snapshot: Snapshot,
    frames_per_document: int | None = 1000,
    shapes_per_document: int = 100_000,
) -> DataFrame:
    """Documents with ``task``, ``data_meta`` and ``annotations``.

    A task is cut into parts of so many frame ids; a part whose shapes exceed
    ``shapes_per_document`` is cut further, so no document grows with its task.
    Parts carry frame ids and are read back with ``Snapshot.of_documents``.
    ``frames_per_document=None`` gives the exchange form, one document per task,
    for tasks known to be small.

    The rows of all tables are dealt once, by task, to where their documents are put
    together; the tasks' own fields come to the same places.
    """
    cut = frames_per_document is not None

    def chunk_of(frame: Column) -> Column:
        return (F.floor(frame / F.lit(frames_per_document)) if cut else F.lit(0)).cast("long")

    def placed(rows: DataFrame, frame: Column) -> DataFrame:
        # rows without a task are in no document
        return rows.where(F.col("task_id").isNotNull()).withColumn("chunk", chunk_of(frame))

    frames = placed(snapshot.frames, F.col("frame_id"))
    deleted = placed(snapshot.deleted, F.col("frame_id"))
    gone_at = F.col("ord") if "ord" in snapshot.deleted.columns else F.col("frame_id")
    shapes = placed(snapshot.shapes, F.col("frame_id"))
    if cut:
        shapes = shapes.where(F.col("chunk").isNotNull())
    have = set(snapshot.shapes.columns)
    kinds = S.DOCUMENT["annotations"].dataType["shapes"].dataType.elementType
    name = lambda f: "frame_id" if f.name == "frame" else f.name
    # fields that no shape has are added when the rows are in their places
    place = [F.col("ord")] if "ord" in have else []
    packed = F.struct(*place, *[F.col(name(f)).cast(f.dataType).alias(f.name) for f in kinds.fields if name(f) in have])
    whole = lambda s: F.struct(*[
        (s[f.name] if name(f) in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds.fields])
    kind = S.DOCUMENT["annotations"].dataType["tracks"].dataType
    by = [c for c in snapshot.shapes.columns if c != "task_id"]
    sides = [
        (frames, "frames", F.struct(F.col("frame_id").alias("id"), "name", "width", "height"), None),
        (deleted, "deleted_frames", F.struct(gone_at.alias("at"), "frame_id"), None),
        (shapes, "shapes", packed, by),
    ]
    frame = [F.col("frames.id"), F.col("deleted_frames.frame_id"), F.col("shapes.frame")]
    if snapshot.tracks is not None:
        # a track goes with the frame it starts on
        tracks = placed(snapshot.tracks, F.coalesce("frame", F.lit(0)))
        track = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kind.elementType.fields])
        at = F.col("ord") if "ord" in snapshot.tracks.columns else F.col("id")
        sides.append((tracks, "tracks", F.struct(at.alias("at"), track.alias("t")), ["id", "frame", at]))
        frame.append(F.when(F.col("tracks").isNotNull(), F.coalesce("tracks.t.frame", F.lit(0))))

    hot = _hot_tasks(S.widen(*[rows.select("task_id") for rows, *_ in sides])) if cut else None
    rows = S.widen(*[
        _sliced(rows, by, shapes_per_document, hot).select("task_id", "chunk", "slice", one.alias(column))
        for rows, column, one, by in sides
    ])
    tasks, home = snapshot.tasks, ["task_id"]
    if hot is not None:
        # as many parts as the task has rows for; a part of its documents goes with its chunk and slice
        copies = F.ceil(F.col("_n") / F.lit(TOGETHER))
        hot = F.broadcast(hot.select("task_id", copies.alias("_copies")))
        part = F.when(F.col("_copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("chunk", "slice"), F.col("_copies")))
        rows = rows.join(hot, "task_id", "left").withColumn("_part", part.cast("int")).drop("_copies")
        parts = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)).cast("int") - 1)
        tasks = tasks.join(hot, "task_id", "left").withColumn("_part", F.explode(parts)).drop("_copies")
        home = ["task_id", "_part"]
    # the chunk is not sent along
    slices = [] if hot is None else ["slice"]
    dealt = rows.drop("chunk").repartition(*home) if hot is not None else rows.drop("chunk", "slice").repartition(*home)
    documents = dealt.groupBy(*home, chunk_of(F.coalesce(*frame)).alias("chunk"), *slices).agg(
        *[F.array_sort(F.collect_list(column)).alias(column) for _, column, *_ in sides]
    )
    if not cut:
        documents = tasks.select("task_id").join(documents, "task_id", "left")
    kinds_of = {
        "frames": S.DOCUMENT["data_meta"].dataType["frames"].dataType,
        "deleted_frames": S.DOCUMENT["data_meta"].dataType["deleted_frames"].dataType,
        "shapes": S.DOCUMENT["annotations"].dataType["shapes"].dataType,
        "tracks": kind,
    }
    plain = {
        "frames": lambda e: e, "deleted_frames": lambda e: e["frame_id"], "shapes": whole, "tracks": lambda e: e["t"],
    }
    empty = {c: F.array().cast(t) for c, t in kinds_of.items()}
    there = {c: F.coalesce(F.transform(c, plain[c]), empty[c]) for _, c, *_ in sides}
    documents = documents.join(tasks, home).select(
        F.struct(
            F.col("task_id").alias("id"), F.col("task_name").alias("name"),
            F.col("task_status").alias("status"), "subset",
            F.col("task_updated_date").alias("updated_date"),
            F.lit(None).cast("string").alias("updated_at"),
        ).alias("task"),
        *[there.get(c, empty[c]).cast(t).alias(c) for c, t in kinds_of.items()],
    )
    if cut:
        documents = _cut(documents, ["frames", "deleted_frames"], ["shapes", "tracks"], shapes_per_document)
    return documents.select(
        "task",
        F.struct("frames", "deleted_frames").alias("data_meta"),
        F.struct("shapes", "tracks").alias("annotations"),
    )


def in_portions(documents: DataFrame, snapshot: Snapshot) -> list[DataFrame]:
    """The ``documents`` of a large ``snapshot``, some tasks at a time.

    Written one after another they are all documents, and the shuffles of one portion only lie on disk together.
    """
    count = math.ceil(snapshot.shapes.count() / PORTION_SHAPES)
    if count < 2:
        return [documents]
    portion = F.pmod(F.xxhash64("task.id"), F.lit(count))
    return [documents.where(portion == i) for i in range(count)]


def _hot_tasks(rows: DataFrame) -> DataFrame | None:
    """The tasks with more rows than ``TOGETHER``, with ``_n``; counted one by one only where all of a hash have more."""
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64("task_id"), F.lit(_HASHES)))
    full = _hot(hashed, ["_hash"], TOGETHER)
    if full is None:
        return None
    return _hot(hashed.join(F.broadcast(full.select("_hash")), "_hash", "left_semi"), ["task_id"], TOGETHER)


def _hot(rows: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """The keys that more rows than ``limit`` have, with ``_n``; none if there are none."""
    found = settle(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit))
    return None if found.isEmpty() else found


def _sliced(rows: DataFrame, by: list | None, size: int, hot: DataFrame | None) -> DataFrame:
    """``rows`` with a ``slice``: those of a chunk with too many to be put together are dealt to as many as it takes.

    ``by`` are the columns that deal them; without any, or in tasks that are not ``hot``, all have slice 0.
    """
    large = None
    if by is not None and hot is not None:
        inside = rows.join(F.broadcast(hot.select("task_id")), "task_id", "left_semi")
        large = _hot(inside, ["task_id", "chunk"], max(size, TOGETHER))
    if large is None:
        return rows.withColumn("slice", F.lit(0))
    slices = large.select("task_id", "chunk", F.ceil(F.col("_n") / F.lit(size)).alias("_slices"))
    dealt = F.pmod(F.xxhash64(*by), F.col("_slices"))
    return rows.join(F.broadcast(slices), ["task_id", "chunk"], "left").withColumn(
        "slice", F.coalesce(dealt, F.lit(0)).cast("int")
    )


def _cut(documents: DataFrame, first: list[str], long: list[str], size: int) -> DataFrame:
    """Documents none of whose ``long`` arrays holds more than ``size``; the ``first`` ones stay in the first of a document."""
    count = F.greatest(F.lit(1), *[F.ceil(F.size(c) / F.lit(size)).cast("int") for c in long])
    rest = lambda i: [
        *[F.when(i == 0, F.col(c)).otherwise(F.array().cast(documents.schema[c].dataType)).alias(c) for c in first],
        *[F.slice(c, i * F.lit(size) + F.lit(1), F.lit(size)).alias(c) for c in long],
    ]
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(*rest(i)))
    return documents.select("task", F.explode(parts).alias("_document")).select("task", "_document.*")


def write_documents(documents: DataFrame, folder: str) -> None:
    """JSON, one directory ``document=<id>_<name slug>`` per task."""
    name = F.concat(F.col("task.id").cast("string"), F.lit("_"), slug("task.name"))
    documents.withColumn("document", name).write.mode("overwrite").partitionBy("document").json(folder)


def project_document(project_id: int, name: str, labels: DataFrame) -> DataFrame:
    """One-row project document with its label definitions (a settings list)."""
    has = set(labels.columns)
    one = F.struct(
        F.col("label_id").alias("id"), F.col("label_name").alias("name"),
        (F.col("color") if "color" in has else F.lit("")).alias("color"),
        (F.col("attributes") if "attributes" in has else F.array().cast(
            "array<struct<id:bigint,name:string>>")).alias("attributes"),
    )
    return labels.agg(F.array_sort(F.collect_list(one)).alias("labels")).select(
        F.lit(project_id).cast("long").alias("id"), F.lit(name).alias("name"), "labels"
    )
