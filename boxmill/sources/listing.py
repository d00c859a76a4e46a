"""File and object listings: only metadata is read, never contents.

Spark's own file scan leaves out names that begin with ``_`` or ``.`` and empty files, and keeps every path on the
driver.  Here tasks list folders themselves, and every name counts.
"""

from __future__ import annotations

import os
import sys
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill import filesystem
from boxmill import schema as S
from boxmill.filesystem import open_filesystem
from boxmill.functions import base_name, relative_key, stem, suffix
from boxmill.session import settle

# a task hands on the folders that it has not opened after so many entries
TASK_ENTRIES = 100_000
_BATCH = 10_000
_ENTRY = pa.schema(
    [("name", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("folder", pa.bool_())]
)
_LAYOUT = "name string, length long, modified timestamp, folder boolean"


def _ship() -> None:
    # workers get these functions by value; the package need not be installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(filesystem)


def _entries(disk, folder: str):
    """(name, is a folder, length, time of the last change) of what lies directly in a folder."""
    from pyarrow import fs

    if isinstance(disk, fs.LocalFileSystem):
        # one after another, so a folder may be of any size; a linked folder is not entered
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, True, None, None
                elif entry.is_file():
                    held = entry.stat()
                    yield entry.name, False, held.st_size, datetime.fromtimestamp(held.st_mtime, timezone.utc)
    else:
        for info in disk.get_file_info(fs.FileSelector(folder, recursive=False)):
            if info.type == fs.FileType.Directory:
                yield info.base_name, True, None, None
            elif info.type == fs.FileType.File:
                yield info.base_name, False, info.size, info.mtime


def _walk(batches, root: str, limit: int):
    """Files below the folders of ``batches``; those not opened when ``limit`` entries were seen come out as folders."""
    disk, top = open_filesystem(root)
    top = top.rstrip("/")
    waiting, rows, seen = [], [], 0

    def flushed():
        made = pa.RecordBatch.from_pylist(rows, _ENTRY)
        rows.clear()
        return made

    for batch in batches:
        waiting += batch.column(0).to_pylist()
    while waiting and seen < limit:
        folder = waiting.pop()
        inside = f"{folder}/" if folder else ""
        for name, is_folder, length, modified in _entries(disk, f"{top}/{folder}" if folder else top or "/"):
            seen += 1
            if is_folder:
                waiting.append(inside + name)
            else:
                rows.append({"name": inside + name, "length": length, "modified": modified, "folder": False})
                if len(rows) == _BATCH:
                    yield flushed()
    rows += [{"name": folder, "length": None, "modified": None, "folder": True} for folder in waiting]
    yield flushed()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, name (relative to root), length, modified`` of every file below, whatever it is called or holds.

    A task walks down from its folders and hands on what it has not opened after ``TASK_ENTRIES`` entries; the next
    round deals that to tasks anew, so a large tree is listed by many tasks, and the driver sees a number a round.  Each
    round is written once.  Folders that are links are not entered.  ``root`` may be any address that
    ``boxmill.filesystem`` opens; one that does not exist is an error.
    """
    from pyarrow import fs

    _ship()
    disk, top = open_filesystem(root)
    if disk.get_file_info(top.rstrip("/") or "/").type != fs.FileType.Directory:
        raise FileNotFoundError(f"No such file or directory: {root}")
    tasks = 4 * spark.sparkContext.defaultParallelism
    folders, rounds, many, limit = spark.createDataFrame([("",)], "name string"), [], 1, TASK_ENTRIES
    while many:
        dealt = folders.repartition(min(many, tasks), "name")
        found = settle(dealt.mapInArrow(lambda batches: _walk(batches, root, limit), _LAYOUT))
        rounds.append(found.where("not folder"))
        folders = found.where("folder").select("name")
        many = folders.count()
    files = rounds[0]
    for more in rounds[1:]:
        files = files.unionByName(more)
    base = root.rstrip("/") + "/"
    return files.select(F.concat(F.lit(base), "name").alias("path"), "name", "length", "modified")


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """``key, name`` of the objects of a bucket folder under a prefix.

    The test is a string prefix; the prefix marker itself is dropped.
    """
    files = list_files(spark, root).select(F.col("name").alias("key"))
    return object_names(files, prefix)


def object_names(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Listing of keys -> keys under ``prefix`` with their relative names."""
    kept = objects.where(F.startswith("key", F.lit(prefix))) if prefix else objects
    named = kept.withColumn("name", relative_key(prefix, "key"))
    return named.where(F.col("name") != "")


def image_files(files: DataFrame, extensions=S.IMAGE_EXTENSIONS) -> DataFrame:
    """Listing rows whose extension is an image extension (any case)."""
    return files.where(F.lower(suffix(base_name("name"))).isin(*extensions))


def search_listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Listings of several search folders with ``dir_rank`` = their order."""
    out = None
    for rank, folder in enumerate(folders):
        part = list_files(spark, folder).withColumn("dir_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out


def stem_candidates(files: DataFrame, subfolders=("images",)) -> DataFrame:
    """Search listing -> candidates for a lookup by file stem.

    Files directly in a folder come before those in ``subfolders``; deeper files
    are no candidates.  ``ext_rank`` is the place in the fixed extension order.
    """
    depth = F.size(F.split("name", "/"))
    parent = F.when(depth == 1, F.lit("")).otherwise(F.substring_index("name", "/", 1))
    order = F.array(*[F.lit(x) for x in ("", *subfolders)])
    exts = F.array(*[F.lit(x) for x in S.IMAGE_EXTENSIONS])
    return (
        files.where(depth <= 2)
        .select(
            "path", "name", "dir_rank",
            (F.array_position(order, parent) - 1).alias("sub_rank"),
            (F.array_position(exts, suffix(base_name("name"))) - 1).alias("ext_rank"),
            stem(base_name("name")).alias("stem"),
        )
        .where((F.col("sub_rank") >= 0) & (F.col("ext_rank") >= 0))
    )
