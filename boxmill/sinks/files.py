"""Label text files, dataset descriptor and file copies.

These are the places where files themselves are the product.  Python runs inside
tasks and touches one file at a time; paths may be local (shared mount) or any
address ``pyarrow.fs`` understands.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import time
import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill import filesystem
from boxmill.filesystem import open_filesystem
from boxmill.plans.yolo import present_splits, stem_collisions
from boxmill.session import settle

_MANIFEST = "split string, stem string, part int, lines long, path string, final boolean"
_HELD_BYTES = 4 << 20  # of a label file that are held before a segment is begun
_HELD_FOLDERS = 100_000  # that a task remembers to be there
_REPORT = "name string, src string, dst string, status string, error string"


def _ship() -> None:
    # workers get this module's functions by value; the package need not be installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(filesystem)


def _stream(disk, path: str):
    from pyarrow import fs

    if isinstance(disk, fs.LocalFileSystem):
        disk.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return disk.open_output_stream(path)


@contextmanager
def _published(disk, path: str, staging: str | None = None):
    """A stream whose bytes appear under ``path`` as a whole, when it is left without an error.

    Two attempts of a task may write the same file at once: each writes under a name of its own (in ``staging``, or
    beside the file) and moves it.  An object store shows an object when it is complete, so nothing is moved there.
    """
    from pyarrow import fs

    if isinstance(disk, (fs.S3FileSystem, fs.GcsFileSystem)):
        with disk.open_output_stream(path) as out:
            yield out
        return
    own = f"{staging}/{uuid.uuid4().hex}" if staging else f"{path}.{uuid.uuid4().hex}.partial"
    disk.create_dir(path.rsplit("/", 1)[0], recursive=True)
    try:
        with _stream(disk, own) as out:
            yield out
        disk.move(own, path)
    except BaseException:
        if disk.get_file_info(own).type == fs.FileType.File:
            disk.delete_file(own)
        raise


def write_blobs(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write a file for every row below ``folder``; the written table name, length.

    ``content`` is text or binary; a NULL is an empty file.  Names are distinct; a NULL name takes no part.
    """
    _ship()
    own = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    return settle(own.mapInPandas(lambda batches: _blobs(batches, folder), "name string, length long"))


def _blobs(batches, folder: str):
    from pyarrow import fs

    disk, root = open_filesystem(folder)
    root = root.rstrip("/")
    put = _Linked(root) if isinstance(disk, fs.LocalFileSystem) else None
    try:
        for batch in batches:
            sizes = []
            for name, content in zip(batch["name"], batch["content"]):
                if put:
                    put(f"{root}/{name}", content or b"")
                else:
                    with _published(disk, f"{root}/{name}", f"{root}/.staging") as out:
                        out.write(content or b"")
                sizes.append(len(content or b""))
            yield pd.DataFrame({"name": batch["name"], "length": sizes})
    finally:
        if put:
            put.close()


class _Linked:
    """Writes whole files of a mounted disk, each under a name of its own that is then linked to its place.

    Moves between folders wait for one another on the whole disk, links do not.  A place that is taken, or a disk
    without links, gets the file by a move.
    """

    def __init__(self, root: str):
        self.own = f"{root}/.staging/{uuid.uuid4().hex}"
        self.made: set[str] = set()
        os.makedirs(self.own)

    def __call__(self, path: str, content: bytes) -> None:
        above = path.rsplit("/", 1)[0]
        if above not in self.made:
            os.makedirs(above, exist_ok=True)
            if len(self.made) < _HELD_FOLDERS:
                self.made.add(above)
        own = f"{self.own}/file"
        with open(own, "wb", buffering=0) as out:
            rest = memoryview(content)
            while rest:
                rest = rest[out.write(rest):]
        try:
            os.link(own, path)
        except OSError:
            os.replace(own, path)
        else:
            os.unlink(own)

    def close(self) -> None:
        shutil.rmtree(self.own, ignore_errors=True)


def write_label_files(lines: DataFrame, empty: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """Write ``labels/<split>/<stem>.txt`` for every image; returns the manifest.

    Lines are range-partitioned by image and line order, so an image with very
    many lines is written by several tasks as segments.  Only the first and last
    image of a task can continue elsewhere; those segments are joined afterwards,
    one streamed file at a time.  ``empty`` images get an empty file.
    """
    _ship()
    _, root = open_filesystem(folder)
    sort = ["split", "stem", *order]
    ranged = lines.select("split", "stem", *order, "line").repartitionByRange(*sort).sortWithinPartitions(*sort)
    emitted = settle(
        ranged.select("split", "stem", "line").mapInPandas(
            lambda batches: _emit(batches, folder, root), _MANIFEST
        )
    )
    open_ends = emitted.where("not final")
    joined = settle(
        open_ends.groupBy("split", "stem")
        # at most one segment per task
        .agg(F.array_sort(F.collect_list(F.struct("part", "path", "lines"))).alias("segments"))
        .select("split", "stem", F.to_json("segments").alias("segments"))
        .mapInPandas(lambda batches: _join_segments(batches, folder, root), _MANIFEST)
    )
    blanks = settle(
        empty.select("split", "stem").distinct()
        .mapInPandas(lambda batches: _emit_empty(batches, folder, root), _MANIFEST)
    )
    _drop_segments(folder)
    return emitted.where("final").unionByName(joined).unionByName(blanks).select(
        "split", "stem", "lines", "path"
    )


def _drop_segments(folder: str) -> None:
    """Segments are only needed until they are joined; those of repeated tasks go with them."""
    from pyarrow import fs

    disk, root = open_filesystem(folder)
    if disk.get_file_info(f"{root}/.segments").type == fs.FileType.Directory:
        disk.delete_dir(f"{root}/.segments")


def _emit(batches, folder: str, root: str):
    """Write runs of equal (split, stem); the first and the last run of the task as segments.

    Segments are named by the attempt, so two attempts of a task never share one; only those that the manifest names
    are read.  A short run between others goes to its file at once, a long one by way of a segment.
    """
    from pyspark import TaskContext

    part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
    disk, _ = open_filesystem(folder)
    run, held, out, path, count, first, number = None, [], None, "", 0, True, 0

    def segment():
        nonlocal out, path, number
        if out is None:
            path = f"{root}/.segments/{own}-{number}"
            out, number = _stream(disk, path), number + 1
        out.write(b"".join(held))
        held.clear()

    def closed(last: bool):
        nonlocal out, path, first
        target, final = f"{root}/labels/{run[0]}/{run[1]}.txt", not (first or last)
        if final and out is None:
            with _published(disk, target, f"{root}/.segments") as whole:
                whole.write(b"".join(held))
            held.clear()
            path = target
        else:
            segment()
            out.close()
            if final:
                disk.create_dir(target.rsplit("/", 1)[0], recursive=True)
                disk.move(path, target)
                path = target
        out, first = None, False
        return (*run, part, count, path, final)

    for batch in batches:
        done = []
        key = batch["split"].ne(batch["split"].shift()) | batch["stem"].ne(batch["stem"].shift())
        starts = [*key.to_numpy().nonzero()[0].tolist(), len(batch)]
        splits, stems, lines = (batch[c].tolist() for c in ("split", "stem", "line"))
        for low, high in zip(starts, starts[1:]):
            if run != (splits[low], stems[low]):
                if run is not None:
                    done.append(closed(last=False))
                run, count = (splits[low], stems[low]), 0
            held.append(("\n".join(lines[low:high]) + "\n").encode())
            count += high - low
            if sum(map(len, held)) > _HELD_BYTES:
                segment()
        if done:
            yield pd.DataFrame(done, columns=["split", "stem", "part", "lines", "path", "final"])
    if run is not None:
        yield pd.DataFrame([closed(last=True)], columns=["split", "stem", "part", "lines", "path", "final"])


def _join_segments(batches, folder: str, root: str):
    disk, _ = open_filesystem(folder)
    for batch in batches:
        rows = []
        for split, stem, packed in zip(batch["split"], batch["stem"], batch["segments"]):
            segments = json.loads(packed)
            target = f"{root}/labels/{split}/{stem}.txt"
            with _published(disk, target, f"{root}/.segments") as out:
                for segment in segments:
                    with disk.open_input_stream(segment["path"]) as source:
                        while chunk := source.read(1 << 20):
                            out.write(chunk)
            rows.append((split, stem, 0, sum(s["lines"] for s in segments), target, True))
        yield pd.DataFrame(rows, columns=["split", "stem", "part", "lines", "path", "final"])


def _emit_empty(batches, folder: str, root: str):
    disk, _ = open_filesystem(folder)
    for batch in batches:
        rows = []
        for split, stem in zip(batch["split"], batch["stem"]):
            target = f"{root}/labels/{split}/{stem}.txt"
            with _published(disk, target, f"{root}/.segments"):
                pass
            rows.append((split, stem, 0, 0, target, True))
        yield pd.DataFrame(rows, columns=["split", "stem", "part", "lines", "path", "final"])


def check_stems(rows: DataFrame) -> DataFrame:
    """The rows; raises when two images of a split would share a label file."""
    bad = stem_collisions(rows)
    names = [f"{r['split']}/{r['stem']}" for r in bad.orderBy("split", "stem").limit(10).collect()]
    if names:
        raise ValueError(f"{bad.count()} label files belong to several images, such as: {', '.join(names)}")
    return rows


def write_descriptor(rows: DataFrame, classes: DataFrame, folder: str) -> None:
    """``dataset.yaml``: path, image folder per split, class names by id.

    Class names are streamed in id order, not gathered.
    """
    disk, root = open_filesystem(folder)
    # The three splits a descriptor can name, in this order.
    named = present_splits(rows).where(F.col("split").isin("train", "val", "test"))
    used = {r["split"] for r in named.collect()}
    with _published(disk, f"{root}/dataset.yaml") as out:
        out.write(f"path: {json.dumps(root)}\n".encode())
        for split in ("train", "val", "test"):
            if split in used:
                out.write(f"{split}: images/{split}\n".encode())
        out.write(b"names:\n")
        for r in classes.orderBy("class_id").toLocalIterator():
            out.write(f"  {r['class_id']}: {json.dumps(r['instance_label'])}\n".encode())


def copy_files(plan: DataFrame, folder: str = "", attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """Copy ``src`` to ``dst`` for every row of ``name, src, dst``; returns a report.

    Status is ``copied``, ``existing`` (nothing done) or ``failed`` after the
    given number of attempts; one bad file does not stop the others.  The report
    is written once, so reading it does not copy again.
    """
    _ship()
    # one file is one unit of work: spread them evenly, however they are stored
    spread = plan.select("name", "src", "dst").repartition("dst")
    return settle(spread.mapInPandas(lambda batches: _copy(batches, attempts, wait), _REPORT))


def _copy(batches, attempts: int, wait: float):
    from pyarrow import fs

    opened: dict = {}
    for batch in batches:
        rows = []
        for name, src, dst in zip(batch["name"], batch["src"], batch["dst"]):
            status, error = "failed", None
            for attempt in range(attempts):
                try:
                    source, src_path = open_filesystem(src, opened)
                    target, dst_path = open_filesystem(dst, opened)
                    if target.get_file_info(dst_path).type != fs.FileType.NotFound:
                        status, error = "existing", None
                        break
                    # a half-written copy never carries the final name
                    with source.open_input_stream(src_path) as data, _published(target, dst_path) as out:
                        while chunk := data.read(1 << 20):
                            out.write(chunk)
                    status, error = "copied", None
                    break
                except Exception as problem:  # whatever is wrong with one file belongs in its row
                    error = f"{type(problem).__name__}: {problem}"
                    if not isinstance(problem, OSError):
                        break
                    if attempt + 1 < attempts:
                        time.sleep(min(wait * 2**attempt, 10))
            rows.append((name, src, dst, status, error))
        yield pd.DataFrame(rows, columns=["name", "src", "dst", "status", "error"])
