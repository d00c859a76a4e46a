"""Task snapshot documents (nested JSON) and their flat tables."""

from __future__ import annotations

import sys
from urllib.parse import unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill import filesystem
from boxmill import schema as S
from boxmill.filesystem import open_filesystem
from boxmill.functions import creator_name, or_empty, parse_time, updated_date
from boxmill.session import settle
from boxmill.sources import json_cut

CORRUPT = "_corrupt_record"


_BLOCK = 1 << 20


def _ship() -> None:
    # workers get these functions by value; the package need not be installed
    for module in (sys.modules[__name__], filesystem, json_cut):
        cloudpickle.register_pickle_by_value(module)


def read_documents(
    spark: SparkSession,
    path: str | list[str],
    on_error: str = "fail",
    multi_line: bool | None = None,
) -> DataFrame:
    """One row per task document, however many a file holds and however they are laid out.

    A file whose first line is a whole document is JSON lines, which tasks read in splits; every line is then checked
    to hold whole documents.  Any other file (a document over several lines, several of them, an array of documents) is
    cut at its brackets by one task, as a stream.  ``multi_line`` says it beforehand for all files: True cuts them all,
    False reads them all as lines.  Broken documents, and anything that stands between documents, fail the job, or with
    ``on_error="skip"`` they are kept aside: see ``broken_documents``.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    if multi_line is False:
        return _parsed(_of_lines(spark.read.text(path)), on_error)
    _ship()
    # the names of the files, which Spark lists for any reader
    files = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")
    files = files.repartition(max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism)), "file")
    if multi_line:
        return _parsed(files.mapInArrow(_cut_files, _TEXTS), on_error)
    kinds = settle(files.mapInArrow(_first_lines, "file string, lines boolean"))
    by_line = [_listed(r["file"]) for r in kinds.where("lines").collect()]
    texts = kinds.where("not lines").select("file").mapInArrow(_cut_files, _TEXTS)
    if by_line:
        texts = texts.unionByName(_of_lines(spark.read.text(by_line)))
    return _parsed(texts, on_error)


_TEXTS = "file string, document string"


def _blocks(file: str, opened: dict):
    disk, inside = open_filesystem(_plain(file), opened)
    with disk.open_input_stream(inside) as source:
        while block := source.read(_BLOCK):
            yield block


def _plain(file: str) -> str:
    """The address of a listed file without escapes; that of a local one without its scheme."""
    plain = unquote(file)
    return "/" + plain.removeprefix("file:").lstrip("/") if plain.startswith("file:") else plain


def _first_lines(batches):
    """Whether the first line that is not blank is one whole document, for each file."""
    opened: dict = {}
    for batch in batches:
        files = batch.column(0).to_pylist()
        kinds = []
        for file in files:
            cutter, line = json_cut.Cutter(), None
            for block in _blocks(file, opened):
                text = block if line is not None else block.lstrip(json_cut._BLANK)
                if not text and line is None:
                    continue
                line, more, _ = text.partition(b"\n")
                found = list(cutter.feed(line))
                if more or found:
                    break
            else:
                found = []
            kinds.append(line is not None and len(found) == 1 and cutter.depth == 0 and not cutter.listed and found[0][:1] == b"{")
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(kinds, pa.bool_())], ["file", "lines"])


def _texts(files: list[str], documents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(files, pa.string()), pa.array([d.decode("utf-8", "replace") for d in documents], pa.string())],
        ["file", "document"],
    )


def _cut_files(batches):
    opened: dict = {}
    for batch in batches:
        for file in batch.column(0).to_pylist():
            held, size = [], 0
            for document in json_cut.documents(_blocks(file, opened)):
                held.append(document)
                size += len(document)
                if size > _BLOCK:
                    yield _texts([file] * len(held), held)
                    held, size = [], 0
            if held:
                yield _texts([file] * len(held), held)


def _cut_lines(batches):
    for batch in batches:
        for file, line in zip(*(c.to_pylist() for c in batch.columns)):
            found = list(json_cut.documents([line.encode("utf-8")]))
            yield _texts([file] * len(found), found)


def _of_lines(text: DataFrame) -> DataFrame:
    """Documents of lines; only a line that can hold something besides one object is cut."""
    _ship()
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("document")).where(
        F.col("document").rlike(r"[^\s\x{FEFF}]")
    )
    # NULL where the line is not a list of values, as with two objects that nothing parts
    values = F.json_array_length(F.concat(F.lit("["), F.col("document"), F.lit("]")))
    odd = ~F.col("document").rlike(r"^\s*\{") | ~values.eqNullSafe(F.lit(1))
    return lines.where(~odd).unionByName(lines.where(odd).mapInArrow(_cut_lines, _TEXTS))


def _listed(file: str) -> str:
    """The path of a file as it is listed: without escapes, glob characters taken literally."""
    plain = unquote(file)
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in plain)


def _parsed(texts: DataFrame, on_error: str) -> DataFrame:
    if on_error == "fail":
        found = F.from_json("document", S.DOCUMENT, {"mode": "FAILFAST"})
        return texts.select(found.alias("d")).select("d.*")
    layout = S.T.StructType([*S.DOCUMENT.fields, S.T.StructField(CORRUPT, S.T.StringType())])
    found = F.from_json("document", layout, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return texts.select(found.alias("d"), "file").select("d.*", F.col("file").alias("_file"))


def good_documents(documents: DataFrame) -> DataFrame:
    if CORRUPT not in documents.columns:
        return documents
    return documents.where(F.col(CORRUPT).isNull() & F.col("task.id").isNotNull())


def broken_documents(documents: DataFrame) -> DataFrame:
    """Files that could not be read as a document (nothing of them is used)."""
    return documents.where(F.col(CORRUPT).isNotNull() | F.col("task.id").isNull()).select("_file")


def read_project(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(S.PROJECT).json(path)


def labels_table(project: DataFrame) -> DataFrame:
    return project.select(F.inline("labels")).select(
        F.col("id").alias("label_id"),
        F.col("name").alias("label_name"),
        or_empty("color", "").alias("color"),
        F.coalesce("attributes", F.array().cast(S.LABELS["attributes"].dataType)).alias("attributes"),
    )


def task_columns() -> list[Column]:
    """Task fields of a document with their defaults."""
    return [
        F.col("task.id").alias("task_id"),
        or_empty("task.name", "").alias("task_name"),
        or_empty("task.status", "").alias("task_status"),
        or_empty("task.subset", "").alias("subset"),
        updated_date("task.updated_date", "task.updated_at").alias("task_updated_date"),
    ]


def clean_frames(frames: Column | str = "data_meta.frames") -> Column:
    """Frames with defaults; the id is the list position unless one is given."""
    f = F.col(frames) if isinstance(frames, str) else frames
    typed = F.coalesce(f, F.array().cast(S.DOCUMENT["data_meta"].dataType["frames"].dataType))
    return F.transform(
        typed,
        lambda x, i: F.struct(
            F.coalesce(x["id"], i).alias("frame_id"),
            F.coalesce(x["name"], F.lit("")).alias("name"),
            F.coalesce(x["width"], F.lit(0)).alias("width"),
            F.coalesce(x["height"], F.lit(0)).alias("height"),
        ),
    )


def shape_columns(shape: Column) -> list[Column]:
    """Fields of a raw shape with their defaults."""
    no_points = F.array().cast("array<double>")
    no_values = F.array().cast(S.ATTRIBUTE_VALUES)
    values = F.transform(
        F.coalesce(shape["attributes"], no_values),
        lambda a: F.struct(
            a["spec_id"].alias("spec_id"), F.coalesce(a["value"], F.lit("")).alias("value")
        ),
    )
    return [
        F.coalesce(shape["id"], F.lit(0)).alias("id"),
        shape["type"].alias("type"),
        shape["frame"].alias("frame_id"),
        shape["label_id"].alias("label_id"),
        F.coalesce(shape["points"], no_points).alias("points"),
        F.coalesce(shape["occluded"], F.lit(False)).alias("occluded"),
        F.coalesce(shape["z_order"], F.lit(0)).alias("z_order"),
        F.coalesce(shape["rotation"], F.lit(0.0)).alias("rotation"),
        F.coalesce(shape["source"], F.lit("")).alias("source"),
        values.alias("attributes"),
        creator_name(shape["created_by"], shape["owner"]).alias("created_by"),
    ]


def tasks_table(documents: DataFrame) -> DataFrame:
    # a task whose snapshot is spread over several documents, or exported twice, appears once: the latest
    tasks = documents.select(*task_columns())
    rest = [c for c in tasks.columns if c != "task_id"]
    latest = F.max(F.struct(parse_time("task_updated_date").alias("at"), F.struct(*rest).alias("t")))
    return tasks.groupBy("task_id").agg(latest.alias("_last")).select("task_id", "_last.t.*")


def frames_table(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("task.id").alias("task_id"), F.inline(clean_frames())
    )


def deleted_frames_table(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("task.id").alias("task_id"),
        F.posexplode("data_meta.deleted_frames").alias("ord", "frame_id"),
    ).select("task_id", "frame_id", F.col("ord").cast("long").alias("ord"))


def shapes_table(documents: DataFrame) -> DataFrame:
    one = documents.select(
        F.col("task.id").alias("task_id"),
        F.posexplode("annotations.shapes").alias("ord", "shape"),
    )
    return one.select("task_id", F.col("ord").cast("long").alias("ord"), *shape_columns(F.col("shape")))


def tracks_table(documents: DataFrame) -> DataFrame:
    one = documents.select(
        F.col("task.id").alias("task_id"),
        F.posexplode("annotations.tracks").alias("ord", "track"),
    )
    return one.select("task_id", F.col("ord").cast("long").alias("ord"), "track.*")
