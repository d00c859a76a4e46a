"""Which images exist where, which to copy and under which key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.functions import month_name, object_key
from boxmill.operators.lookup import attach_by_name, first_found, name_index, newest_object
from boxmill.operators.ordered import number_rows
from boxmill.operators.pick import order_key
from boxmill.operators.skew import lookup_join
from boxmill.operators.selection import split_deleted, with_labels, without_images

CACHED, DOWNLOAD, UPLOAD, EXISTING, FAILED, MISSING = (
    "cached", "download", "upload", "existing", "failed", "missing",
)


def image_tasks(annotations: DataFrame, order: list[str]) -> DataFrame:
    """``image_name, task_id``: the task of the first row of every image (NULLs come first)."""
    if order[0] == "task_id":
        none = F.count_if(F.col("task_id").isNull()) > 0
        first = F.when(none, F.lit(None)).otherwise(F.min("task_id"))
    else:
        first = F.min_by("task_id", order_key(annotations, order))
    return annotations.groupBy("image_name").agg(first.alias("task_id"))


def _present(names: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    return names.select(*(keys or []), name).distinct().withColumn("_present", F.lit(True))


def plan_download(
    annotations: DataFrame,
    objects: DataFrame | None,
    local: DataFrame,
    order: list[str],
) -> DataFrame:
    """``image_name, task_id, key, status`` for every image of the annotations.

    ``cached`` images are there already (``local`` lists names), ``failed`` ones
    have no object; without a storage everything not cached fails.
    """
    images = image_tasks(annotations, order)
    here = _present(local.select(F.col("name").alias("image_name")), "image_name")
    marked = images.join(here, "image_name", "left")
    if objects is None:
        keyed = marked.withColumn("key", F.lit(None).cast("string"))
    else:
        index = name_index(objects, "name", "key", ["ord"])
        keyed = attach_by_name(marked, index, "image_name", "key")
    status = (
        F.when(F.col("_present"), CACHED).when(F.col("key").isNull(), FAILED).otherwise(DOWNLOAD)
    )
    return keyed.select(
        "image_name", "task_id",
        F.when(F.col("_present").isNull(), F.col("key")).alias("key"),
        status.alias("status"),
    )


def plan_sync(objects: DataFrame, local: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every listed object with ``cached`` or ``download``.

    ``keys`` such as ``["project"]`` let one job handle all projects.
    """
    keys = keys or []
    here = _present(local, "name", keys)
    return objects.join(here, [*keys, "name"], "left").select(
        *keys, "key", "name",
        F.when(F.col("_present"), CACHED).otherwise(DOWNLOAD).alias("status"),
    )


def transfer_stats(plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counters of a plan or of a copy report (status column)."""
    done = F.col("status")
    out = plan.groupBy(*keys) if keys else plan.groupBy()
    return out.agg(
        F.count_if(done.isin(DOWNLOAD, UPLOAD, "copied")).alias("transferred"),
        F.count_if(done.isin(CACHED, EXISTING)).alias("skipped"),
        F.count_if(done.isin(FAILED, MISSING)).alias("failed"),
        F.count("*").alias("total"),
    )


def server_files(names: DataFrame, objects: DataFrame, month: str) -> DataFrame:
    """``image_name, server_file``: the newest stored object of that base name, or
    a new place in the folder of ``month``."""
    newest = newest_object(objects).select(F.col("base").alias("image_name"), F.col("name").alias("_stored"))
    return names.join(newest, "image_name", "left").select(
        "image_name",
        F.coalesce("_stored", month_name("image_name", month)).alias("server_file"),
        F.col("_stored").isNotNull().alias("is_stored"),
    )


def local_paths(names: DataFrame, files: DataFrame) -> DataFrame:
    """``image_name, image_path``: the file in the first search folder that has it."""
    found = first_found(files, ["dir_rank"]).select(
        F.col("name").alias("image_name"), F.col("path").alias("image_path")
    )
    return names.join(found, "image_name", "left")


def missing_images(names: DataFrame, files: DataFrame) -> DataFrame:
    have = files.select(F.col("name").alias("image_name")).distinct()
    return names.join(have, "image_name", "left_anti")


def unknown_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels in use that the project does not define."""
    used = rows.select("instance_label").dropna().distinct()
    return used.join(labels.select(F.col("label_name").alias("instance_label")), "instance_label", "left_anti")


def check_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows; raises when one uses a label the project does not define."""
    unknown = unknown_labels(rows, labels)
    names = [r[0] for r in unknown.orderBy("instance_label").limit(10).collect()]
    if names:
        known = [r[0] for r in labels.select("label_name").orderBy("label_name").limit(50).collect()]
        raise ValueError(
            f"labels not defined in the project: {', '.join(names)}; defined: {', '.join(known)}"
        )
    return rows


def upload_rows(dataset: DataFrame, choices: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chosen annotation rows, names of deleted images)."""
    normal, gone = split_deleted(dataset)
    return (
        with_labels(normal, choices),
        gone.select("image_name").dropna().distinct(),
    )


def upload_images(chosen: DataFrame, gone: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Images of an upload: the chosen ones that are not excluded, and the deleted."""
    names = chosen.select("image_name").dropna().distinct()
    if exclude is not None:
        names = without_images(names, exclude)
    return names.union(gone.select("image_name")).distinct()


def plan_upload(
    images: DataFrame, objects: DataFrame, files: DataFrame, prefix: str, month: str
) -> DataFrame:
    """``image_name, server_file, key, image_path, status`` for an upload.

    ``existing`` objects are not sent again; ``missing`` images are found neither
    locally nor in the storage.
    """
    placed = local_paths(server_files(images, objects, month), files)
    keyed = placed.withColumn("key", object_key(prefix, "server_file"))
    stored = objects.select("key").distinct().withColumn("_stored", F.lit(True))
    status = (
        F.when(F.col("_stored"), EXISTING)
        .when(F.col("image_path").isNull(), MISSING)
        .otherwise(UPLOAD)
    )
    return keyed.join(stored, "key", "left").select(
        "image_name", "server_file", "key", "image_path", status.alias("status")
    )


def enrich_paths(
    rows: DataFrame,
    prefix: str | None,
    files: DataFrame | None = None,
    mapping: DataFrame | None = None,
) -> DataFrame:
    """Fill ``s3_path`` (key under ``prefix``) and ``image_path`` (local file).

    ``mapping`` is ``image_name, server_file``; names outside it stand for
    themselves.  Rows without a local file keep their ``image_path``.
    """
    columns = rows.columns
    # one row per image with all that is looked up, so the rows are joined once
    tables = []
    if prefix is not None and mapping is not None:
        tables.append(mapping.select("image_name", "server_file"))
    if files is not None:
        ranked = files if "dir_rank" in files.columns else files.withColumn("dir_rank", F.lit(0))
        tables.append(
            first_found(ranked, ["dir_rank"]).select(
                F.col("name").alias("image_name"), F.col("path").alias("_local")
            )
        )
    out = rows
    if tables:
        known = tables[0] if len(tables) == 1 else tables[0].join(tables[1], "image_name", "full")
        out = lookup_join(rows, known, ["image_name"])
    if prefix is not None:
        name = F.coalesce("server_file", "image_name") if mapping is not None else F.col("image_name")
        out = out.withColumn("s3_path", object_key(prefix, name))
    if files is not None:
        kept = F.col("image_path") if "image_path" in columns else F.lit(None).cast("string")
        out = out.withColumn("image_path", F.coalesce("_local", kept))
    added = [c for c in ("s3_path", "image_path") if c in out.columns and c not in columns]
    return out.select(*columns, *added)


def jobs_per_task(images: DataFrame, size: int = 100, keys: list[str] | None = None) -> DataFrame:
    """Number of images and of jobs of ``size`` images."""
    counted = (images.groupBy(*keys) if keys else images.groupBy()).agg(F.count("*").alias("images"))
    return counted.withColumn("jobs", F.ceil(F.col("images") / F.lit(size)).cast("long"))


def job_numbers(images: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Job of every image when the sorted images are cut into jobs of ``size``."""
    numbered = number_rows(images, order, "_n", start=0)
    return numbered.withColumn("job", F.floor(F.col("_n") / F.lit(size)).cast("long")).drop("_n")
