"""Dataset tables as Parquet or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.functions import attributes_json
from boxmill.plans.extract import Records
from boxmill.plans.partition import DATASET, IN_PROGRESS, OBSOLETE, counted_state, deleted_images, partition_annotations
from boxmill.session import settle


def as_text_table(rows: DataFrame) -> DataFrame:
    """The 26 columns with ``attributes`` as JSON text; absent columns are NULL."""
    return S.conform(rows).withColumn("attributes", attributes_json("attributes"))


def write_table(rows: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write rows with the dataset columns (and ``partition_by``) in the given format.

    An empty table is written with its columns.
    """
    extra = [c for c in partition_by or [] if c not in S.COLUMNS]
    if fmt == "csv":
        table = S.conform(rows.drop(*extra)) if not extra else _with_extra(rows, extra)
        table = table.withColumn("attributes", attributes_json("attributes"))
        writer = table.write.option("header", True).option("quote", '"').option("escape", '"')
    else:
        table = S.conform(rows) if not extra else _with_extra(rows, extra)
        writer = table.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.mode("overwrite").format(fmt).save(path)


def _with_extra(rows: DataFrame, extra: list[str]) -> DataFrame:
    kept = S.T.StructType(S.ANNOTATION.fields + [rows.schema[c] for c in extra])
    return S.conform(rows, kept)


def write_partitioned(records: Records, folder: str, fmt: str = "parquet") -> None:
    """``parts/part=dataset|obsolete|in_progress`` and ``deleted``.

    The extracted rows are read three times here (state per image, rows, deleted
    images), so they are written once first instead of being extracted again.
    """
    kept = Records(settle(records.annotations), settle(records.deleted))
    state = counted_state(kept.annotations, kept.deleted)
    parts = partition_annotations(kept.annotations, kept.deleted, state)
    write_table(parts, f"{folder}/parts", fmt, partition_by=["part"])
    write_table(deleted_images(kept.annotations, kept.deleted, state=state), f"{folder}/deleted", fmt)


def write_parts_separately(parts: DataFrame, gone: DataFrame, folder: str, fmt: str = "csv") -> None:
    """Four outputs: ``dataset``, ``obsolete``, ``in_progress`` and ``deleted``.

    The parts are written once first, instead of being decided again for each output.
    """
    parts = settle(parts)
    for part in (DATASET, OBSOLETE, IN_PROGRESS):
        write_table(parts.where(F.col("part") == part).drop("part"), f"{folder}/{part}", fmt)
    write_table(gone, f"{folder}/deleted", fmt)


def write_raw(records: Records, path: str, fmt: str = "parquet") -> None:
    """Annotations and deleted rows in one table."""
    write_table(records.raw(), path, fmt)


def write_dataset_and_deleted(records: Records, folder: str, fmt: str = "parquet") -> None:
    """Unpartitioned annotations and deleted rows of selected tasks."""
    write_table(records.annotations, f"{folder}/dataset", fmt)
    write_table(records.deleted, f"{folder}/deleted", fmt)


def write_per_task(records: Records, folder: str, fmt: str = "parquet") -> None:
    """One directory per task."""
    write_table(records.annotations, folder, fmt, partition_by=["task_id"])
