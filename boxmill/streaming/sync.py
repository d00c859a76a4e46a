"""Incremental copy of new objects: nothing is copied twice, nothing deleted.

What was copied is a table, the ledger: one version a run, with a row for every object that the run dealt with.  A run
lists the objects, leaves out those of earlier versions by an anti-join, copies the rest and adds its version.  The
stream's offset is the number of the version, so neither the driver nor the checkpoint remembers any object.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from boxmill import filesystem
from boxmill.filesystem import open_filesystem
from boxmill.sinks.files import copy_files
from boxmill.sources.listing import list_files

LEDGER = "name string, src string, dst string, status string, error string, batch int"


def _versions(ledger: str) -> int:
    """Number of the newest complete version of the ledger, from 1; 0 without one."""
    from pyarrow import fs

    disk, inside = open_filesystem(ledger)
    newest = 0
    for info in disk.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
        number = re.fullmatch(r"batch=(\d+)", info.base_name)
        if number and disk.get_file_info(f"{info.path}/_SUCCESS").type == fs.FileType.File:
            newest = max(newest, int(number[1]) + 1)
    return newest


class _VersionReader(DataSourceStreamReader):
    """A stream of one row a run: the number of the ledger version that the run adds."""

    def __init__(self, ledger: str):
        self.ledger = ledger

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": _versions(self.ledger) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(end["version"])]

    def read(self, partition: InputPartition):
        yield (partition.value,)

    def commit(self, end: dict) -> None:
        pass


class LedgerVersions(DataSource):
    """``spark.readStream.format("ledger_versions").option("path", ledger)``: column ``version``."""

    @classmethod
    def name(cls) -> str:
        return "ledger_versions"

    def schema(self) -> str:
        return "version long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _VersionReader(self.options["path"])


def read_ledger(spark: SparkSession, ledger: str, below: int | None = None) -> DataFrame:
    """What the runs (those numbered below ``below``) dealt with: name, src, dst, status, error, batch."""
    if not _versions(ledger):
        return spark.createDataFrame([], LEDGER)
    found = spark.read.schema(LEDGER).parquet(ledger)
    return found if below is None else found.where(F.col("batch") < below)


def new_objects(objects: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of a listing whose name no run has dealt with; those that failed are due again."""
    done = ledger.where("status in ('copied', 'existing')").select("name").distinct()
    return objects.join(done, "name", "left_anti")


def sync_once(spark: SparkSession, root: str, target: str, ledger: str, number: int) -> DataFrame:
    """Copy the objects below ``root`` that no earlier run dealt with; returns version ``number`` of the ledger."""
    due = new_objects(list_files(spark, root), read_ledger(spark, ledger, below=number))
    place = F.concat(F.lit(target.rstrip("/") + "/"), "name")
    copied = copy_files(due.select("name", F.col("path").alias("src"), place.alias("dst")))
    version = f"{ledger.rstrip('/')}/batch={number}"
    copied.write.mode("overwrite").parquet(version)
    return spark.read.parquet(version)


def start_sync(
    spark: SparkSession, root: str, target: str, checkpoint: str, report: str, once: bool = True, every: str = "1 minute"
) -> StreamingQuery:
    """Copy objects that appeared since the last run below ``target``: one run, or one ``every`` so often.

    ``report`` is the ledger.  A run that is repeated replaces its own version of it; files that are there already are
    not copied again.  An object counts by its name, however old it is.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(filesystem)
    spark.dataSource.register(LedgerVersions)
    runs = spark.readStream.format("ledger_versions").option("path", report).load()

    def copy(batch: DataFrame, number: int) -> None:
        sync_once(spark, root, target, report, number)

    writer = runs.writeStream.foreachBatch(copy).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
