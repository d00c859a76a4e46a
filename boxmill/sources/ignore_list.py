"""Ignore list: tasks to leave out, per project (a small settings table)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.sources.yolo_text import load_mapping_file


def _field(name: str) -> Column:
    return F.get_json_object("entry", f"$.{name}")


def ignore_list(spark: SparkSession, source: str | dict) -> DataFrame:
    """``project, id, name, description, silent``.

    An entry is an object or a bare id.  Every entry becomes a row of JSON text, and its columns are cast out
    of it; a row whose id is no whole number is left out.
    """
    settings = load_mapping_file(source) if isinstance(source, str) else source
    projects = settings.get("ignore", settings) if isinstance(settings, dict) else None
    listed = [
        (str(project), json.dumps(entry))
        for project, entries in (projects or {}).items()
        for entry in (entries if isinstance(entries, list) else ())
    ]
    rows = spark.createDataFrame(listed, "project string, entry string")
    is_object = F.startswith("entry", F.lit("{"))
    number = F.when(is_object, _field("id")).otherwise(F.btrim("entry", F.lit('"')))
    silent = F.coalesce(_field("silent"), F.lit("")).isin("", "0", "false", "null")
    return rows.select(
        "project",
        F.trim(number).try_cast("bigint").alias("id"),
        F.coalesce(_field("name"), F.lit("")).alias("name"),
        F.coalesce(_field("description"), F.lit("")).alias("description"),
        (is_object & ~silent).alias("silent"),
    ).where("id is not null").to(S.IGNORED)
