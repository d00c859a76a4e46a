"""Label text files and class-name maps."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.filesystem import read_text
from boxmill.functions import base_name, stem


def read_label_lines(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """Lines of label files: ``file, stem, block, pos, line``.

    Files are read line by line and may be split; ``(block, pos)`` orders the
    lines of one file.  Files without content give no row.
    """
    lines = (
        spark.read.option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", "*.txt")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            F.col("value").alias("line"),
        )
    )
    decoded = F.try_url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    return lines.select(
        F.coalesce(decoded, F.col("file")).alias("file"),
        stem(base_name(F.coalesce(decoded, F.col("file")))).alias("stem"),
        "block", "pos", "line",
    )


def _fields(line: str) -> Column:
    # The blanks that separate fields.
    return F.split(F.btrim(F.col(line), F.lit(" \t\r\n\f\x0b")), r"\s+")


def label_lines(lines: DataFrame, on_error: str = "fail", line: str = "line") -> DataFrame:
    """Lines that describe a box: at least 5 fields.

    ``on_error="skip"`` also drops lines whose first five fields are no numbers or
    whose class is not written as a whole number.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    fields = _fields(line)
    keep = F.size(fields) >= 5
    if on_error == "skip":
        keep = keep & F.rlike(F.get(fields, F.lit(0)), F.lit(r"^[+-]?\d+$"))
        keep = keep & F.forall(F.slice(fields, 1, 5), lambda x: x.try_cast("double").isNotNull())
    return lines.where(keep)


def line_numbers(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``class_id, xc, yc, w, h, confidence``; a field that is no number fails
    the job.  The class is cut to a whole number."""
    split = lines.withColumn("_f", _fields(line))

    def number(i: int) -> Column:
        field = F.get("_f", F.lit(i))
        message = F.concat(F.lit("not a number in label line: "), F.col(line))
        wrong = F.when(field.isNotNull(), F.raise_error(message).cast("double"))
        return F.coalesce(field.try_cast("double"), wrong)

    return split.select(
        *lines.columns,
        number(0).cast("int").alias("class_id"),
        number(1).alias("xc"), number(2).alias("yc"),
        number(3).alias("w"), number(4).alias("h"),
        number(5).alias("confidence"),
    )


def parse_lines(lines: DataFrame, on_error: str = "fail", line: str = "line") -> DataFrame:
    """Box lines with their numbers; other lines are dropped."""
    return line_numbers(label_lines(lines, on_error, line), line)


def load_mapping_file(path: str) -> dict:
    """YAML (when PyYAML is there) or JSON settings file, read on the driver."""
    text = read_text(os.fspath(path))
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def class_names(spark: SparkSession, source: str | dict) -> DataFrame:
    """``class_id, name`` of a class map: ``{names: {id: name}}`` or ``{id: name}``.

    The map is a settings file; rows are in numeric order of the ids.
    """
    data = load_mapping_file(source) if isinstance(source, (str, os.PathLike)) else source
    names = data.get("names", data) if isinstance(data, dict) else {}
    if isinstance(names, list):
        names = dict(enumerate(names))
    rows = sorted((int(k), str(v)) for k, v in names.items())
    return spark.createDataFrame(rows, "class_id int, name string")


def split_folders(source: str | dict) -> dict[str, str]:
    """Image folder per split named in a dataset descriptor, in split order."""
    from boxmill.schema import SPLITS

    data = load_mapping_file(source) if isinstance(source, (str, os.PathLike)) else source
    return {s: str(data[s]) for s in SPLITS if data.get(s)}
