"""Dataset tables and name lists in CSV or text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmill import schema as S
from boxmill.sources.csv_cut import PACKED, read_cut_csv

MERGE_COLUMNS = (
    "image_name", "instance_shape", "instance_label",
    "bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br",
)
UPLOAD_COLUMNS = ("image_name", "instance_label")
YOLO_COLUMNS = ("image_name", "instance_shape", "split")
TIME_COLUMN = "task_updated_date"


# fixed value: the white space that is cut off names in a plain list
_BLANKS = " \t\r\n\f\x0b"


def _breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line of the files has an odd number of quotes, as a quoted line break leaves it."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _raw_csv(spark: SparkSession, path: str | list[str], splittable: bool | None = None) -> DataFrame:
    """Text columns of CSV files, found by name.

    Several paths may have their columns in any order, or lack some; the files below one path must have the
    same header, and any other header is an error when the rows are read.
    """
    out = None
    for one in [path] if isinstance(path, str) else path:
        whole = _breaks_lines(spark, one) if splittable is None else not splittable
        reader = spark.read.option("header", True).option("enforceSchema", False)
        part = reader.option("quote", '"').option("escape", '"').option("multiLine", whole).csv(one)
        if whole and not any(f.endswith(PACKED) for f in part.inputFiles()):
            part = read_cut_csv(spark, one, part.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_dataset_csv(
    spark: SparkSession,
    path: str | list[str],
    required=(),
    require_time: bool = False,
    splittable: bool | None = None,
) -> DataFrame:
    """Dataset CSV with columns found by name and cast to the dataset types.

    Nothing is inferred: ``007`` stays text and only an empty field is NULL.
    Numbers are read through DOUBLE because integer columns with gaps are often
    stored as ``3.0``.  Big files are cut at line ends.  Where a quoted field holds a line break, for which the
    text is looked through first (``splittable`` says so beforehand), they are cut into blocks whose quotes are
    counted; only packed files are then read by one task each.
    """
    raw = _raw_csv(spark, path, splittable)
    S.require(raw, required, str(path))
    if require_time:
        S.require(raw, (TIME_COLUMN,), str(path))

    def typed(name: str):
        col = F.col(f"`{name}`")
        if name not in S.COLUMNS:
            return col
        kind = S.ANNOTATION[name].dataType
        if kind == S.ATTRIBUTE_MAP:
            return F.coalesce(F.from_json(col, kind), S.empty_attributes()).alias(name)
        if isinstance(kind, (T.IntegerType, T.LongType)):
            whole = F.coalesce(col.try_cast(kind), col.try_cast("double").try_cast(kind))
            return whole.alias(name)
        return col.try_cast(kind).alias(name)

    return raw.select(*[typed(c) for c in raw.columns])


def read_deletion_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct image names of a deletion list: a CSV with an ``image_name``
    column, else plain text with one name per line."""
    raw = _raw_csv(spark, path)
    if "image_name" in raw.columns:
        names = raw.select("image_name")
    else:
        names = spark.read.text(path).select(F.btrim("value", F.lit(_BLANKS)).alias("image_name"))
    return names.where(F.coalesce(F.col("image_name"), F.lit("")) != "").distinct()


def read_exclusion_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct image names of an in-progress CSV; empty without the column."""
    raw = _raw_csv(spark, path)
    if "image_name" not in raw.columns:
        return spark.createDataFrame([], "image_name string")
    return raw.select("image_name").dropna().distinct()
