"""Table layouts shared by every reader, operator and writer.

``ANNOTATION`` is the flat dataset table: one row per box, one row per image
without boxes and one row per deleted image, told apart by ``instance_shape``.
Inside the engine ``attributes`` is a map; it becomes JSON text only in files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The dataset column order and the words stored in the columns.
BOX = "box"
NONE = "none"
DELETED = "deleted"
RECTANGLE = "rectangle"
COMPLETED = "completed"
UNKNOWN = "<unknown>"
NO_ANNOTATION = "__no_annotation__"
SPLITS = ("train", "val", "test")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")

ATTRIBUTE_MAP = T.MapType(T.StringType(), T.StringType())

ANNOTATION = (
    T.StructType()
    .add("image_name", T.StringType())
    .add("image_width", T.IntegerType())
    .add("image_height", T.IntegerType())
    .add("instance_shape", T.StringType())
    .add("instance_label", T.StringType())
    .add("bbox_x_tl", T.DoubleType())
    .add("bbox_y_tl", T.DoubleType())
    .add("bbox_x_br", T.DoubleType())
    .add("bbox_y_br", T.DoubleType())
    .add("task_id", T.LongType())
    .add("task_name", T.StringType())
    .add("task_status", T.StringType())
    .add("task_updated_date", T.StringType())
    .add("created_by_username", T.StringType())
    .add("frame_id", T.IntegerType())
    .add("split", T.StringType())
    .add("subset", T.StringType())
    .add("occluded", T.BooleanType())
    .add("z_order", T.IntegerType())
    .add("rotation", T.DoubleType())
    .add("source", T.StringType())
    .add("annotation_id", T.LongType())
    .add("confidence", T.DoubleType())
    .add("s3_path", T.StringType())
    .add("image_path", T.StringType())
    .add("attributes", ATTRIBUTE_MAP)
)
COLUMNS = tuple(ANNOTATION.fieldNames())

ATTRIBUTE_VALUES = T.ArrayType(
    T.StructType().add("spec_id", T.LongType()).add("value", T.StringType())
)

# Flat snapshot tables (what ``sources.documents`` unnests into).
TASKS = (
    T.StructType()
    .add("task_id", T.LongType())
    .add("task_name", T.StringType())
    .add("task_status", T.StringType())
    .add("subset", T.StringType())
    .add("task_updated_date", T.StringType())
)
FRAMES = (
    T.StructType()
    .add("task_id", T.LongType())
    .add("frame_id", T.IntegerType())
    .add("name", T.StringType())
    .add("width", T.IntegerType())
    .add("height", T.IntegerType())
)
DELETED_FRAMES = (
    T.StructType()
    .add("task_id", T.LongType())
    .add("frame_id", T.IntegerType())
    .add("ord", T.LongType())
)
SHAPES = (
    T.StructType()
    .add("task_id", T.LongType())
    .add("ord", T.LongType())
    .add("id", T.LongType())
    .add("type", T.StringType())
    .add("frame_id", T.IntegerType())
    .add("label_id", T.LongType())
    .add("points", T.ArrayType(T.DoubleType()))
    .add("occluded", T.BooleanType())
    .add("z_order", T.IntegerType())
    .add("rotation", T.DoubleType())
    .add("source", T.StringType())
    .add("attributes", ATTRIBUTE_VALUES)
    .add("created_by", T.StringType())
)
LABELS = (
    T.StructType()
    .add("label_id", T.LongType())
    .add("label_name", T.StringType())
    .add("color", T.StringType())
    .add(
        "attributes",
        T.ArrayType(T.StructType().add("id", T.LongType()).add("name", T.StringType())),
    )
)
IGNORED = (
    T.StructType()
    .add("project", T.StringType())
    .add("id", T.LongType())
    .add("name", T.StringType())
    .add("description", T.StringType())
    .add("silent", T.BooleanType())
)

# Nested documents.  ``created_by``/``owner`` are read as text: a plain user name
# stays as is, a user object arrives as its JSON text (see functions.coercion).
_SHAPE = (
    T.StructType()
    .add("id", T.LongType())
    .add("type", T.StringType())
    .add("frame", T.IntegerType())
    .add("label_id", T.LongType())
    .add("points", T.ArrayType(T.DoubleType()))
    .add("occluded", T.BooleanType())
    .add("outside", T.BooleanType())
    .add("z_order", T.IntegerType())
    .add("rotation", T.DoubleType())
    .add("source", T.StringType())
    .add("attributes", ATTRIBUTE_VALUES)
    .add("created_by", T.StringType())
    .add("owner", T.StringType())
)
_TRACK = (
    T.StructType()
    .add("id", T.LongType())
    .add("frame", T.IntegerType())
    .add("label_id", T.LongType())
    .add("source", T.StringType())
    .add("attributes", ATTRIBUTE_VALUES)
    .add("shapes", T.ArrayType(_SHAPE))
    .add("created_by", T.StringType())
)
DOCUMENT = (
    T.StructType()
    .add(
        "task",
        T.StructType()
        .add("id", T.LongType())
        .add("name", T.StringType())
        .add("status", T.StringType())
        .add("subset", T.StringType())
        .add("updated_date", T.StringType())
        .add("updated_at", T.StringType()),
    )
    .add(
        "data_meta",
        T.StructType()
        .add(
            "frames",
            T.ArrayType(
                T.StructType()
                .add("id", T.IntegerType())
                .add("name", T.StringType())
                .add("width", T.IntegerType())
                .add("height", T.IntegerType())
            ),
        )
        .add("deleted_frames", T.ArrayType(T.IntegerType())),
    )
    .add(
        "annotations",
        T.StructType()
        .add("shapes", T.ArrayType(_SHAPE))
        .add("tracks", T.ArrayType(_TRACK)),
    )
)
PROJECT = (
    T.StructType()
    .add("id", T.LongType())
    .add("name", T.StringType())
    .add(
        "labels",
        T.ArrayType(
            T.StructType()
            .add("id", T.LongType())
            .add("name", T.StringType())
            .add("color", T.StringType())
            .add(
                "attributes",
                T.ArrayType(
                    T.StructType().add("id", T.LongType()).add("name", T.StringType())
                ),
            )
        ),
    )
)


def empty_attributes() -> Column:
    return F.create_map().cast(ATTRIBUTE_MAP)


def conform(df: DataFrame, layout: T.StructType = ANNOTATION) -> DataFrame:
    """Select exactly ``layout``: missing columns become NULL (``attributes`` an
    empty map), extra ones are dropped, types are cast."""
    have = set(df.columns)

    def column(field: T.StructField) -> Column:
        if field.name not in have:
            if field.dataType == ATTRIBUTE_MAP:
                return empty_attributes().alias(field.name)
            return F.lit(None).cast(field.dataType).alias(field.name)
        col = F.col(field.name).cast(field.dataType)
        if field.dataType == ATTRIBUTE_MAP:
            col = F.coalesce(col, empty_attributes())
        return col.alias(field.name)

    return df.select(*[column(f) for f in layout.fields])


def widen(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become NULL there."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def require(df: DataFrame, columns, what: str = "dataset") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")
    return df
