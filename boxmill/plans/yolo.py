"""Pixel boxes <-> normalised label lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.functions import (
    base_name,
    exact_round,
    label_line,
    stem,
    suffix,
    to_normalised,
    to_pixels,
)
from boxmill.operators.lookup import first_found
from boxmill.operators.ordered import number_rows
from boxmill.operators.pick import first_per_key, order_key
from boxmill.operators.selection import usable_shapes
from boxmill.operators.skew import lookup_join
from boxmill.session import settle
from boxmill.sources.image_sizes import read_image_sizes, readable
from boxmill.sources.listing import search_listing, stem_candidates
from boxmill.sources.yolo_text import (
    class_names,
    label_lines,
    line_numbers,
    load_mapping_file,
    read_label_lines,
    split_folders,
)

# What converted rows carry in place of task fields.
PROVENANCE = {
    "task_id": 0, "task_name": "yolo", "task_status": "", "task_updated_date": "",
    "created_by_username": "", "subset": "", "source": "yolo",
}


def split_rank(split: Column | str = "split") -> Column:
    """0, 1, 2 for train, val, test."""
    col = F.col(split) if isinstance(split, str) else split
    return F.array_position(F.array(*[F.lit(s) for s in S.SPLITS]), col) - 1


def class_index(rows: DataFrame) -> DataFrame:
    """``instance_label, class_id``: rank of the label among the sorted labels."""
    labels = rows.where(F.col("instance_shape") == S.BOX).select("instance_label").dropna().distinct()
    numbered = number_rows(labels, ["instance_label"], "class_id", start=0)
    return numbered.select("instance_label", F.col("class_id").cast("int").alias("class_id"))


def first_sizes(boxes: DataFrame, order: list[str]) -> DataFrame:
    """Size of the first row and number of rows per (split, image)."""
    # both come from the same row; buffers of fixed width, where the order is one of whole numbers
    place = order_key(boxes, order)
    return boxes.groupBy("split", "image_name").agg(
        F.min_by("image_width", place).alias("image_width"),
        F.min_by("image_height", place).alias("image_height"),
        F.count("*").alias("n_rows"),
    )


def yolo_lines(
    rows: DataFrame, classes: DataFrame, order: list[str], sizes: str = "first"
) -> DataFrame:
    """``split, image_name, stem, order..., line`` for every box row.

    All lines of an image use the size of its first row (``sizes="first"``); give
    ``sizes="row"`` when rows of an image are known to agree, which saves a join.
    """
    boxes = usable_shapes(rows).where(F.col("instance_shape") == S.BOX)
    if sizes == "first":
        fixed = first_sizes(boxes, order)
        boxes = lookup_join(
            boxes.drop("image_width", "image_height"), fixed, ["split", "image_name"], "inner", weight="n_rows"
        )
    joined = boxes.join(classes, "instance_label", "left")
    index = F.when(
        F.col("class_id").isNull(),
        F.raise_error(F.concat(F.lit("box without a class: "), F.col("image_name"))).cast("int"),
    ).otherwise(F.col("class_id"))
    numbers = to_normalised(
        "bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br", "image_width", "image_height"
    )
    return joined.select(
        "split", "image_name", stem("image_name").alias("stem"), *order,
        label_line(index, *numbers).alias("line"),
    )


def unlabelled_images(rows: DataFrame) -> DataFrame:
    """``split, image_name, stem`` of images that get an empty label file."""
    none = rows.where(F.col("instance_shape") == S.NONE).select("split", "image_name").distinct()
    boxed = rows.where(F.col("instance_shape") == S.BOX).select("split", "image_name").distinct()
    return none.join(boxed, ["split", "image_name"], "left_anti").select(
        "split", "image_name", stem("image_name").alias("stem")
    )


def stem_collisions(rows: DataFrame) -> DataFrame:
    """Label files that two images of one split would share."""
    images = usable_shapes(rows).select("split", "image_name").distinct()
    return (
        images.groupBy("split", stem("image_name").alias("stem"))
        .agg(F.count("*").alias("images"))
        .where("images > 1")
    )


def present_splits(rows: DataFrame) -> DataFrame:
    """Splits in use, in the order train, val, test, then others by name."""
    rank = split_rank()
    return rows.select("split").distinct().orderBy(F.when(rank < 0, 99).otherwise(rank), "split")


def _constants() -> list[Column]:
    return [
        F.lit(v).cast(S.ANNOTATION[k].dataType).alias(k) for k, v in PROVENANCE.items()
    ]


def boxes_from_lines(
    images: DataFrame, lines: DataFrame, classes: DataFrame | None, on: list[str], order: list[str]
) -> DataFrame:
    """Label lines joined with their images -> box rows of the dataset table.

    ``images`` has ``on``, ``image_name, image_width, image_height, frame_id`` and
    ``split``; ``lines`` has ``on``, ``line`` and ``order``, which sorts the lines
    of one image.  Boxes are numbered from 1 over images and lines.
    """
    narrow = lines.select(*dict.fromkeys([*on, *order, "line"]))
    kept = ["image_name", "image_width", "image_height", "frame_id", "split", *order, "line"]
    joined = narrow.join(images, on).select(*dict.fromkeys(kept))
    # numbering reads its input twice, so the numbers are taken out of the text after it
    numbered = line_numbers(number_rows(joined, ["frame_id", *order], "annotation_id", start=1))
    if classes is None:
        named = numbered.withColumn("name", F.lit(None).cast("string"))
    else:
        named = numbered.join(classes.select("class_id", "name"), "class_id", "left")
    x0, y0, x1, y1 = to_pixels("xc", "yc", "w", "h", "image_width", "image_height")
    label = F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    return S.conform(
        named.select(
            "image_name", "image_width", "image_height", "frame_id", "split", "annotation_id",
            F.lit(S.BOX).alias("instance_shape"),
            label.alias("instance_label"),
            exact_round(x0).alias("bbox_x_tl"), exact_round(y0).alias("bbox_y_tl"),
            exact_round(x1).alias("bbox_x_br"), exact_round(y1).alias("bbox_y_br"),
            *_constants(),
            F.lit(False).alias("occluded"), F.lit(0).alias("z_order"), F.lit(0.0).alias("rotation"),
            "confidence",
        )
    )


def none_rows(images: DataFrame) -> DataFrame:
    """Dataset rows of images without boxes; box fields stay NULL."""
    return S.conform(
        images.select(
            "image_name", "image_width", "image_height", "frame_id", "split",
            F.lit(S.NONE).alias("instance_shape"), *_constants(),
        )
    )


def number_images(images: DataFrame, order: list[Column | str]) -> DataFrame:
    """Running image number from 0."""
    numbered = number_rows(images, order, "frame_id", start=0)
    return numbered.withColumn("frame_id", F.col("frame_id").cast("int"))


def dataset_from_tables(
    images: DataFrame, lines: DataFrame, classes: DataFrame | None, order: list[str]
) -> DataFrame:
    """Images and box lines keyed by (split, stem) -> dataset rows.

    Images are numbered by split and name; those without a line become none rows.
    """
    numbered = number_images(images, [split_rank(), "image_name"])
    keys = lines.select("split", "stem").distinct()
    empty = numbered.join(keys, ["split", "stem"], "left_anti")
    boxes = boxes_from_lines(numbered, lines, classes, ["split", "stem"], order)
    return boxes.unionByName(none_rows(empty))


def from_yolo_dataset(
    spark: SparkSession, folder: str, sizes: str = "each", on_error: str = "fail"
) -> DataFrame:
    """Dataset folder with ``dataset.yaml`` -> dataset rows."""
    settings = load_mapping_file(f"{folder.rstrip('/')}/dataset.yaml")
    if not settings.get("names"):
        raise ValueError(f"no class names in {folder}/dataset.yaml")
    classes = class_names(spark, {"names": settings["names"]})
    images = lines = None
    for split, sub in split_folders(settings).items():
        where = f"{folder.rstrip('/')}/{sub}"
        try:
            found = readable(settle(read_image_sizes(spark, where, sizes)))
        except FileNotFoundError:  # a split folder may be absent
            continue
        direct = found.where(
            (F.instr("name", "/") == 0) & F.lower(suffix("name")).isin(*S.IMAGE_EXTENSIONS)
        ).select(
            F.lit(split).alias("split"), stem("name").alias("stem"), F.col("name").alias("image_name"),
            "image_width", "image_height",
        )
        images = direct if images is None else images.unionByName(direct)
        labels = f"{folder.rstrip('/')}/{sub.replace('images', 'labels')}"
        try:
            text = read_label_lines(spark, labels, recursive=False)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        part = label_lines(text, on_error).withColumn("split", F.lit(split))
        lines = part if lines is None else lines.unionByName(part)
    if images is None:
        return spark.createDataFrame([], S.ANNOTATION)
    # many small files: read each once, go on from two compact tables
    images = settle(images)
    lines = None if lines is None else settle(lines)
    if lines is None:
        return none_rows(number_images(images, [split_rank(), "image_name"]))
    return dataset_from_tables(images, lines, classes, ["block", "pos"])


def predictions_from_tables(
    files: DataFrame, lines: DataFrame, images: DataFrame, classes: DataFrame | None, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(dataset rows, label files whose image is missing).

    ``files`` is ``file, stem``; only files with a line count.  Files are numbered
    in path order, compared component by component.
    """
    used = files.join(lines.select("file").distinct(), "file", "left_semi")
    placed = used.join(images, "stem", "left")
    missing = placed.where(F.col("image_name").isNull()).select("file", "stem")
    numbered = number_images(
        placed.where(F.col("image_name").isNotNull()), [F.split("file", "/")]
    ).withColumn("split", F.lit(None).cast("string"))
    return boxes_from_lines(numbered, lines, classes, ["file"], order), missing


def from_yolo_predictions(
    spark: SparkSession,
    folder: str,
    names: str | dict | None = None,
    image_folders: list[str] | None = None,
    sizes: str = "each",
    on_error: str = "fail",
) -> tuple[DataFrame, DataFrame]:
    """Prediction files -> (dataset rows, files without an image)."""
    folders = [folder, *(image_folders or [])]
    # many small files: read each once, go on from two compact tables
    lines = settle(label_lines(read_label_lines(spark, folder), on_error))
    listing = search_listing(spark, folders)
    chosen = first_found(stem_candidates(listing), ["dir_rank", "sub_rank", "ext_rank"], by="stem")
    measured = None
    for one in folders:
        part = readable(read_image_sizes(spark, one, sizes)).select("path", "image_width", "image_height")
        measured = part if measured is None else measured.unionByName(part)
    measured = first_per_key(measured, ["path"], ["image_width", "image_height"])
    images = settle(
        chosen.join(measured, "path").select(
            "stem", base_name("path").alias("image_name"), "image_width", "image_height"
        )
    )
    files = lines.select("file", "stem").distinct()
    classes = class_names(spark, names) if names is not None else None
    return predictions_from_tables(files, lines, images, classes, ["block", "pos"])


def shapes_from_lines(
    lines: DataFrame, images: DataFrame, classes: DataFrame, labels: DataFrame
) -> DataFrame:
    """Parsed lines -> shapes for an upload: class number -> name -> label id.

    A class number outside the class list is dropped.
    """
    x0, y0, x1, y1 = to_pixels("xc", "yc", "w", "h", "image_width", "image_height")
    return (
        lines.join(images, ["split", "stem"])
        .join(classes, "class_id")
        .join(labels.select("label_id", F.col("label_name").alias("name")), "name")
        .select("frame_id", "label_id", F.array(x0, y0, x1, y1).alias("points"))
    )
