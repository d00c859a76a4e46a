"""Conversion to and from normalised label lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.adapters import Tables
from boxmill.functions import base_name, exact_round
from boxmill.operators import selection as P
from boxmill.operators.lookup import first_found
from boxmill.operators.ordered import number_within
from boxmill.plans import yolo as Y
from boxmill.registry import query
from boxmill.sources.listing import stem_candidates
from boxmill.session import settle
from boxmill.sources.yolo_text import label_lines, parse_lines

_ORDER = ["task_id", "frame_id"]


@query("SELECT instance_label, class_id FROM a_classes")
def class_index(t: Tables) -> DataFrame:
    return Y.class_index(t.boxes)


def _lines(t: Tables) -> DataFrame:
    return Y.yolo_lines(t.yolo_rows, Y.class_index(t.boxes), _ORDER)


@query("SELECT split, image_name, stem, task_id, frame_id, line FROM a_lines")
def yolo_lines(t: Tables) -> DataFrame:
    return _lines(t)


@query("""SELECT split, stem, line, row_number() OVER (PARTITION BY split, stem ORDER BY task_id, frame_id, line) AS line_no
  FROM a_lines""")
def yolo_line_numbers(t: Tables) -> DataFrame:
    """Place of every line in its label file."""
    numbered = number_within(_lines(t), ["split", "stem"], [*_ORDER, "line"], "line_no")
    return numbered.select("split", "stem", "line", "line_no")


@query("""SELECT split, image_name, replace(image_name, '.jpg', '') AS stem FROM a_yolo GROUP BY split, image_name
  HAVING count(*) FILTER (WHERE instance_shape = 'box') = 0""")
def yolo_empty_files(t: Tables) -> DataFrame:
    return Y.unlabelled_images(t.yolo_rows)


_ROUND_TRIP = """WITH img AS (SELECT split, image_name, image_width, image_height,
    row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, image_name) - 1 AS frame_id
    FROM (SELECT split, image_name, image_width, image_height, row_number() OVER (
      PARTITION BY split, image_name ORDER BY CASE instance_shape WHEN 'box' THEN 0 ELSE 1 END, task_id, frame_id) AS rn FROM a_yolo) q WHERE rn = 1),
  lin AS (SELECT l.split, l.image_name, l.task_id AS src_task, l.frame_id AS src_frame, l.line,
    CAST(string_split(l.line, ' ')[1] AS INT) AS cid, CAST(string_split(l.line, ' ')[2] AS DOUBLE) AS xc,
    CAST(string_split(l.line, ' ')[3] AS DOUBLE) AS yc, CAST(string_split(l.line, ' ')[4] AS DOUBLE) AS w,
    CAST(string_split(l.line, ' ')[5] AS DOUBLE) AS h FROM a_lines l)"""


@query(_ROUND_TRIP + """
  SELECT i.image_name, i.image_width, i.image_height, 'box' AS instance_shape, c.instance_label,
  CAST(printf('%.2f', (n.xc - n.w / 2.0) * i.image_width) AS DOUBLE) AS bbox_x_tl,
  CAST(printf('%.2f', (n.yc - n.h / 2.0) * i.image_height) AS DOUBLE) AS bbox_y_tl,
  CAST(printf('%.2f', (n.xc + n.w / 2.0) * i.image_width) AS DOUBLE) AS bbox_x_br,
  CAST(printf('%.2f', (n.yc + n.h / 2.0) * i.image_height) AS DOUBLE) AS bbox_y_br,
  CAST(0 AS BIGINT) AS task_id, 'yolo' AS task_name, CAST(i.frame_id AS INT) AS frame_id, i.split, 'yolo' AS source,
  row_number() OVER (ORDER BY i.frame_id, n.src_task, n.src_frame, n.line) AS annotation_id
  FROM lin n JOIN img i ON i.split = n.split AND i.image_name = n.image_name JOIN a_classes c ON c.class_id = n.cid
  UNION ALL SELECT i.image_name, i.image_width, i.image_height, 'none', NULL, NULL, NULL, NULL, NULL, 0, 'yolo',
  CAST(i.frame_id AS INT), i.split, 'yolo', NULL FROM img i
  WHERE NOT EXISTS (SELECT 1 FROM lin n WHERE n.split = i.split AND n.image_name = i.image_name)""")
def yolo_roundtrip(t: Tables) -> DataFrame:
    """Dataset -> label lines -> dataset, with image and box numbers."""
    rows = t.yolo_rows
    classes = Y.class_index(t.boxes)
    lines = Y.yolo_lines(rows, classes, _ORDER).select(
        "split", "stem", F.col("task_id").alias("src_task"), F.col("frame_id").alias("src_frame"), "line"
    )
    # written once, as the label files would be
    written = label_lines(settle(lines))
    shape_rank = F.when(F.col("instance_shape") == "box", 0).otherwise(1).cast("tinyint")
    images = Y.first_sizes(rows.withColumn("rank", shape_rank), ["rank", *_ORDER])
    images = images.drop("n_rows").withColumn("stem", Y.stem("image_name"))
    names = classes.select("class_id", F.col("instance_label").alias("name"))
    out = Y.dataset_from_tables(images, written, names, ["src_task", "src_frame", "line"])
    return out.select(
        "image_name", "image_width", "image_height", "instance_shape", "instance_label",
        "bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br", "task_id", "task_name", "frame_id", "split", "source",
        "annotation_id",
    )


@query("""SELECT stem, CAST(f[1] AS INT) AS class_id, CAST(f[2] AS DOUBLE) AS xc, CAST(f[3] AS DOUBLE) AS yc,
  CAST(f[4] AS DOUBLE) AS w, CAST(f[5] AS DOUBLE) AS h, CAST(f[6] AS DOUBLE) AS confidence
  FROM (SELECT stem, string_split_regex(trim(line), '\\s+') AS f FROM a_text) q WHERE len(f) >= 5""")
def label_text(t: Tables) -> DataFrame:
    return parse_lines(t.text_lines).drop("line")


@query("""SELECT coalesce(l.label_name, concat('class_', CAST(q.cid AS VARCHAR))) AS instance_label, q.confidence,
  CAST(printf('%.2f', (q.xc - q.w / 2.0) * 1920) AS DOUBLE) AS bbox_x_tl, CAST(printf('%.2f', (q.yc - q.h / 2.0) * 1080) AS DOUBLE) AS bbox_y_tl,
  CAST(printf('%.2f', (q.xc + q.w / 2.0) * 1920) AS DOUBLE) AS bbox_x_br, CAST(printf('%.2f', (q.yc + q.h / 2.0) * 1080) AS DOUBLE) AS bbox_y_br
  FROM (SELECT CAST(f[1] AS INT) AS cid, CAST(f[2] AS DOUBLE) AS xc, CAST(f[3] AS DOUBLE) AS yc,
   CAST(f[4] AS DOUBLE) AS w, CAST(f[5] AS DOUBLE) AS h, CAST(f[6] AS DOUBLE) AS confidence
   FROM (SELECT string_split_regex(trim(line), '\\s+') AS f FROM a_text) p WHERE len(f) >= 5) q
  LEFT JOIN a_labels l ON l.label_id = q.cid""")
def label_text_boxes(t: Tables) -> DataFrame:
    """Pixel boxes of the label lines; classes without a name become ``class_<id>``."""
    parsed = parse_lines(t.text_lines)
    names = t.labels.select(F.col("label_id").cast("int").alias("class_id"), F.col("label_name").alias("name"))
    x0, y0, x1, y1 = Y.to_pixels("xc", "yc", "w", "h", F.lit(1920), F.lit(1080))
    return parsed.join(names, "class_id", "left").select(
        F.coalesce("name", F.concat(F.lit("class_"), F.col("class_id").cast("string"))).alias("instance_label"),
        "confidence",
        exact_round(x0).alias("bbox_x_tl"), exact_round(y0).alias("bbox_y_tl"),
        exact_round(x1).alias("bbox_x_br"), exact_round(y1).alias("bbox_y_br"),
    )


@query("""SELECT r.image_name, CAST(r.frame_id AS INT) AS frame_id, r.instance_label, r.annotation_id FROM (
  SELECT concat(o.stem, '.png') AS image_name, dense_rank() OVER (ORDER BY o.stem) - 1 AS frame_id,
  concat('class_', CAST(CAST(o.f[1] AS INT) AS VARCHAR)) AS instance_label,
  row_number() OVER (ORDER BY o.stem, o.line) AS annotation_id FROM (
   SELECT x.stem, x.line, string_split_regex(trim(x.line), '\\s+') AS f FROM a_text x JOIN (
     SELECT concat('f', CAST(o_orderkey AS VARCHAR)) AS stem FROM orders WHERE o_orderstatus = 'F') k ON k.stem = x.stem) o
  WHERE len(o.f) >= 5) r""")
def prediction_boxes(t: Tables) -> DataFrame:
    """Prediction files -> boxes: files are numbered in path order, boxes throughout;
    only finished orders have an image."""
    lines = label_lines(t.text_lines.withColumn("file", F.concat(F.lit("/p/"), "stem", F.lit(".txt"))))
    images = t.tasks.where(F.col("task_status") == "completed").select(
        F.concat(F.lit("f"), F.col("task_id").cast("string")).alias("stem")
    ).withColumn("image_name", F.concat("stem", F.lit(".png")))
    images = images.withColumn("image_width", F.lit(1920)).withColumn("image_height", F.lit(1080))
    files = lines.select("file", "stem").distinct()
    rows, _ = Y.predictions_from_tables(files, lines, images, None, ["line"])
    return rows.select("image_name", "frame_id", "instance_label", "annotation_id")


@query("""SELECT stem, path FROM (SELECT stem, path, row_number() OVER (
  PARTITION BY stem ORDER BY dir_rank, sub_rank, ext_rank) AS rn FROM a_candidates) q WHERE rn = 1""")
def stem_lookup(t: Tables) -> DataFrame:
    return first_found(stem_candidates(t.candidates), ["dir_rank", "sub_rank", "ext_rank"], by="stem")


@query("""SELECT split, image_name, CAST(row_number() OVER (
  ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, image_name) - 1 AS INT) AS frame_id
  FROM (SELECT DISTINCT split, image_name FROM a_yolo) d""")
def number_frames(t: Tables) -> DataFrame:
    images = t.yolo_rows.select("split", "image_name").distinct()
    return Y.number_images(images, [Y.split_rank(), "image_name"])


@query("SELECT DISTINCT image_name FROM a_old WHERE split IS NULL")
def images_without_split(t: Tables) -> DataFrame:
    return P.images_without_split(t.old_version)


@query("""SELECT split, stem, count(*) AS images FROM (SELECT DISTINCT CASE dir_rank WHEN 0 THEN 'train' ELSE 'val' END AS split, stem,
  regexp_replace(path, '^.*/', '') AS image_name FROM a_candidates) d GROUP BY 1, 2 HAVING count(*) > 1""")
def stem_collisions(t: Tables) -> DataFrame:
    rows = t.candidates.select(
        F.when(F.col("dir_rank") == 0, "train").otherwise("val").alias("split"),
        base_name("name").alias("image_name"),
        F.lit("box").alias("instance_shape"),
    )
    return Y.stem_collisions(rows)


@query("""SELECT q.frame_id, l.label_id, (q.xc - q.w / 2.0) * 640 AS x_tl, (q.yc + q.h / 2.0) * 480 AS y_br
  FROM (SELECT CAST(substr(stem, 2) AS BIGINT) AS frame_id, CAST(f[1] AS INT) AS cid, CAST(f[2] AS DOUBLE) AS xc,
   CAST(f[3] AS DOUBLE) AS yc, CAST(f[4] AS DOUBLE) AS w, CAST(f[5] AS DOUBLE) AS h FROM (
   SELECT stem, string_split_regex(trim(line), '\\s+') AS f FROM a_text) p WHERE len(f) >= 5) q
  JOIN orders o ON o.o_orderkey = q.frame_id
  JOIN (SELECT label_id, label_name, row_number() OVER (ORDER BY label_name) - 1 AS cid FROM a_labels) l ON l.cid = q.cid""")
def upload_line_shapes(t: Tables) -> DataFrame:
    """Label lines -> shapes of a task; class numbers past the class list drop out."""
    lines = parse_lines(t.text_lines).withColumn("split", F.lit("train"))
    images = t.tasks.select(
        F.lit("train").alias("split"), F.concat(F.lit("f"), F.col("task_id").cast("string")).alias("stem"),
        F.col("task_id").alias("frame_id"), F.lit(640).alias("image_width"), F.lit(480).alias("image_height"),
    )
    classes = Y.number_rows(t.labels.select(F.col("label_name").alias("name")), ["name"], "class_id", start=0)
    shapes = Y.shapes_from_lines(lines, images, classes, t.labels)
    return shapes.select(
        "frame_id", "label_id", F.get("points", F.lit(0)).alias("x_tl"), F.get("points", F.lit(3)).alias("y_br")
    )
