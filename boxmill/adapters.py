"""Annotation-shaped views of the driver tables.

The driver tables hold no annotations, so orders become tasks, order lines become
frames and shapes, brands become labels, and so on.  ``VIEWS`` states the same in
SQL for the check; the DataFrame side below is what the queries read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.plans.extract import Records, Snapshot, extract_records
from boxmill.session import settle


class Tables:
    """The driver tables of one folder and the views made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def tasks(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", S.COMPLETED)
            .when(F.col("o_orderstatus") == "O", "annotation")
            .otherwise("validation")
        )
        return self.raw("orders").select(
            F.col("o_orderkey").alias("task_id"),
            F.concat(F.lit("task-"), F.col("o_orderkey").cast("string")).alias("task_name"),
            status.alias("task_status"),
            F.col("o_orderpriority").alias("subset"),
            F.col("o_orderdate").cast("string").alias("task_updated_date"),
            F.col("o_custkey").alias("project_id"),
        )

    @cached_property
    def labels(self) -> DataFrame:
        return self.raw("part").select(
            F.substring("p_brand", 7, 10).cast("long").alias("label_id"),
            F.col("p_brand").alias("label_name"),
        ).distinct()

    @cached_property
    def frames(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(
                F.col("l_orderkey").alias("task_id"),
                (F.col("l_linenumber") - 1).cast("int").alias("frame_id"),
            )
            .agg(F.min("l_partkey").alias("part"))
            .select(
                "task_id", "frame_id",
                F.concat(F.lit("img_"), F.col("part").cast("string"), F.lit(".jpg")).alias("name"),
                F.lit(640).alias("width"), F.lit(480).alias("height"),
            )
        )

    @cached_property
    def deleted_frames(self) -> DataFrame:
        gone = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
        frame = (F.col("l_linenumber") - 1).cast("int")
        found = self.raw("lineitem").where(gone).select(F.col("l_orderkey").alias("task_id"), frame.alias("frame_id")).distinct()
        return found.select("task_id", "frame_id", F.col("frame_id").cast("long").alias("ord"))

    @cached_property
    def shapes(self) -> DataFrame:
        qty, price = F.col("l_quantity"), F.col("l_extendedprice")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("task_id"),
            (F.col("l_linenumber") - 1).cast("int").alias("frame_id"),
            F.when(F.col("l_tax") > 0.01, S.RECTANGLE).otherwise("polygon").alias("type"),
            (F.col("l_suppkey") % 30).alias("label_id"),
            F.array(qty * 2, qty, qty * 2 + price / 1000, qty + price / 2000).alias("points"),
        )

    @cached_property
    def shapes_with_attributes(self) -> DataFrame:
        """Shapes whose order-line flags are attribute values 1, 2 and 9."""
        extra = self.raw("lineitem").select(
            F.col("l_orderkey").alias("task_id"),
            (F.col("l_linenumber") - 1).cast("int").alias("frame_id"),
            F.when(F.col("l_tax") > 0.01, S.RECTANGLE).otherwise("polygon").alias("type"),
            (F.col("l_suppkey") % 30).alias("label_id"),
            F.array(*[F.lit(float(i)) for i in range(4)]).alias("points"),
            F.array(
                F.struct(F.lit(1).cast("long").alias("spec_id"), F.col("l_returnflag").alias("value")),
                F.struct(F.lit(2).cast("long").alias("spec_id"), F.col("l_linestatus").alias("value")),
                F.struct(F.lit(9).cast("long").alias("spec_id"), F.col("l_partkey").cast("string").alias("value")),
            ).alias("attributes"),
        )
        return extra

    @cached_property
    def labels_with_attributes(self) -> DataFrame:
        specs = F.array(
            F.struct(F.lit(1).cast("long").alias("id"), F.lit("flag").alias("name")),
            F.struct(F.lit(2).cast("long").alias("id"), F.lit("status").alias("name")),
        )
        return self.labels.withColumn("attributes", specs)

    @cached_property
    def snapshot(self) -> Snapshot:
        return Snapshot(self.tasks, self.frames, self.deleted_frames, self.shapes, self.labels)

    @cached_property
    def records(self) -> Records:
        return extract_records(self.snapshot)

    @cached_property
    def dataset(self) -> DataFrame:
        """The annotation table as a fetch leaves it: written once, then read."""
        return settle(
            self.records.annotations.select(
                "image_name", "image_width", "image_height", "instance_shape", "instance_label",
                "bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br",
                "task_id", "task_status", "task_updated_date", "frame_id", "subset",
            )
        )

    @cached_property
    def history(self) -> DataFrame:
        """The annotation columns that partition needs, written once as the dataset is."""
        needed = ["image_name", "task_id", "frame_id", "task_status", "task_updated_date"]
        if "dataset" in self.__dict__:
            return self.dataset.select(*needed)
        return settle(self.records.annotations.select(*needed))

    @cached_property
    def deletions(self) -> DataFrame:
        return settle(
            self.records.deleted.select("image_name", "task_id", "frame_id", "task_status", "task_updated_date")
        )

    @cached_property
    def boxes(self) -> DataFrame:
        return self.dataset.where(F.col("instance_shape") == S.BOX)

    # --- merge: two versions by priority; the middle one is in both -----------
    @cached_property
    def _version_rows(self) -> DataFrame:
        name = F.concat(F.replace("image_name", F.lit(".jpg"), F.lit("_")), F.col("instance_label"), F.lit(".jpg"))
        return self.boxes.select(
            name.alias("image_name"), "instance_shape", "instance_label",
            "bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br",
            "task_id", "frame_id", "task_status", "task_updated_date", "subset",
        )

    @cached_property
    def old_version(self) -> DataFrame:
        split = F.when(F.col("frame_id") % 2 == 0, "train").when(F.col("frame_id") % 3 == 0, "val")
        rows = self._version_rows.where(F.col("subset").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
        return rows.withColumn("split", split)

    @cached_property
    def new_version(self) -> DataFrame:
        split = F.when(F.col("frame_id") % 5 == 0, "test")
        rows = self._version_rows.where(F.col("subset").isin("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
        return rows.withColumn("split", split)

    @cached_property
    def merge_deletions(self) -> DataFrame:
        gone = self.deleted_frames.select("task_id", "frame_id")
        rows = self._version_rows.where(F.col("task_status") == S.COMPLETED)
        return rows.join(gone, ["task_id", "frame_id"], "left_semi").select("image_name").distinct()

    # --- YOLO: split by task state, sizes differing between frames ------------
    @cached_property
    def yolo_rows(self) -> DataFrame:
        split = (
            F.when(F.col("task_status") == S.COMPLETED, "train")
            .when(F.col("task_status") == "annotation", "val").otherwise("test")
        )
        return self.dataset.withColumn("split", split).withColumn(
            "image_width", (F.lit(640) + F.lit(32) * F.col("frame_id")).cast("int")
        )

    @cached_property
    def text_lines(self) -> DataFrame:
        """Label lines with blanks, short lines and optional confidences."""
        text = lambda c: F.col(c).cast("string")
        full = F.concat(
            F.lit(" "), (F.col("l_suppkey") % 30).cast("string"), F.lit(" 0."), text("l_partkey"),
            F.lit("  0."), text("l_suppkey"), F.lit("\t0.5 0."), text("l_linenumber"),
            F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" 0."), text("l_orderkey"))).otherwise(F.lit("")),
            F.lit(" "),
        )
        short = F.concat((F.col("l_suppkey") % 30).cast("string"), F.lit(" 0.1 0.2 0."), text("l_partkey"))
        line = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), short).otherwise(full)
        return self.raw("lineitem").select(
            F.concat(F.lit("f"), text("l_orderkey")).alias("stem"), line.alias("line")
        )

    # --- storage and local files ---------------------------------------------
    @cached_property
    def objects(self) -> DataFrame:
        return self.raw("pages").select(
            F.col("page_id").alias("ord"),
            F.regexp_extract("url", r"https?://[^/]+/([^?#]+)", 1).alias("key"),
        )

    @cached_property
    def store(self) -> DataFrame:
        """Image objects in month folders; the listing is in key order."""
        name = F.concat(
            F.date_format("l_shipdate", "yyyy-MM"), F.lit("/img_"), F.col("l_partkey").cast("string"), F.lit(".jpg")
        )
        kept = self.raw("lineitem").where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"))
        return kept.select(name.alias("name")).distinct().select(
            F.concat(F.lit("proj/images/"), "name").alias("key"), "name", F.col("name").alias("ord")
        )

    @cached_property
    def files(self) -> DataFrame:
        """Local image files in three search folders."""
        name = F.concat(F.lit("img_"), F.col("l_partkey").cast("string"), F.lit(".jpg"))
        rank = (F.col("l_linenumber") % 3).cast("int")
        kept = self.raw("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40))
        return kept.select(
            F.concat(F.lit("/cache"), rank.cast("string"), F.lit("/"), name).alias("path"),
            name.alias("name"), rank.alias("dir_rank"),
        ).distinct()

    @cached_property
    def candidates(self) -> DataFrame:
        """Files named by stem in two folders with several extensions."""
        stem = F.concat(F.lit("img_"), F.col("l_partkey").cast("string"))
        ext = F.element_at(
            F.array(*[F.lit(e) for e in S.IMAGE_EXTENSIONS]), (F.col("l_linenumber") % 6 + 1).cast("int")
        )
        sub = F.when(F.col("l_linestatus") == "F", "images/").otherwise("")
        name = F.concat(sub, stem, ext)
        rank = (F.col("l_suppkey") % 2).cast("int")
        return self.raw("lineitem").select(
            F.concat(F.lit("/d"), rank.cast("string"), F.lit("/"), name).alias("path"), name.alias("name"),
            rank.alias("dir_rank"),
        ).distinct()

    # --- cameras -------------------------------------------------------------
    @cached_property
    def camera(self) -> DataFrame:
        return self.raw("events").select(
            (F.col("user_id") % 8).cast("int").alias("camera_no"),
            F.col("event_id").alias("frame_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            (F.col("event_type") == "error").alias("incomplete"),
            (F.col("event_type") == "signup").alias("write_dropped"),
        )

    @cached_property
    def camera_repeats(self) -> DataFrame:
        """Camera events whose frame ids come in runs; ``event`` keeps the order."""
        return self.raw("events").select(
            (F.col("user_id") % 8).cast("int").alias("camera_no"),
            F.floor(F.col("value") / 20).cast("long").alias("frame_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            (F.col("event_type") == "error").alias("incomplete"),
            F.col("event_id").alias("event"),
        )

    # --- ignore list ---------------------------------------------------------
    @cached_property
    def ignored(self) -> DataFrame:
        """Urgent tasks are ignored, those not yet in work silently."""
        rows = self.tasks.where(F.col("subset") == "1-URGENT")
        return rows.select(
            F.concat(F.lit("project-"), F.col("project_id").cast("string")).alias("project"),
            F.col("task_id").alias("id"), F.col("task_name").alias("name"),
            F.lit("").alias("description"), (F.col("task_status") == "annotation").alias("silent"),
        )


VIEWS: dict[str, str] = {
    "a_tasks": """SELECT o_orderkey AS task_id, concat('task-', CAST(o_orderkey AS VARCHAR)) AS task_name,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'annotation' ELSE 'validation' END AS task_status,
  o_orderpriority AS subset, CAST(o_orderdate AS VARCHAR) AS task_updated_date, o_custkey AS project_id FROM orders""",
    "a_labels": """SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS label_id, p_brand AS label_name FROM part""",
    "a_frames": """SELECT l_orderkey AS task_id, CAST(l_linenumber - 1 AS INT) AS frame_id,
  concat('img_', CAST(min(l_partkey) AS VARCHAR), '.jpg') AS image_name, 640 AS image_width, 480 AS image_height,
  max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS is_deleted
  FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "a_shapes": """SELECT l_orderkey AS task_id, CAST(l_linenumber - 1 AS INT) AS frame_id,
  CASE WHEN l_tax > 0.01 THEN 'rectangle' ELSE 'polygon' END AS shape_type, l_suppkey % 30 AS label_id,
  l_quantity * 2 AS x_tl, l_quantity AS y_tl,
  l_quantity * 2 + l_extendedprice / 1000 AS x_br, l_quantity + l_extendedprice / 2000 AS y_br,
  l_returnflag, l_linestatus, l_partkey
  FROM lineitem""",
    "a_boxes": """SELECT f.image_name, f.image_width, f.image_height, 'box' AS instance_shape,
  coalesce(l.label_name, '<unknown>') AS instance_label,
  s.x_tl AS bbox_x_tl, s.y_tl AS bbox_y_tl, s.x_br AS bbox_x_br, s.y_br AS bbox_y_br,
  t.task_id, t.task_name, t.task_status, t.task_updated_date, s.frame_id, t.subset
  FROM a_shapes s JOIN a_frames f ON s.task_id = f.task_id AND s.frame_id = f.frame_id
  JOIN a_tasks t ON t.task_id = s.task_id LEFT JOIN a_labels l ON l.label_id = s.label_id
  WHERE s.shape_type = 'rectangle'""",
    "a_none": """SELECT f.image_name, f.image_width, f.image_height, f.task_id, t.task_name, f.frame_id,
  t.task_status, t.task_updated_date, t.subset
  FROM a_frames f JOIN a_tasks t ON t.task_id = f.task_id
  WHERE f.is_deleted = 0 AND NOT EXISTS (SELECT 1 FROM a_shapes s WHERE s.task_id = f.task_id
    AND s.frame_id = f.frame_id AND s.shape_type = 'rectangle')""",
    "a_deleted": """SELECT f.image_name, f.image_width, f.image_height, f.task_id, t.task_name, f.frame_id,
  t.task_status, t.task_updated_date, t.subset
  FROM a_frames f JOIN a_tasks t ON t.task_id = f.task_id WHERE f.is_deleted = 1""",
    "a_ann": """SELECT image_name, task_id, frame_id, task_status, task_updated_date FROM a_boxes
  UNION ALL SELECT image_name, task_id, frame_id, task_status, task_updated_date FROM a_none""",
    "a_state": """SELECT n.image_name, coalesce(l.d, 0) AS is_gone, c.lt FROM
  (SELECT image_name FROM a_ann UNION SELECT image_name FROM a_deleted) n
  LEFT JOIN (SELECT image_name, d FROM (SELECT image_name, d, row_number() OVER (PARTITION BY image_name
     ORDER BY ts DESC NULLS LAST, d DESC, task_id DESC) AS rn FROM
     (SELECT image_name, task_id, try_cast(task_updated_date AS TIMESTAMP) AS ts, 0 AS d FROM a_ann
      UNION ALL SELECT image_name, task_id, try_cast(task_updated_date AS TIMESTAMP) AS ts, 1 AS d FROM a_deleted) ev) x
     WHERE rn = 1) l ON l.image_name = n.image_name
  LEFT JOIN (SELECT image_name, task_id AS lt FROM (SELECT image_name, task_id, row_number() OVER (PARTITION BY image_name
     ORDER BY try_cast(task_updated_date AS TIMESTAMP) DESC NULLS LAST, task_id DESC) AS rn FROM a_ann
     WHERE task_status = 'completed') y WHERE rn = 1) c ON c.image_name = n.image_name""",
    "a_part": """SELECT a.*, CASE WHEN s.is_gone = 1 THEN 'obsolete' WHEN a.task_status <> 'completed' THEN 'in_progress'
  WHEN a.task_id = s.lt THEN 'dataset' ELSE 'obsolete' END AS part
  FROM a_ann a JOIN a_state s ON s.image_name = a.image_name""",
    "a_versions": """SELECT concat(replace(image_name, '.jpg', '_'), instance_label, '.jpg') AS image_name,
  instance_shape, instance_label, bbox_x_tl, bbox_y_tl, bbox_x_br, bbox_y_br,
  task_id, frame_id, task_status, task_updated_date, subset FROM a_boxes""",
    "a_old": """SELECT *, CASE WHEN frame_id % 2 = 0 THEN 'train' WHEN frame_id % 3 = 0 THEN 'val' END AS split
  FROM a_versions WHERE subset IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "a_new": """SELECT *, CASE WHEN frame_id % 5 = 0 THEN 'test' END AS split
  FROM a_versions WHERE subset IN ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')""",
    "a_del_names": """SELECT DISTINCT v.image_name FROM a_versions v JOIN a_frames f
  ON f.task_id = v.task_id AND f.frame_id = v.frame_id WHERE f.is_deleted = 1 AND v.task_status = 'completed'""",
    "a_yolo": """SELECT image_name, CAST(640 + 32 * frame_id AS INT) AS image_width, image_height, 'box' AS instance_shape,
  instance_label, bbox_x_tl, bbox_y_tl, bbox_x_br, bbox_y_br, task_id, frame_id,
  CASE task_status WHEN 'completed' THEN 'train' WHEN 'annotation' THEN 'val' ELSE 'test' END AS split FROM a_boxes
  UNION ALL SELECT image_name, CAST(640 + 32 * frame_id AS INT), image_height, 'none', NULL, NULL, NULL, NULL, NULL,
  task_id, frame_id, CASE task_status WHEN 'completed' THEN 'train' WHEN 'annotation' THEN 'val' ELSE 'test' END FROM a_none""",
    "a_classes": """SELECT instance_label, CAST(row_number() OVER (ORDER BY instance_label) - 1 AS INT) AS class_id
  FROM (SELECT DISTINCT instance_label FROM a_boxes) d""",
    "a_lines": """SELECT y.split, y.image_name, replace(y.image_name, '.jpg', '') AS stem, y.task_id, y.frame_id,
  concat(CAST(c.class_id AS VARCHAR), ' ', printf('%.6f', ((y.bbox_x_tl + y.bbox_x_br) / 2.0) / f.image_width),
   ' ', printf('%.6f', ((y.bbox_y_tl + y.bbox_y_br) / 2.0) / f.image_height),
   ' ', printf('%.6f', (y.bbox_x_br - y.bbox_x_tl) / f.image_width),
   ' ', printf('%.6f', (y.bbox_y_br - y.bbox_y_tl) / f.image_height)) AS line
  FROM a_yolo y JOIN a_classes c ON c.instance_label = y.instance_label
  JOIN (SELECT split, image_name, image_width, image_height FROM (SELECT split, image_name, image_width, image_height,
    row_number() OVER (PARTITION BY split, image_name ORDER BY task_id, frame_id) AS rn
    FROM a_yolo WHERE instance_shape = 'box') q WHERE rn = 1) f
  ON f.split = y.split AND f.image_name = y.image_name WHERE y.instance_shape = 'box'""",
    "a_text": """SELECT concat('f', CAST(l_orderkey AS VARCHAR)) AS stem,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O'
   THEN concat(CAST(l_suppkey % 30 AS VARCHAR), ' 0.1 0.2 0.', CAST(l_partkey AS VARCHAR))
   ELSE concat(' ', CAST(l_suppkey % 30 AS VARCHAR), ' 0.', CAST(l_partkey AS VARCHAR), '  0.', CAST(l_suppkey AS VARCHAR),
    chr(9), '0.5 0.', CAST(l_linenumber AS VARCHAR),
    CASE WHEN l_returnflag = 'R' THEN concat(' 0.', CAST(l_orderkey AS VARCHAR)) ELSE '' END, ' ') END AS line
  FROM lineitem""",
    "a_objects": """SELECT page_id AS ord, regexp_extract(url, 'https?://[^/]+/([^?#]+)', 1) AS key FROM pages""",
    "a_store": """SELECT concat('proj/images/', name) AS key, name, name AS ord, regexp_replace(name, '^.*/', '') AS base
  FROM (SELECT DISTINCT concat(strftime(l_shipdate, '%Y-%m'), '/img_', CAST(l_partkey AS VARCHAR), '.jpg') AS name
  FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F') d""",
    "a_files": """SELECT DISTINCT concat('/cache', CAST(l_linenumber % 3 AS VARCHAR), '/img_', CAST(l_partkey AS VARCHAR), '.jpg') AS path,
  concat('img_', CAST(l_partkey AS VARCHAR), '.jpg') AS name, CAST(l_linenumber % 3 AS INT) AS dir_rank
  FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40""",
    "a_candidates": """SELECT DISTINCT concat('/d', CAST(l_suppkey % 2 AS VARCHAR), '/', sub, 'img_', CAST(l_partkey AS VARCHAR), ext) AS path,
  concat('img_', CAST(l_partkey AS VARCHAR)) AS stem, l_suppkey % 2 AS dir_rank, length(sub) AS sub_rank, l_linenumber % 6 AS ext_rank
  FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'images/' ELSE '' END AS sub,
   CASE l_linenumber % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.png' WHEN 3 THEN '.bmp' WHEN 4 THEN '.tiff' ELSE '.webp' END AS ext
   FROM lineitem) z""",
    "a_camera": """SELECT CAST(user_id % 8 AS INT) AS camera_no, event_id AS frame_id, ts, event_type = 'error' AS incomplete,
  event_type = 'signup' AS write_dropped FROM events""",
    "a_repeats": """SELECT CAST(user_id % 8 AS INT) AS camera_no, CAST(floor(value / 20) AS BIGINT) AS frame_id, ts,
  event_type = 'error' AS incomplete, event_id AS event FROM events""",
    "a_minutes": """SELECT date_trunc('minute', ts) AS start, camera_no,
  count(*) FILTER (WHERE NOT incomplete) AS frames, count(*) FILTER (WHERE incomplete) AS grab_errors,
  count(*) FILTER (WHERE NOT incomplete AND write_dropped) AS write_drops
  FROM a_camera GROUP BY 1, 2""",
    "a_ignored": """SELECT concat('project-', CAST(project_id AS VARCHAR)) AS project, task_id AS id, task_name AS name,
  '' AS description, task_status = 'annotation' AS silent FROM a_tasks WHERE subset = '1-URGENT'""",
}


def with_views(sql: str) -> str:
    """``sql`` preceded by the views it needs as common table expressions."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\ba_[a-z_]+\b", text):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {head},\n{sql.lstrip()[5:]}"
    return f"WITH {head}\n{sql}"
