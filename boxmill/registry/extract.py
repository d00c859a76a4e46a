"""Extraction and task selection."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.adapters import Tables
from boxmill.functions import attributes_json
from boxmill.operators import selection as P
from boxmill.plans import extract as X
from boxmill.registry import query
from boxmill.session import scratch_root, shuffles_dropped
from boxmill.sinks.snapshots import in_portions, snapshot_documents
from boxmill.sinks.tables import as_text_table
from boxmill.sources.documents import read_documents

BOX_COLUMNS = [
    "image_name", "image_width", "image_height", "instance_shape", "instance_label",
    "bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br",
    "task_id", "task_name", "task_status", "task_updated_date", "frame_id",
]
IMAGE_COLUMNS = [
    "image_name", "image_width", "image_height", "task_id", "task_name", "frame_id",
    "task_status", "task_updated_date", "subset",
]
_BOX_SQL = ", ".join(BOX_COLUMNS)
_IMAGE_SQL = ", ".join(IMAGE_COLUMNS)


@query(f"SELECT {_BOX_SQL} FROM a_boxes")
def extract_boxes(t: Tables) -> DataFrame:
    return X.box_rows(t.snapshot).select(*BOX_COLUMNS)


@query(f"SELECT {_IMAGE_SQL} FROM a_none")
def extract_unannotated(t: Tables) -> DataFrame:
    return X.unannotated_rows(t.snapshot).select(*IMAGE_COLUMNS)


@query(f"SELECT {_IMAGE_SQL} FROM a_deleted")
def extract_deleted(t: Tables) -> DataFrame:
    return X.deleted_rows(t.snapshot).select(*IMAGE_COLUMNS)


@query("""SELECT task_id, frame_id, instance_label,
  concat('{"flag": "', l_returnflag, '", "status": "', l_linestatus, '", "9": "', CAST(l_partkey AS VARCHAR), '"}') AS attributes
  FROM (SELECT s.task_id, s.frame_id, coalesce(l.label_name, '<unknown>') AS instance_label,
    s.l_returnflag, s.l_linestatus, s.l_partkey
    FROM a_shapes s JOIN a_frames f ON f.task_id = s.task_id AND f.frame_id = s.frame_id
    JOIN a_tasks t ON t.task_id = s.task_id
    LEFT JOIN a_labels l ON l.label_id = s.label_id WHERE s.shape_type = 'rectangle') q""")
def box_attributes(t: Tables) -> DataFrame:
    snapshot = X.Snapshot(
        t.tasks, t.frames, t.deleted_frames, t.shapes_with_attributes, t.labels_with_attributes
    )
    rows = X.box_rows(snapshot)
    return rows.select(
        "task_id", "frame_id", "instance_label", attributes_json("attributes").alias("attributes")
    )


@query("""SELECT image_name, CAST(image_width AS INT) AS image_width, CAST(image_height AS INT) AS image_height,
  'box' AS instance_shape, instance_label, bbox_x_tl, bbox_y_tl, bbox_x_br, bbox_y_br, task_id, task_name, task_status,
  task_updated_date, '' AS created_by_username, frame_id, CAST(NULL AS VARCHAR) AS split, subset, false AS occluded,
  CAST(0 AS INT) AS z_order, CAST(0 AS DOUBLE) AS rotation, '' AS source, CAST(NULL AS BIGINT) AS annotation_id,
  CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS s3_path, CAST(NULL AS VARCHAR) AS image_path, '{}' AS attributes
  FROM a_boxes UNION ALL
  SELECT image_name, image_width, image_height, 'none', NULL, NULL, NULL, NULL, NULL, task_id, task_name, task_status,
  task_updated_date, NULL, frame_id, NULL, subset, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{}' FROM a_none""")
def fetch_table(t: Tables) -> DataFrame:
    return as_text_table(X.fetch_annotations(t.snapshot))


@query("""SELECT image_name, instance_label, task_id, frame_id FROM a_boxes WHERE task_status = 'completed'
  UNION ALL SELECT image_name, NULL, task_id, frame_id FROM a_none WHERE task_status = 'completed'""")
def fetch_completed(t: Tables) -> DataFrame:
    rows = X.fetch_annotations(t.snapshot, completed_only=True)
    return rows.select("image_name", "instance_label", "task_id", "frame_id")


@query("""SELECT image_name, instance_label, task_id, frame_id FROM a_boxes
  WHERE task_id NOT IN (SELECT id FROM a_ignored)
  UNION ALL SELECT image_name, NULL, task_id, frame_id FROM a_none WHERE task_id NOT IN (SELECT id FROM a_ignored)""")
def fetch_ignored(t: Tables) -> DataFrame:
    rows = X.fetch_annotations(t.snapshot, ignored=t.ignored)
    return rows.select("image_name", "instance_label", "task_id", "frame_id")


@query("""SELECT t.task_id, t.task_name, t.task_updated_date FROM a_tasks t JOIN a_ignored i ON i.id = t.task_id
  WHERE NOT i.silent""")
def ignored_report(t: Tables) -> DataFrame:
    return P.ignored_report(t.tasks, t.ignored).select("task_id", "task_name", "task_updated_date")


# what a user would type: all 25 brand names, in lower case and backwards
_SELECTORS = [f"brand#{n}" for n in range(25, 0, -1)]


@query(f"""SELECT s.pick, p.task_id, p.task_name FROM
  (SELECT name, CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS pick FROM
   (SELECT unnest({_SELECTORS!r}) AS name, unnest(range({len(_SELECTORS)})) AS pos) u
   WHERE name IN (SELECT lower(p_brand) FROM part)) s
  JOIN (SELECT min(p_partkey) AS task_id, p_brand AS task_name FROM part GROUP BY p_brand) p
  ON lower(p.task_name) = s.name""")
def fetch_selected(t: Tables) -> DataFrame:
    tasks = t.raw("part").select(
        F.col("p_partkey").alias("task_id"), F.col("p_brand").alias("task_name")
    )
    return P.select_tasks(tasks, _SELECTORS).select("pick", "task_id", "task_name")


_PICKED = ["STRASSE-3", "1", " ſtrasse-2 ", "STRAẞE-0", "3"]


@query("""SELECT image_name, 'box' AS instance_shape, instance_label, task_id, frame_id FROM a_boxes WHERE task_id IN (0, 1, 2, 3)
  UNION ALL SELECT image_name, 'none', NULL, task_id, frame_id FROM a_none WHERE task_id IN (0, 1, 2, 3)""")
def fetch_picked(t: Tables) -> DataFrame:
    """The rows of tasks chosen by id or by names that differ in more than capitals."""
    named = t.tasks.withColumn("task_name", F.concat(F.lit("Straße-"), F.col("task_id").cast("string")))
    tasks = P.select_tasks(named, _PICKED).drop("pick")
    rows = X.fetch_annotations(X.Snapshot(tasks, t.frames, t.deleted_frames, t.shapes, t.labels))
    return rows.select("image_name", "instance_shape", "instance_label", "task_id", "frame_id")


@query("""SELECT task_id, task_name FROM a_tasks WHERE project_id = 2""")
def find_project(t: Tables) -> DataFrame:
    """The tasks of a project that is found by its name."""
    projects = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    found = P.find_project(projects, " CUſTOMER#000000002 ")
    return t.tasks.where(F.col("project_id") == found).select("task_id", "task_name")


@query("""SELECT q.task_id, q.frame_id, concat('{"', coalesce(p.name, CAST(q.l_partkey AS VARCHAR)), '": "', q.l_returnflag, '"}') AS attributes
  FROM (SELECT s.* FROM a_shapes s JOIN a_frames f ON f.task_id = s.task_id AND f.frame_id = s.frame_id
    JOIN a_tasks t ON t.task_id = s.task_id WHERE s.shape_type = 'rectangle') q
  LEFT JOIN (SELECT p_partkey, concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS name FROM part) p ON p.p_partkey = q.l_partkey""")
def box_attributes_many(t: Tables) -> DataFrame:
    """Attribute values of as many specs as there are parts."""
    spec = F.struct(F.col("p_partkey").cast("long").alias("id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))
    specs = t.raw("part").groupBy(F.col("p_brand").alias("label_name")).agg(F.array_sort(F.collect_list(spec)).alias("attributes"))
    value = F.array(F.struct(F.col("l_partkey").cast("long").alias("spec_id"), F.col("l_returnflag").alias("value")))
    shapes = t.raw("lineitem").select(
        F.col("l_orderkey").alias("task_id"), (F.col("l_linenumber") - 1).cast("int").alias("frame_id"),
        F.when(F.col("l_tax") > 0.01, "rectangle").otherwise("polygon").alias("type"),
        (F.col("l_suppkey") % 30).alias("label_id"), F.array(*[F.lit(float(i)) for i in range(4)]).alias("points"), value.alias("attributes"),
    )
    snapshot = X.Snapshot(t.tasks, t.frames, t.deleted_frames, shapes, t.labels.join(specs, "label_name"))
    return X.box_rows(snapshot).select("task_id", "frame_id", attributes_json("attributes").alias("attributes"))


@query("""SELECT instance_shape, count(*) AS n_rows FROM (
  SELECT 'box' AS instance_shape FROM a_boxes UNION ALL SELECT 'none' FROM a_none
  UNION ALL SELECT 'deleted' FROM a_deleted) u GROUP BY 1""")
def fetch_summary(t: Tables) -> DataFrame:
    return X.fetch_summary(t.records)


@query("SELECT shape_type AS type, count(*) AS shapes FROM a_shapes WHERE shape_type <> 'rectangle' GROUP BY 1")
def skipped_shapes(t: Tables) -> DataFrame:
    return P.skipped_shapes(t.shapes)


@query(f"""SELECT {_BOX_SQL} FROM a_boxes UNION ALL
  SELECT image_name, image_width, image_height, 'none', NULL, NULL, NULL, NULL, NULL,
  task_id, task_name, task_status, task_updated_date, frame_id FROM a_none UNION ALL
  SELECT image_name, image_width, image_height, 'deleted', NULL, NULL, NULL, NULL, NULL,
  task_id, task_name, task_status, task_updated_date, frame_id FROM a_deleted""")
def snapshot_round_trip(t: Tables) -> DataFrame:
    """Flat tables -> documents in bounded parts -> flat tables -> rows."""
    documents = snapshot_documents(t.snapshot, frames_per_document=4, shapes_per_document=3)
    records = X.extract_records(X.Snapshot.of_documents(in_portions(documents, t.snapshot), t.labels))
    return records.raw().select(*BOX_COLUMNS)


@query(f"""SELECT {_BOX_SQL} FROM a_boxes UNION ALL
  SELECT image_name, image_width, image_height, 'none', NULL, NULL, NULL, NULL, NULL,
  task_id, task_name, task_status, task_updated_date, frame_id FROM a_none UNION ALL
  SELECT image_name, image_width, image_height, 'deleted', NULL, NULL, NULL, NULL, NULL,
  task_id, task_name, task_status, task_updated_date, frame_id FROM a_deleted""")
def document_files(t: Tables) -> DataFrame:
    """Flat tables -> packed document files in parts of four frames -> read with defaults -> rows."""
    folder = f"{scratch_root(t.spark).rstrip('/')}/documents-{uuid.uuid4().hex}"
    for portion in in_portions(snapshot_documents(t.snapshot, frames_per_document=4), t.snapshot):
        with shuffles_dropped(t.spark):
            portion.write.mode("append").json(folder, compression="gzip")
    records = X.extract_records(X.Snapshot.of_documents(read_documents(t.spark, folder), t.labels).written())
    return records.raw().select(*BOX_COLUMNS)
