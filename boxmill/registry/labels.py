"""Label usage, edits, remapping; ignore lists and project names."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.adapters import Tables
from boxmill.functions import attributes_json, attributes_map
from boxmill.operators import selection as P
from boxmill.plans import labels as L
from boxmill.plans import reconcile as R
from boxmill.plans import scale
from boxmill.registry import query


@query("SELECT label_id, count(*) AS shapes FROM a_shapes GROUP BY label_id")
def label_usage(t: Tables) -> DataFrame:
    return L.label_usage(t.shapes)


@query("""SELECT l.label_id, l.label_name, count(s.task_id) AS shapes FROM a_labels l
  LEFT JOIN a_shapes s ON s.label_id = l.label_id GROUP BY 1, 2""")
def label_report(t: Tables) -> DataFrame:
    return L.usage_report(t.labels, t.shapes)


@query("SELECT DISTINCT instance_label FROM a_boxes WHERE instance_label NOT IN (SELECT label_name FROM a_labels)")
def label_unknown(t: Tables) -> DataFrame:
    return R.unknown_labels(t.boxes, t.labels)


@query("""SELECT coalesce(instance_label, '__no_annotation__') AS choice, count(*) AS n_rows FROM
  (SELECT instance_label FROM a_boxes UNION ALL SELECT NULL FROM a_none) u GROUP BY 1""")
def label_candidates(t: Tables) -> DataFrame:
    return P.label_candidates(t.dataset)


@query("""SELECT image_name, task_id, frame_id, instance_label FROM a_boxes WHERE instance_label IN ('Brand#11', '<unknown>')
  UNION ALL SELECT image_name, task_id, frame_id, NULL FROM a_none""")
def label_selection(t: Tables) -> DataFrame:
    rows = P.with_labels(t.dataset, ["Brand#11", "<unknown>", "__no_annotation__"])
    return rows.select("image_name", "task_id", "frame_id", "instance_label")


@query("""SELECT n.label_id, n.label_name, n.color, count(s.task_id) AS shapes FROM (
   SELECT label_id, CASE label_id WHEN 11 THEN 'scooter' WHEN 21 THEN 'brand-21' ELSE label_name END AS label_name,
   CASE label_id WHEN 14 THEN '#ff00aa' ELSE '' END AS color FROM a_labels WHERE label_id NOT IN (12, 23)
   UNION ALL SELECT 100, 'cart', '') n
  LEFT JOIN a_shapes s ON s.label_id = n.label_id GROUP BY 1, 2, 3""")
def label_edits(t: Tables) -> DataFrame:
    labels, shapes = L.apply_label_changes(
        t.labels, t.shapes,
        add={100: "cart"}, rename={11: "scooter", 21: "brand-21"}, recolor={14: "#FF00aa"}, delete=[12, 23],
    )
    usage = L.usage_report(labels, shapes)
    return labels.select("label_id", "color").join(usage, "label_id").select(
        "label_id", "label_name", "color", "shapes"
    )


@query("SELECT task_id, frame_id, label_id, shape_type AS type FROM a_shapes WHERE label_id NOT IN (12, 23)")
def label_delete(t: Tables) -> DataFrame:
    _, shapes = L.apply_label_changes(t.labels, t.shapes, delete=[12, 23])
    return shapes.select("task_id", "frame_id", "label_id", "type")


@query("""SELECT s.task_id, s.frame_id, l.label_id + 1000 AS label_id,
  concat('{"501": "', s.l_returnflag, '", "2": "', s.l_linestatus, '", "9": "', CAST(s.l_partkey AS VARCHAR), '"}') AS attributes
  FROM a_shapes s JOIN a_labels l ON l.label_id = s.label_id WHERE l.label_name <> 'Brand#22'""")
def remap_labels(t: Tables) -> DataFrame:
    """Into a project with shifted ids, without one label and one attribute."""
    spec = F.struct(F.lit(501).cast("long").alias("id"), F.lit("flag").alias("name"))
    target = t.labels.where(F.col("label_name") != "Brand#22").select(
        (F.col("label_id") + 1000).alias("label_id"), "label_name", F.array(spec).alias("attributes")
    )
    moved = L.remap_shapes(t.shapes_with_attributes, t.labels_with_attributes, target)
    text = attributes_json(
        attributes_map(
            F.transform("attributes", lambda a: a["spec_id"].cast("string")),
            F.transform("attributes", lambda a: a["value"]),
        )
    )
    return moved.select("task_id", "frame_id", "label_id", text.alias("attributes"))


@query("""SELECT project, count(*) AS tasks FROM a_ignored GROUP BY project
  UNION ALL SELECT NULL, count(*) FROM a_ignored""")
def ignored_counts(t: Tables) -> DataFrame:
    return P.ignored_counts(t.ignored)


@query("""SELECT project, id, name, silent FROM a_ignored WHERE silent
  UNION ALL SELECT concat('project-', CAST(project_id AS VARCHAR)), task_id, task_name, false FROM a_tasks
  WHERE subset = '2-HIGH'""")
def ignore_edit(t: Tables) -> DataFrame:
    """Take the loud entries off the list and put the next priority on it."""
    rest = P.unignore_tasks(t.ignored, t.ignored.where("NOT silent"))
    fresh = t.tasks.where(F.col("subset") == "2-HIGH").select(
        F.concat(F.lit("project-"), F.col("project_id").cast("string")).alias("project"),
        F.col("task_id").alias("id"), F.col("task_name").alias("name"),
        F.lit("").alias("description"), F.lit(False).alias("silent"),
    )
    kept_too = t.ignored.where("silent")
    return P.ignore_tasks(rest, fresh.unionByName(kept_too)).select("project", "id", "name", "silent")


@query("""SELECT concat('project-', CAST(c_custkey AS VARCHAR)) AS name FROM customer UNION SELECT project FROM a_ignored""")
def known_projects(t: Tables) -> DataFrame:
    projects = t.raw("customer").select(F.concat(F.lit("project-"), F.col("c_custkey").cast("string")).alias("name"))
    return P.project_names(projects, t.ignored)


@query("""WITH b AS (SELECT *, row_number() OVER (ORDER BY task_id) - 1 AS base FROM a_tasks),
  n AS (SELECT count(*) AS c FROM a_tasks), r AS (SELECT unnest([0, 1]) AS rep)
  SELECT 100 + r.rep * n.c + b.base AS task_id, concat('task-', CAST(r.rep * n.c + b.base AS VARCHAR)) AS task_name,
  CASE (r.rep * n.c + b.base) % 3 WHEN 0 THEN 'annotation' WHEN 1 THEN 'validation' ELSE 'completed' END AS task_status,
  b.subset, b.task_updated_date, b.task_id AS base_task_id FROM b, n, r""")
def scale_tasks(t: Tables) -> DataFrame:
    rows = scale.scale_tasks(
        t.tasks.drop("project_id"), 2 * t.tasks.count(), pick="cycle",
        names="enumerated", statuses=["annotation", "validation", "completed"],
    )
    return rows.drop("pos")


_SCALED = """WITH b AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS base FROM a_tasks),
  n AS (SELECT count(*) AS c FROM a_tasks), r AS (SELECT unnest([0, 1]) AS rep),
  m AS (SELECT b.task_id AS old, 100 + r.rep * n.c + b.base AS task_id FROM b, n, r)"""


@query(f"""{_SCALED} SELECT 'frame' AS kind, m.task_id, frame_id, image_name AS name, CAST(NULL AS BIGINT) AS label_id
  FROM a_frames f JOIN m ON m.old = f.task_id
  UNION ALL SELECT 'deleted', m.task_id, frame_id, NULL, NULL FROM a_frames f JOIN m ON m.old = f.task_id WHERE is_deleted = 1
  UNION ALL SELECT 'shape', m.task_id, frame_id, shape_type, label_id FROM a_shapes s JOIN m ON m.old = s.task_id""")
def scale_project(t: Tables) -> DataFrame:
    """All frames, deletions and shapes of a project twice the size."""
    big = scale.scale_project(t.snapshot, 2 * t.tasks.count(), pick="cycle")
    none = F.lit(None)
    frames = big.frames.select(F.lit("frame").alias("kind"), "task_id", "frame_id", "name", none.cast("long").alias("label_id"))
    gone = big.deleted.select(F.lit("deleted"), "task_id", "frame_id", none.cast("string"), none.cast("long"))
    shapes = big.shapes.select(F.lit("shape"), "task_id", "frame_id", "type", "label_id")
    return frames.union(gone).union(shapes)
