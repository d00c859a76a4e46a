"""Plans for storage, local files and tasks."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.adapters import Tables
from boxmill.functions import object_key, relative_key
from boxmill.operators import lookup as K
from boxmill.operators import selection as P
from boxmill.plans import pushback as B
from boxmill.plans import reconcile as R
from boxmill.registry import query
from boxmill.session import scratch_root
from boxmill.sinks.files import write_blobs
from boxmill.sources.listing import image_files, list_files, object_names

_ORDER = ["task_id", "frame_id"]


@query("""SELECT ord, key, string_split(key, '/')[1] AS prefix,
  CASE WHEN starts_with(key, substr(key, 1, 1)) THEN key ELSE '' END AS key_short,
  concat('img/', key) AS key_long, ltrim(substr(key, length(string_split(key, '/')[1]) + 1), '/') AS relative FROM a_objects""")
def object_keys(t: Tables) -> DataFrame:
    rows = t.objects.withColumn("prefix", F.get(F.split("key", "/"), F.lit(0)))
    return rows.select(
        "ord", "key", "prefix",
        object_key(F.substring("key", 1, 1), "key").alias("key_short"),
        object_key("img", "key").alias("key_long"),
        relative_key(F.col("prefix"), "key").alias("relative"),
    )


@query("""SELECT r.image_name, coalesce(e.key, b.key) AS key FROM
  (SELECT CAST(p_partkey AS VARCHAR) AS image_name FROM part UNION SELECT key FROM a_objects) r
  LEFT JOIN (SELECT key AS name, key FROM (SELECT DISTINCT key FROM a_objects) d) e ON e.name = r.image_name
  LEFT JOIN (SELECT base, key FROM (SELECT regexp_replace(rtrim(key, '/'), '^.*/', '') AS base, key,
    row_number() OVER (PARTITION BY regexp_replace(rtrim(key, '/'), '^.*/', '') ORDER BY ord) AS rn FROM a_objects) q WHERE rn = 1) b
  ON b.base = regexp_replace(rtrim(r.image_name, '/'), '^.*/', '')""")
def object_lookup(t: Tables) -> DataFrame:
    objects = t.objects.withColumn("name", F.col("key"))
    wanted = t.raw("part").select(F.col("p_partkey").cast("string").alias("image_name")).union(
        t.objects.select("key")
    ).distinct()
    index = K.name_index(objects, "name", "key", ["ord"])
    return K.attach_by_name(wanted, index, "image_name", "key").select("image_name", "key")


@query("SELECT base, max(name) AS name, count(*) AS copies FROM a_store GROUP BY base")
def newest_object(t: Tables) -> DataFrame:
    return K.newest_object(t.store)


@query("""SELECT s.base, s.name, n.copies, s.name = n.newest AS is_used FROM a_store s JOIN (
  SELECT base, max(name) AS newest, count(*) AS copies FROM a_store GROUP BY base HAVING count(*) > 1) n ON n.base = s.base""")
def object_duplicates(t: Tables) -> DataFrame:
    return K.duplicate_objects(t.store)


@query("SELECT image_name, task_id FROM (SELECT image_name, task_id, row_number() OVER (PARTITION BY image_name ORDER BY task_id, frame_id) AS rn FROM a_ann) q WHERE rn = 1")
def image_tasks(t: Tables) -> DataFrame:
    return R.image_tasks(t.history, _ORDER)


_DOWNLOAD = """SELECT i.image_name, i.task_id, CASE WHEN f.name IS NULL THEN b.key END AS key,
  CASE WHEN f.name IS NOT NULL THEN 'cached' WHEN b.key IS NULL THEN 'failed' ELSE 'download' END AS status
  FROM (SELECT image_name, task_id FROM (SELECT image_name, task_id, row_number() OVER (
    PARTITION BY image_name ORDER BY task_id, frame_id) AS rn FROM a_ann) q WHERE rn = 1) i
  LEFT JOIN (SELECT DISTINCT name FROM a_files) f ON f.name = i.image_name
  LEFT JOIN (SELECT base, key FROM (SELECT base, key, row_number() OVER (PARTITION BY base ORDER BY ord) AS rn FROM a_store) s
    WHERE rn = 1) b ON b.base = i.image_name"""


def _download(t: Tables) -> DataFrame:
    return R.plan_download(t.history, t.store, t.files, _ORDER)


@query(_DOWNLOAD)
def download_plan(t: Tables) -> DataFrame:
    return _download(t)


@query(f"""SELECT count(*) FILTER (WHERE status = 'download') AS transferred, count(*) FILTER (WHERE status = 'cached') AS skipped,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS total FROM ({_DOWNLOAD}) p""")
def transfer_stats(t: Tables) -> DataFrame:
    return R.transfer_stats(_download(t))


# names of any form and empty files among the objects of the store
_LISTED = """SELECT regexp_replace(name, 'img_', CASE length(name) % 4 WHEN 0 THEN '_DSC' WHEN 1 THEN '.img' WHEN 2 THEN '_x=' ELSE 'img_' END) AS name,
  CASE WHEN name LIKE '%7.jpg' THEN 0 ELSE length(name) END AS length FROM a_store"""


@query(f"""SELECT concat('proj/images/', name) AS key, name, CAST(length AS BIGINT) AS length, name LIKE '%.jpg' AS is_image FROM ({_LISTED}) s""")
def object_listing(t: Tables) -> DataFrame:
    """The objects of the store as files, written and listed again."""
    odd = F.length("name") % 4
    form = F.when(odd == 0, "_DSC").when(odd == 1, ".img").when(odd == 2, "_x=").otherwise("img_")
    content = F.when(F.col("name").endswith("7.jpg"), "").otherwise(F.col("name"))
    # one file is one unit of work: few bytes, but as many tasks as there are cores and some more
    store = t.store.repartition(4 * t.spark.sparkContext.defaultParallelism, "name")
    objects = store.select(
        F.concat(F.lit("proj/images/"), F.replace(F.col("name"), F.lit("img_"), form)).alias("name"), content.alias("content")
    )
    folder = f"{scratch_root(t.spark).rstrip('/')}/objects-{uuid.uuid4().hex}"
    write_blobs(objects, folder)
    listing = object_names(list_files(t.spark, folder).withColumnRenamed("name", "key"), "proj/images")
    images = image_files(listing).select("key", F.lit(True).alias("is_image"))
    found = listing.select("key", "name", "length").join(images, "key", "left")
    return found.withColumn("is_image", F.coalesce("is_image", F.lit(False)))


_SYNC = """SELECT substr(s.name, 1, 4) AS project, s.key, s.base AS name,
  CASE WHEN f.name IS NULL THEN 'download' ELSE 'cached' END AS status
  FROM a_store s LEFT JOIN (SELECT DISTINCT name, CAST(1992 + dir_rank AS VARCHAR) AS project FROM a_files) f
  ON f.name = s.base AND f.project = substr(s.name, 1, 4)"""


def _sync(t: Tables) -> DataFrame:
    """Every year's folder is a project with a cache of its own."""
    objects = t.store.select(
        F.substring("name", 1, 4).alias("project"), "key", F.substring_index("name", "/", -1).alias("name")
    )
    local = t.files.select((F.col("dir_rank") + 1992).cast("string").alias("project"), "name")
    return R.plan_sync(objects, local, ["project"])


@query(_SYNC)
def sync_plan(t: Tables) -> DataFrame:
    return _sync(t)


@query(f"""SELECT project, count(*) FILTER (WHERE status = 'download') AS transferred, count(*) FILTER (WHERE status = 'cached') AS skipped,
  CAST(0 AS BIGINT) AS failed, count(*) AS total FROM ({_SYNC}) p GROUP BY project""")
def sync_stats(t: Tables) -> DataFrame:
    return R.transfer_stats(_sync(t), ["project"])


_PATHS = "(SELECT name, path FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY dir_rank) AS rn FROM a_files) q WHERE rn = 1)"


@query(f"""SELECT n.image_name, p.path AS image_path FROM (SELECT DISTINCT image_name FROM a_ann) n
  LEFT JOIN {_PATHS} p ON p.name = n.image_name""")
def local_lookup(t: Tables) -> DataFrame:
    return R.local_paths(t.history.select("image_name").distinct(), t.files)


@query("""SELECT DISTINCT image_name FROM a_ann WHERE image_name NOT IN (SELECT name FROM a_files)""")
def missing_images(t: Tables) -> DataFrame:
    return R.missing_images(t.history.select("image_name").distinct(), t.files)


@query(f"""WITH i AS (SELECT image_name FROM (
   SELECT image_name FROM a_boxes WHERE instance_label IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15', '<unknown>')
   UNION SELECT image_name FROM a_none) c WHERE image_name NOT IN (SELECT image_name FROM a_part WHERE part = 'dataset')
  UNION SELECT image_name FROM a_deleted),
  s AS (SELECT i.image_name, coalesce(n.newest, concat('2026-02/', i.image_name)) AS server_file
   FROM i LEFT JOIN (SELECT base, max(name) AS newest FROM a_store GROUP BY base) n ON n.base = i.image_name)
  SELECT s.image_name, s.server_file, concat('proj/images/', s.server_file) AS key, p.path AS image_path,
  CASE WHEN k.key IS NOT NULL THEN 'existing' WHEN p.path IS NULL THEN 'missing' ELSE 'upload' END AS status
  FROM s LEFT JOIN {_PATHS} p ON p.name = s.image_name
  LEFT JOIN a_store k ON k.key = concat('proj/images/', s.server_file)""")
def upload_plan(t: Tables) -> DataFrame:
    """Images of some labels, without those of the current dataset, plus deleted ones."""
    from boxmill.plans.partition import partition_annotations

    labels = [f"Brand#1{i}" for i in range(1, 6)] + ["<unknown>", "__no_annotation__"]
    fetched = t.dataset.unionByName(t.records.deleted.select(*t.dataset.columns))
    chosen, gone = R.upload_rows(fetched, labels)
    exclude = partition_annotations(t.history, t.deletions).where(F.col("part") == "dataset")
    images = R.upload_images(chosen, gone, exclude)
    return R.plan_upload(images, t.store, t.files, "proj/images", "2026-02")


@query(f"""SELECT b.image_name, b.task_id, b.frame_id, concat('proj/images/', coalesce(n.newest, b.image_name)) AS s3_path, p.path AS image_path
  FROM a_ann b LEFT JOIN (SELECT base, max(name) AS newest FROM a_store GROUP BY base) n ON n.base = b.image_name
  LEFT JOIN {_PATHS} p ON p.name = b.image_name""")
def enrich_paths(t: Tables) -> DataFrame:
    rows = t.history.select("image_name", "task_id", "frame_id")
    mapping = K.newest_object(t.store).select(F.col("base").alias("image_name"), F.col("name").alias("server_file"))
    return R.enrich_paths(rows, "proj/images", t.files, mapping)


@query("SELECT image_name, task_id, frame_id FROM a_ann WHERE image_name NOT IN (SELECT image_name FROM a_part WHERE part = 'in_progress')")
def exclude_in_progress(t: Tables) -> DataFrame:
    from boxmill.plans.partition import partition_annotations

    busy = partition_annotations(t.history, t.deletions).where(F.col("part") == "in_progress")
    return P.without_images(t.history.select("image_name", "task_id", "frame_id"), busy)


# --- pushing annotations back -------------------------------------------------
_PUSH = """SELECT b.task_id, b.instance_label, b.bbox_x_tl, b.bbox_y_tl, b.bbox_x_br, b.bbox_y_br, f.frame_id, l.label_id,
  CASE WHEN f.frame_id IS NULL THEN 'no_frame' WHEN l.label_id IS NULL THEN 'no_label' ELSE 'pushed' END AS status
  FROM (SELECT *, CASE WHEN bbox_y_tl > 45 THEN concat('gone_', image_name) ELSE image_name END AS wanted FROM a_boxes) b
  LEFT JOIN (SELECT task_id, image_name, coalesce(max(frame_id) FILTER (WHERE frame_id % 2 = 1), min(frame_id)) AS frame_id
    FROM a_frames GROUP BY task_id, image_name) f ON f.task_id = b.task_id AND f.image_name = b.wanted
  LEFT JOIN a_labels l ON l.label_name = b.instance_label"""


def _push_inputs(t: Tables):
    # even frames lie in a month folder, so they are found by base name
    frames = t.frames.withColumn(
        "name", F.when(F.col("frame_id") % 2 == 0, F.concat(F.lit("2024-01/"), "name")).otherwise(F.col("name"))
    )
    lost = F.concat(F.lit("gone_"), "image_name")
    rows = t.boxes.withColumn(
        "image_name", F.when(F.col("bbox_y_tl") > 45, lost).otherwise(F.col("image_name"))
    )
    return rows, frames


@query(f"SELECT task_id, frame_id, label_id, 'rectangle' AS type, bbox_x_tl AS x_tl, bbox_y_br AS y_br FROM ({_PUSH}) p WHERE status = 'pushed'")
def push_shapes(t: Tables) -> DataFrame:
    rows, frames = _push_inputs(t)
    shapes = B.to_shapes(rows, frames, t.labels)
    return shapes.select(
        "task_id", "frame_id", "label_id", "type",
        F.get("points", F.lit(0)).alias("x_tl"), F.get("points", F.lit(3)).alias("y_br"),
    )


@query(f"SELECT status, count(*) AS n_rows FROM ({_PUSH}) p GROUP BY status")
def push_counts(t: Tables) -> DataFrame:
    rows, frames = _push_inputs(t)
    return B.push_counts(B.match_shapes(rows, frames, t.labels))


@query("""SELECT task_id, frame_id FROM a_frames WHERE is_deleted = 1
  UNION SELECT f.task_id, f.frame_id FROM (SELECT task_id, image_name, max(frame_id) AS frame_id FROM a_frames GROUP BY 1, 2) f
  JOIN part p ON f.image_name = concat('img_', CAST(p.p_partkey AS VARCHAR), '.jpg') WHERE p.p_size > 45""")
def mark_deleted(t: Tables) -> DataFrame:
    names = t.raw("part").where("p_size > 45").select(
        F.concat(F.lit("img_"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image_name")
    )
    return B.mark_deleted(t.frames, t.deleted_frames, names)


@query("SELECT task_id, count(*) AS images, CAST(ceil(count(*) / 3.0) AS BIGINT) AS jobs FROM a_frames GROUP BY task_id")
def jobs(t: Tables) -> DataFrame:
    return R.jobs_per_task(t.frames, 3, ["task_id"])


@query("""SELECT image_name, CAST(floor((row_number() OVER (ORDER BY image_name) - 1) / 100) AS BIGINT) AS job
  FROM (SELECT DISTINCT image_name FROM a_ann) d""")
def job_numbers(t: Tables) -> DataFrame:
    return R.job_numbers(t.history.select("image_name").distinct(), ["image_name"], 100)
