"""Tables that go through files and come back."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.adapters import Tables
from boxmill.plans import partition as P
from boxmill.registry import query
from boxmill.registry.partition import GONE
from boxmill.session import scratch_root
from boxmill.sinks import tables as W
from boxmill.sources import tables as R


def _folder(t: Tables, name: str) -> str:
    return f"{scratch_root(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CORNERS = ["bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br"]


@query("""SELECT image_name, instance_shape, concat(instance_label, chr(10), '"', subset, '", ü') AS instance_label,
  bbox_x_tl, bbox_y_tl, bbox_x_br, bbox_y_br, task_id, frame_id, task_updated_date, '{}' AS attributes FROM a_boxes
  UNION ALL SELECT image_name, 'none', NULL, NULL, NULL, NULL, NULL, task_id, frame_id, task_updated_date, '{}' FROM a_none""")
def csv_round_trip(t: Tables) -> DataFrame:
    """The dataset as CSV, with line breaks, quotes and commas in its labels -> files -> dataset."""
    folder = _folder(t, "csv")
    label = F.concat("instance_label", F.lit('\n"'), "subset", F.lit('", ü'))
    W.write_table(t.dataset.withColumn("instance_label", label), folder, "csv")
    back = R.read_dataset_csv(t.spark, folder, R.MERGE_COLUMNS, require_time=True)
    return W.as_text_table(back).select(
        "image_name", "instance_shape", "instance_label", *_CORNERS, "task_id", "frame_id", "task_updated_date", "attributes"
    )


@query(f"""SELECT image_name, task_id, frame_id, task_status, part AS output FROM a_part
  UNION ALL SELECT image_name, task_id, frame_id, task_status, 'deleted' FROM ({GONE}) g""")
def four_outputs(t: Tables) -> DataFrame:
    """Partition -> four folders of CSV -> rows with the name of their folder."""
    folder = _folder(t, "outputs")
    state = P.counted_state(t.history, t.deletions)
    parts = P.partition_annotations(t.history, t.deletions, state)
    W.write_parts_separately(parts, P.deleted_images(t.history, t.deletions, state=state), folder)
    out = None
    for name in (P.DATASET, P.OBSOLETE, P.IN_PROGRESS, "deleted"):
        rows = R.read_dataset_csv(t.spark, f"{folder}/{name}")
        rows = rows.select("image_name", "task_id", "frame_id", "task_status", F.lit(name).alias("output"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT image_name, 'csv' AS form FROM a_del_names UNION ALL SELECT image_name, 'text' FROM a_del_names
  UNION ALL SELECT image_name, 'in progress' FROM a_del_names""")
def deletion_list(t: Tables) -> DataFrame:
    """Names with repeats -> CSV and plain text -> distinct names."""
    names = t.merge_deletions.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    table, text = _folder(t, "names"), _folder(t, "names")
    names.write.option("header", True).csv(table)
    names.select(F.concat(F.lit("  "), "image_name", F.lit("\t"))).write.text(text)
    read = [(R.read_deletion_names, table, "csv"), (R.read_deletion_names, text, "text"), (R.read_exclusion_names, table, "in progress")]
    out = [how(t.spark, place).withColumn("form", F.lit(form)) for how, place, form in read]
    return out[0].unionByName(out[1]).unionByName(out[2])
