"""Partition of the annotation history."""

from pyspark.sql import DataFrame

from boxmill.adapters import Tables
from boxmill.plans import partition as P
from boxmill.registry import query


@query("SELECT image_name, is_gone = 1 AS is_gone, lt AS current_task FROM a_state")
def image_state(t: Tables) -> DataFrame:
    return P.image_state(t.history, t.deletions)


@query("SELECT image_name, task_id, frame_id, task_status, task_updated_date, part FROM a_part")
def partition(t: Tables) -> DataFrame:
    return P.partition_annotations(t.history, t.deletions)


@query("SELECT part, count(*) AS n_rows FROM a_part GROUP BY part")
def partition_counts(t: Tables) -> DataFrame:
    return P.partition_counts(P.partition_annotations(t.history, t.deletions))


GONE = """SELECT image_name, task_id, frame_id, task_status, task_updated_date FROM (
  SELECT d.image_name, d.task_id, d.frame_id, d.task_status, d.task_updated_date, row_number() OVER (
    PARTITION BY d.image_name ORDER BY try_cast(d.task_updated_date AS TIMESTAMP) DESC NULLS LAST, d.task_id, d.frame_id) AS rn
  FROM a_deleted d JOIN a_state s ON s.image_name = d.image_name WHERE s.is_gone = 1) q WHERE rn = 1"""


@query(GONE)
def partition_deleted(t: Tables) -> DataFrame:
    return P.deleted_images(t.history, t.deletions)


@query(f"""SELECT part, count(*) AS n_rows FROM a_part GROUP BY part
  UNION ALL SELECT 'deleted', count(*) FROM ({GONE}) g""")
def partition_summary(t: Tables) -> DataFrame:
    state = P.counted_state(t.history, t.deletions)
    parts = P.partition_annotations(t.history, t.deletions, state)
    return P.partition_summary(parts, P.deleted_images(t.history, t.deletions, state=state))
