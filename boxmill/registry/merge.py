"""Merging two dataset versions."""

from pyspark.sql import DataFrame

from boxmill.adapters import Tables
from boxmill.plans import merge as M
from boxmill.registry import query

_COLUMNS = """image_name, instance_shape, instance_label, bbox_x_tl, bbox_y_tl, bbox_x_br, bbox_y_br,
  task_id, frame_id, task_status, task_updated_date, subset"""
_ORDER = ["task_id", "frame_id"]


def _winners(condition: str) -> str:
    """Per-image decision by outer join; ``condition`` is when old keeps a shared image."""
    return f"""SELECT coalesce(o.image_name, n.image_name) AS image_name, o.image_name IS NOT NULL AS in_old,
   n.image_name IS NOT NULL AS in_new, coalesce(o.cnt, 0) AS old_rows, coalesce(n.cnt, 0) AS new_rows,
   d.image_name IS NOT NULL AS listed, o.split AS old_split, coalesce(n.has_split, false) AS new_has_split,
   CASE WHEN d.image_name IS NOT NULL THEN NULL WHEN n.image_name IS NULL THEN 'old'
        WHEN o.image_name IS NULL THEN 'new' WHEN {condition} THEN 'old' ELSE 'new' END AS winner
   FROM (SELECT a.image_name, count(*) AS cnt, max(try_cast(a.task_updated_date AS TIMESTAMP)) AS ts, min(f.split) AS split
     FROM a_old a LEFT JOIN (SELECT image_name, split FROM (SELECT image_name, split, row_number() OVER (
       PARTITION BY image_name ORDER BY task_id, frame_id) AS rn FROM a_old WHERE split IS NOT NULL) q WHERE rn = 1) f
     ON f.image_name = a.image_name GROUP BY a.image_name) o
   FULL OUTER JOIN (SELECT image_name, count(*) AS cnt, max(try_cast(task_updated_date AS TIMESTAMP)) AS ts,
     bool_or(split IS NOT NULL) AS has_split FROM a_new GROUP BY image_name) n ON n.image_name = o.image_name
   LEFT JOIN a_del_names d ON d.image_name = coalesce(o.image_name, n.image_name)"""


def _merged(condition: str) -> str:
    return f"""WITH w AS ({_winners(condition)})
  SELECT {_COLUMNS.replace('image_name', 'r.image_name')}, coalesce(r.split, w.old_split) AS split
  FROM (SELECT *, 'old' AS side FROM a_old UNION ALL SELECT *, 'new' AS side FROM a_new) r
  JOIN w ON w.image_name = r.image_name AND w.winner = r.side"""


def _summary(condition: str) -> str:
    return f"""WITH w AS ({_winners(condition)})
  SELECT count(*) FILTER (WHERE NOT listed AND NOT in_new) AS only_old,
  count(*) FILTER (WHERE NOT listed AND NOT in_old) AS only_new,
  count(*) FILTER (WHERE in_old AND in_new AND winner = 'new') AS conflict_new,
  count(*) FILTER (WHERE in_old AND in_new AND winner = 'old') AS conflict_old,
  count(*) FILTER (WHERE listed) AS deleted,
  CAST(sum(CASE winner WHEN 'old' THEN old_rows WHEN 'new' THEN new_rows ELSE 0 END) AS BIGINT) AS total_rows,
  count(*) FILTER (WHERE in_old AND in_new AND old_split IS NOT NULL AND new_has_split) AS split_conflicts FROM w"""


@query(_merged("false"))
def merge_new_wins(t: Tables) -> DataFrame:
    return M.merge_datasets(t.old_version, t.new_version, t.merge_deletions, order=_ORDER)


@query(_merged("o.ts > n.ts"))
def merge_by_time(t: Tables) -> DataFrame:
    return M.merge_datasets(t.old_version, t.new_version, t.merge_deletions, by_time=True, order=_ORDER)


@query(_summary("false"))
def merge_summary(t: Tables) -> DataFrame:
    return M.merge_summary(M.image_winners(t.old_version, t.new_version, t.merge_deletions, order=_ORDER))


@query(_summary("o.ts > n.ts"))
def merge_summary_by_time(t: Tables) -> DataFrame:
    winners = M.image_winners(t.old_version, t.new_version, t.merge_deletions, by_time=True, order=_ORDER)
    return M.merge_summary(winners)
