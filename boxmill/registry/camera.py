"""Camera events, batch twins of the streaming jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.adapters import Tables
from boxmill.registry import query
from boxmill.streaming import camera as C


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT strftime(g.start, '%Y-%m-%d %H:%M:%S') AS start, g.camera_no, coalesce(frames, 0) AS frames,
  coalesce(frames, 0) / 60.0::DOUBLE AS mean_fps, coalesce(grab_errors, 0) AS grab_errors, coalesce(write_drops, 0) AS write_drops
  FROM (SELECT camera_no, unnest(generate_series(min(start), max(start), INTERVAL 1 MINUTE)) AS start FROM a_minutes GROUP BY 1) g
  LEFT JOIN a_minutes m ON m.camera_no = g.camera_no AND m.start = g.start""")
def camera_minutes(t: Tables) -> DataFrame:
    return _text(C.with_silent_intervals(C.camera_summary(t.camera)))


@query("""SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, camera_no, frames,
  CAST(sum(frames) OVER (PARTITION BY camera_no ORDER BY start) AS BIGINT) AS total_frames FROM a_minutes""")
def camera_running(t: Tables) -> DataFrame:
    rows = C.running_totals(C.camera_summary(t.camera))
    return _text(rows).select("start", "camera_no", "frames", "total_frames")


@query("""SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, CAST(sum(frames) AS BIGINT) AS frames,
  CAST(sum(frames) AS BIGINT) / 60.0::DOUBLE AS fps, CAST(sum(grab_errors + write_drops) AS BIGINT) AS errors
  FROM a_minutes GROUP BY 1""")
def camera_totals(t: Tables) -> DataFrame:
    return _text(C.all_camera_totals(C.camera_summary(t.camera)))


@query("""SELECT camera_no, frame_id, event FROM (SELECT camera_no, frame_id, event,
  lag(frame_id) OVER (PARTITION BY camera_no ORDER BY ts, event) AS before FROM a_repeats WHERE NOT incomplete) q
  WHERE before IS NULL OR before <> frame_id""")
def camera_dedup(t: Tables) -> DataFrame:
    return C.skip_repeats(t.camera_repeats, ["ts", "event"]).select("camera_no", "frame_id", "event")


@query("""SELECT camera_no, frame_id, seq, concat('cam', CAST(camera_no AS VARCHAR), '_', lpad(CAST(seq AS VARCHAR), 6, '0'), '_',
  strftime(ts, '%Y%m%dT%H%M%S_%f'), '.jpg') AS file_name FROM (SELECT camera_no, frame_id, ts,
  row_number() OVER (PARTITION BY camera_no ORDER BY ts, frame_id) - 1 AS seq FROM a_camera WHERE NOT incomplete) q""")
def camera_sequence(t: Tables) -> DataFrame:
    rows = C.sequence_frames(C.complete_frames(t.camera))
    return rows.select("camera_no", "frame_id", "seq", "file_name")


@query("""SELECT ip, row_number() OVER (ORDER BY ip) - 1 AS camera_no FROM (
  SELECT concat('10.0.', CAST(s_nationkey AS VARCHAR), '.', CAST(s_suppkey AS VARCHAR)) AS ip FROM supplier) d""")
def camera_numbers(t: Tables) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    ip = F.concat(F.lit("10.0."), text("s_nationkey"), F.lit("."), text("s_suppkey"))
    return C.camera_numbers(t.raw("supplier").select(ip.alias("ip")))
