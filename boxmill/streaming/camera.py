"""Camera frame events: drop, skip, number and summarise.

Columns: ``camera_no INT, frame_id BIGINT, ts TIMESTAMP, incomplete BOOLEAN,
write_dropped BOOLEAN``.
"""

from __future__ import annotations

import sys
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.window import Window

from boxmill.functions import frame_file_name
from boxmill.operators.ordered import number_rows, number_within, with_previous
from boxmill.session import settle

SUMMARY_SECONDS = 60
_PIECE = 4096  # intervals of a piece of a silent time


def complete_frames(events: DataFrame) -> DataFrame:
    return events.where(~F.col("incomplete"))


def skip_repeats(events: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Batch: drop a complete frame whose id equals that of the complete frame
    just before it on the same camera."""
    frames = complete_frames(events)
    before = with_previous(frames, ["camera_no"], order or ["ts", "frame_id"], "frame_id", "_before")
    repeat = F.coalesce(F.col("frame_id") == F.col("_before"), F.lit(False))
    return before.where(~repeat).drop("_before")


class _InOrder(StatefulProcessor):
    """Frames of a camera in the order of their times, without direct repeats.

    Frames wait in a buffer until the watermark has passed them, so none can come before them any more.  A timer at the
    time of the first one that waits lets go those that are due, even if the camera sends nothing further.  Only the
    frames of the watermark delay wait, and the id of the last frame that was let go stays.
    """

    def __init__(self, columns: list[str], layout: T.StructType, order: list[str]):
        self.columns, self.layout, self.order = columns, layout, order

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.layout)
        self.last = handle.getValueState("last", "frame_id long")

    def handleInputRows(self, key, rows, timerValues):
        found = [tuple(r[c] for c in self.columns) for r in rows]
        self.waiting.appendList(found)
        self._wake(found, after=-1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due, rest = [], []
        limit = timerValues.getCurrentWatermarkInMs()
        at = self.columns.index("ts")
        for row in (tuple(r) for r in self.waiting.get()):
            (due if _millis(row[at]) < limit else rest).append(row)
        self.waiting.clear()
        if rest:
            self.waiting.appendList(rest)
            self._wake(rest, after=limit)
        return self._let_go(due)

    def _wake(self, rows, after: int) -> None:
        """See to a timer for the first of the rows; those up to ``after`` are being handled."""
        at = self.columns.index("ts")
        first = min(_millis(r[at]) for r in rows) + 1
        if not any(after < timer <= first for timer in list(self.handle.listTimers())):
            self.handle.registerTimer(first)

    def _let_go(self, due):
        frame, places = self.columns.index("frame_id"), [self.columns.index(c) for c in self.order]
        held = self.last.get()
        seen, before = held is not None, held[0] if held is not None else None
        shape = Row(*self.columns)
        for row in sorted(due, key=lambda r: [(r[k] is not None, r[k]) for k in places]):
            if not seen or row[frame] is None or row[frame] != before:
                yield shape(*row)
            seen, before = True, row[frame]
        if due:
            self.last.update((before,))

    def close(self) -> None:
        pass


def _millis(ts) -> int:
    """Milliseconds of a time, as Spark hands it to Python (without a zone: in the local one)."""
    whole = ts.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return whole // timedelta(milliseconds=1)


def _ship() -> None:
    # workers get these classes by value; the package need not be installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def skip_repeats_stream(events: DataFrame, delay: str = "1 minute", order: list[str] | None = None) -> DataFrame:
    """Stream: the rows of ``skip_repeats``, each when the watermark has passed it (append mode).

    Frames may come in any order within ``delay``; later ones are dropped, as by any watermark.  Rows with NULL ts take no
    part.  Needs the RocksDB state store, which ``build_session`` sets.
    """
    _ship()
    frames = complete_frames(events).where("ts is not null").withWatermark("ts", delay)
    processor = _InOrder(frames.columns, _without_metadata(frames.schema), order or ["ts", "frame_id"])
    return frames.groupBy("camera_no").transformWithState(
        statefulProcessor=processor, outputStructType=_without_metadata(frames.schema), outputMode="Append", timeMode="EventTime"
    )


def _without_metadata(layout: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in layout])


def sequence_frames(frames: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Batch: running number per camera from 0 and the file name of every frame."""
    numbered = number_within(frames, ["camera_no"], order or ["ts", "frame_id"], "seq", start=0)
    return numbered.withColumn("file_name", frame_file_name("camera_no", "seq", "ts"))


def start_sequencing(
    frames: DataFrame, folder: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Stream: the same numbers, going on from batch to batch.

    Every micro-batch is numbered like a table, so a busy camera is spread over
    tasks; only the total per camera is carried on.  Batches write below their
    number (``frames/batch=N``, ``totals/batch=N``), so a repeated batch gives the
    same files; a batch reads the totals of the one before it and nothing older.
    """
    spark = frames.sparkSession
    rows_at, totals_at = f"{folder}/frames", f"{folder}/totals"
    totals_layout = "camera_no int, total long"

    def number(batch: DataFrame, n: int) -> None:
        own = settle(batch.select("camera_no", "frame_id", "ts"))
        if n == 0:
            before = spark.createDataFrame([], totals_layout)
        else:
            before = spark.read.schema(totals_layout).parquet(f"{totals_at}/batch={n - 1}")
        counts = own.groupBy("camera_no").agg(F.count("*").alias("total"))
        counts.unionByName(before).groupBy("camera_no").agg(F.sum("total").alias("total")).write.mode(
            "overwrite"
        ).parquet(f"{totals_at}/batch={n}")
        before = before.withColumnRenamed("total", "_before")
        numbered = number_within(own, ["camera_no"], ["ts", "frame_id"], "seq", start=0)
        placed = numbered.join(before, "camera_no", "left").withColumn(
            "seq", F.col("seq") + F.coalesce("_before", F.lit(0))
        ).drop("_before")
        placed.withColumn("file_name", frame_file_name("camera_no", "seq", "ts")).write.mode(
            "overwrite"
        ).parquet(f"{rows_at}/batch={n}")

    writer = frames.writeStream.foreachBatch(number).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _counts() -> list[Column]:
    return [
        F.count_if(~F.col("incomplete")).alias("frames"),
        F.count_if("incomplete").alias("grab_errors"),
        F.count_if(~F.col("incomplete") & F.col("write_dropped")).alias("write_drops"),
    ]


def camera_summary(events: DataFrame, seconds: int = SUMMARY_SECONDS) -> DataFrame:
    """Per camera and interval: frames, mean fps, grab errors, write drops.

    Works on batch and streaming input; set a watermark on a stream.  A frame
    whose write was dropped still counts as a frame.
    """
    grouped = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "camera_no").agg(*_counts())
    return grouped.select(
        F.col("w.start").alias("start"), "camera_no", "frames",
        (F.col("frames") / F.lit(float(seconds))).alias("mean_fps"),
        "grab_errors", "write_drops",
    )


def with_silent_intervals(summary: DataFrame, seconds: int = SUMMARY_SECONDS, until: datetime | None = None) -> DataFrame:
    """Batch: also a row of zeros for every interval without events between a camera's first and last one.

    With ``until``, up to the last interval that ends by then, for all cameras: what a live summary has shown.  Intervals
    are made a few thousand at a time, however long a camera was silent.
    """
    last = F.max("start")
    if until is not None:
        # intervals are counted from the epoch
        ended = F.floor(F.unix_timestamp(F.lit(until).cast("timestamp")) / seconds) * seconds - seconds
        last = F.greatest(last, F.timestamp_seconds(ended))
    spans = summary.groupBy("camera_no").agg(F.min("start").alias("low"), last.alias("high"))
    piece = F.expr(f"INTERVAL {int(seconds) * (_PIECE - 1)} SECOND")
    pieces = spans.select("camera_no", "high", F.explode(F.sequence("low", "high", F.expr(f"INTERVAL {int(seconds) * _PIECE} SECOND"))).alias("low"))
    every = F.sequence(F.col("low"), F.least(F.col("high"), F.col("low") + piece), F.expr(f"INTERVAL {int(seconds)} SECOND"))
    starts = pieces.select("camera_no", F.explode(every).alias("start"))
    filled = starts.join(summary, ["camera_no", "start"], "left")
    counts = [c for c in summary.columns if c not in ("camera_no", "start")]
    return filled.select(
        "start", "camera_no", *[F.coalesce(c, F.lit(0).cast(dict(summary.dtypes)[c])).alias(c) for c in counts]
    )


_INTERVAL = Row("second", "camera_no", "frames", "mean_fps", "grab_errors", "write_drops", "total_frames")


class _Intervals(StatefulProcessor):
    """Intervals of a camera without gaps, and its frames so far.

    The state is the end of the last interval shown and the total.  An interval that comes in shows the silent ones before
    it first, one after another; a timer at the end of the next one shows it as silent if nothing came.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "until long, total long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.shown.get()
        until, total = (held[0], held[1]) if held is not None else (None, 0)
        for r in sorted(rows, key=lambda r: r["second"]):
            if until is not None:
                yield from self._silent(key, until, r["second"], total)
            total += r["frames"]
            until = r["second"] + self.seconds
            yield _INTERVAL(r["second"], *key, r["frames"], r["mean_fps"], r["grab_errors"], r["write_drops"], total)
        self._keep(until, total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until, total = self.shown.get()
        ended = timerValues.getCurrentWatermarkInMs() // 1000 // self.seconds * self.seconds
        yield from self._silent(key, until, ended, total)
        self._keep(max(until, ended), total)

    def _silent(self, key, low: int, high: int, total: int):
        for second in range(low, high, self.seconds):
            yield _INTERVAL(second, *key, 0, 0.0, 0, 0, total)

    def _keep(self, until: int, total: int) -> None:
        self.shown.update((until, total))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((until + self.seconds) * 1000)

    def close(self) -> None:
        pass


def _closed_intervals(events: DataFrame, seconds: int, delay: str) -> DataFrame:
    """Stream: ``camera_summary`` with its window, each interval once, when the watermark has passed it."""
    timed = events.where("ts is not null").withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "camera_no").agg(*_counts())


def live_summary(events: DataFrame, seconds: int = SUMMARY_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Stream (append mode): start, camera_no, frames, mean_fps, grab_errors, write_drops, total_frames.

    One row per camera and interval once the watermark has passed it, also for intervals without events after a camera's
    first one: ``running_totals(with_silent_intervals(...))`` up to the watermark.  Frames are counted in the JVM; what
    keeps state in Python sees a row per camera and interval.  Needs the RocksDB state store.
    """
    _ship()
    closed = _closed_intervals(events, seconds, delay).select(
        F.unix_timestamp(F.col("w.start")).alias("second"), F.window_time("w").alias("at"), "camera_no", "frames",
        (F.col("frames") / F.lit(float(seconds))).alias("mean_fps"), "grab_errors", "write_drops",
    )
    camera = closed.schema["camera_no"].dataType.simpleString()
    layout = f"second long, camera_no {camera}, frames long, mean_fps double, grab_errors long, write_drops long, total_frames long"
    shown = closed.groupBy("camera_no").transformWithState(
        statefulProcessor=_Intervals(seconds), outputStructType=layout, outputMode="Append", timeMode="EventTime"
    )
    return shown.select(F.timestamp_seconds("second").alias("start"), *[c for c in shown.columns if c != "second"])


def running_totals(summary: DataFrame) -> DataFrame:
    """Batch: frames of every camera up to and including each interval.

    The window runs over the summary, which grows with the hours of recording and
    not with the frames.
    """
    so_far = Window.partitionBy("camera_no").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return summary.withColumn("total_frames", F.sum("frames").over(so_far))


def all_camera_totals(summary: DataFrame, seconds: int = SUMMARY_SECONDS) -> DataFrame:
    """Per interval over all cameras: frames, fps, errors (grab errors and drops)."""
    return summary.groupBy("start").agg(
        F.sum("frames").alias("frames"),
        (F.sum("frames") / F.lit(float(seconds))).alias("fps"),
        F.sum(F.col("grab_errors") + F.col("write_drops")).alias("errors"),
    )


def totals_stream(events: DataFrame, seconds: int = SUMMARY_SECONDS) -> DataFrame:
    """Stream: totals over all cameras straight from the events, with one state per
    interval instead of a second aggregate over the summary."""
    return events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count_if(~F.col("incomplete")).alias("frames"),
        (F.count_if(~F.col("incomplete")) / F.lit(float(seconds))).alias("fps"),
        F.count_if(F.col("incomplete") | F.col("write_dropped")).alias("errors"),
    ).select(F.col("w.start").alias("start"), "frames", "fps", "errors")


def live_totals(events: DataFrame, seconds: int = SUMMARY_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Stream (append mode): ``all_camera_totals`` as a second aggregate over the intervals of the cameras."""
    closed = _closed_intervals(events, seconds, delay)
    totals = closed.groupBy(F.window(F.window_time("w"), f"{seconds} seconds").alias("t")).agg(
        F.sum("frames").alias("frames"), F.sum(F.col("grab_errors") + F.col("write_drops")).alias("errors")
    )
    return totals.select(
        F.col("t.start").alias("start"), "frames", (F.col("frames") / F.lit(float(seconds))).alias("fps"), "errors"
    )


def running_totals_stream(events: DataFrame) -> DataFrame:
    """Stream: frames and errors of every camera since the start (update or complete
    mode); the state is one row per camera."""
    return events.groupBy("camera_no").agg(
        F.count_if(~F.col("incomplete")).alias("total_frames"),
        F.count_if("incomplete").alias("total_grab_errors"),
        F.count_if(~F.col("incomplete") & F.col("write_dropped")).alias("total_write_drops"),
    )


def camera_numbers(devices: DataFrame, address: str = "ip") -> DataFrame:
    """``camera_no`` from 0 in the order of the address text."""
    return number_rows(devices, [address], "camera_no", start=0)
