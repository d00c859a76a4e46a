"""Choosing projects, tasks and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.functions import folded
from boxmill.operators.pick import first_per_key
from boxmill.operators.skew import lookup_join


def rectangles(shapes: DataFrame, type_column: str = "type") -> DataFrame:
    return shapes.where(F.col(type_column) == S.RECTANGLE)


def skipped_shapes(shapes: DataFrame, type_column: str = "type") -> DataFrame:
    """Number of shapes per unsupported type."""
    others = F.coalesce(F.col(type_column) != S.RECTANGLE, F.lit(True))
    return shapes.where(others).groupBy(type_column).agg(F.count("*").alias("shapes"))


def drop_ignored(tasks: DataFrame, ignored: DataFrame) -> DataFrame:
    ids = ignored.select(F.col("id").alias("task_id")).distinct()
    return tasks.join(ids, "task_id", "left_anti")


def ignored_report(tasks: DataFrame, ignored: DataFrame) -> DataFrame:
    """Ignored tasks to tell the user about: all but the silent ones.

    A task that any entry marks silent stays silent.
    """
    ids = ignored.groupBy(F.col("id").alias("task_id")).agg(
        F.max(F.coalesce("silent", F.lit(False))).alias("_silent")
    )
    loud = ids.where(~F.col("_silent")).select("task_id")
    return tasks.join(loud, "task_id", "left_semi")


def completed(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("task_status") == S.COMPLETED)


def _resolve(
    table: DataFrame, selectors: list, id_column: str, name_column: str, order: list[str]
) -> list[tuple[int, object, int | None]]:
    """(position, selector, id found) per selector; the result is as long as the
    user's list of selectors, whatever the size of the table."""
    spark = table.sparkSession
    wanted = spark.createDataFrame(
        [(i, str(s).strip()) for i, s in enumerate(selectors)], "pos int, sel string"
    ).withColumn("sel_id", F.when(F.rlike("sel", F.lit(r"^\d+$")), F.col("sel").try_cast("long")))
    narrow = table.select(F.col(id_column).alias("_id"), F.col(name_column).alias("_name"),
                          F.struct(*[F.col(o) for o in order]).alias("_at"))
    hit_id = F.col("_id") == F.col("sel_id")
    hit_name = folded("_name") == folded("sel")
    # two equi-joins against the user's own list
    by_id = narrow.join(F.broadcast(wanted), hit_id).select("pos", F.lit(0).alias("rank"), "_id", "_at")
    by_name = narrow.join(F.broadcast(wanted), hit_name).select("pos", F.lit(1).alias("rank"), "_id", "_at")
    best = by_id.unionByName(by_name).groupBy("pos").agg(
        F.min_by("_id", F.struct("rank", "_at")).alias("id")
    )
    found = {r["pos"]: r["id"] for r in best.collect()}
    return [(i, s, found.get(i)) for i, s in enumerate(selectors)]


def select_tasks(tasks: DataFrame, selectors: list, order: list[str] | None = None) -> DataFrame:
    """Tasks named by id or, ignoring case, by name; ``pick`` keeps selector order.

    Digits are tried as an id first.  Of several tasks with one name the first in
    ``order`` counts.  A selector without a task is an error.
    """
    rows = _resolve(tasks, list(selectors), "task_id", "task_name", order or ["task_id"])
    missing = [s for _, s, found in rows if found is None]
    if missing:
        known = [f"{r['task_name']!r} (id={r['task_id']})" for r in tasks.select("task_id", "task_name").take(10)]
        raise LookupError(f"no task for {missing!r}; for example there are: {', '.join(known)}")
    places: dict[int, int] = {}
    for i, _, found in rows:
        places.setdefault(found, i)
    chosen = tasks.sparkSession.createDataFrame(
        [(t, i) for t, i in places.items()], "task_id long, pick int"
    )
    # the literal list reaches the scan; the join only adds the order
    return tasks.where(F.col("task_id").isin(list(places))).join(F.broadcast(chosen), "task_id")


def find_project(projects: DataFrame, selector: int | str, order: list[str] | None = None) -> int:
    """Project id: digits are taken as the id itself, else the name decides."""
    text = str(selector).strip()
    if text.isdigit():
        return int(text)
    [(_, _, found)] = _resolve(projects, [text], "id", "name", order or ["id"])
    if found is None:
        raise LookupError(f"no project named {text!r}")
    return found


def usable_shapes(rows: DataFrame) -> DataFrame:
    """Box and none rows only."""
    return rows.where(F.col("instance_shape").isin(S.BOX, S.NONE))


def complete_boxes(rows: DataFrame) -> DataFrame:
    """Rows with a label and all four corners."""
    return rows.dropna(
        subset=["instance_label", "bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br"]
    )


def split_deleted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(other rows, deleted rows); a table without shapes has no deleted rows."""
    if "instance_shape" not in rows.columns:
        return rows, rows.where(F.lit(False))
    gone = F.coalesce(F.col("instance_shape") == S.DELETED, F.lit(False))
    return rows.where(~gone), rows.where(gone)


def label_candidates(rows: DataFrame) -> DataFrame:
    """Labels that can be chosen, with the bucket of rows without a label."""
    return rows.groupBy(
        F.coalesce("instance_label", F.lit(S.NO_ANNOTATION)).alias("choice")
    ).agg(F.count("*").alias("n_rows"))


def with_labels(rows: DataFrame, choices: list[str]) -> DataFrame:
    """Rows of the chosen labels; ``__no_annotation__`` stands for a missing label."""
    real = [c for c in choices if c != S.NO_ANNOTATION]
    keep = F.col("instance_label").isin(real) if real else F.lit(False)
    if S.NO_ANNOTATION in choices:
        keep = keep | F.col("instance_label").isNull()
    return rows.where(keep)


def without_images(rows: DataFrame, names: DataFrame) -> DataFrame:
    return lookup_join(rows, names.select("image_name").distinct(), ["image_name"], "left_anti")


def images_without_split(rows: DataFrame) -> DataFrame:
    """Images with a row lacking a split."""
    lacking = F.coalesce(F.col("split"), F.lit("")) == ""
    return rows.where(lacking).select("image_name").distinct()


def check_splits(rows: DataFrame) -> DataFrame:
    """The rows; raises with a count and up to ten names when a split is missing."""
    bad = images_without_split(rows)
    count = bad.count()
    if count:
        names = [r[0] for r in bad.orderBy("image_name").limit(10).collect()]
        raise ValueError(f"{count} images have no split, such as: {', '.join(map(str, names))}")
    return rows


def project_names(projects: DataFrame, ignored: DataFrame) -> DataFrame:
    """Names known from the project table or the ignore list."""
    return projects.select("name").union(ignored.select("project")).distinct()


def ignored_counts(ignored: DataFrame) -> DataFrame:
    """Ignored tasks per project, and in total (project NULL)."""
    return ignored.rollup("project").agg(F.count("*").alias("tasks"))


def ignore_tasks(ignored: DataFrame, entries: DataFrame) -> DataFrame:
    """Add entries unless their task is listed for the project already."""
    fresh = entries.join(ignored.select("project", "id"), ["project", "id"], "left_anti")
    return ignored.unionByName(
        first_per_key(fresh, ["project", "id"], ["name", "description", "silent"])
    )


def unignore_tasks(ignored: DataFrame, entries: DataFrame) -> DataFrame:
    return ignored.join(entries.select("project", "id"), ["project", "id"], "left_anti")
