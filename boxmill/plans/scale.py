"""Larger projects made of the tasks of a base project, for load tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.functions import folded
from boxmill.operators.ordered import number_rows
from boxmill.plans.extract import Snapshot
from boxmill.session import settle

# The task states of the annotation server.
STATUSES = ("backlog", "annotation", "validation", "completed")


# copies of one base task that are made together
COPIES_PER_PART = 10_000


def _choice(seed: int, salt: str, n):
    """Repeatable pseudo-random number below ``n`` for a position."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("pos")), n)


def scale_tasks(
    tasks: DataFrame,
    count: int,
    pick: str | list[int] = "random",
    seed: int = 0,
    id_start: int = 100,
    id_order: str = "asc",
    names: str | list[str] = "keep",
    statuses: str | list[str] = "keep",
    order: list[str] | None = None,
) -> DataFrame:
    """``count`` task rows copied from base tasks; ``base_task_id`` says from which.

    ``pick``: ``random``, ``cycle`` or a list of base positions.  ``names``:
    ``keep``, ``enumerated``, ``random`` (a suffix is added) or a list to cycle.
    ``statuses``: ``keep``, ``random`` or a list to cycle.  ``id_order``: ``asc``
    or ``random``.  Equal arguments give equal rows.
    """
    spark = tasks.sparkSession
    base = number_rows(tasks, order or ["task_id"], "base", start=0)
    n_base = tasks.count()
    if n_base == 0:
        raise ValueError("the base project has no tasks")
    if isinstance(pick, list):
        wrong = [i for i in pick if not 0 <= i < n_base]
        if wrong:
            raise ValueError(f"base positions out of range: {wrong}")
        slots = spark.createDataFrame(list(enumerate(pick)), "pos long, base long")
    else:
        slots = spark.range(count).withColumnRenamed("id", "pos")
        place = F.col("pos") % n_base if pick == "cycle" else _choice(seed, "base", F.lit(n_base))
        slots = slots.withColumn("base", place.cast("long"))
    if id_order == "random":
        slots = number_rows(
            slots.withColumn("_mix", F.xxhash64(F.lit(seed), F.lit("id"), F.col("pos"))),
            ["_mix", "pos"], "task_no", start=0,
        ).drop("_mix")
    else:
        slots = slots.withColumn("task_no", F.col("pos"))

    def cycled(values):
        options = F.array(*[F.lit(v) for v in values])
        return F.element_at(options, (F.col("pos") % len(values) + 1).cast("int"))

    if isinstance(names, list):
        name = cycled(names)
    elif names == "enumerated":
        name = F.concat(F.lit("task-"), F.col("pos").cast("string"))
    elif names == "random":
        tail = F.lower(F.lpad(F.hex(_choice(seed, "name", F.lit(65536))), 4, "0"))
        name = F.concat("task_name", F.lit("_"), tail)
    else:
        name = F.col("task_name")
    if isinstance(statuses, list):
        status = cycled(statuses)
    elif statuses == "random":
        status = F.element_at(
            F.array(*[F.lit(s) for s in STATUSES]),
            (_choice(seed, "status", F.lit(len(STATUSES))) + 1).cast("int"),
        )
    else:
        status = F.col("task_status")
    copied = slots.join(base, "base")
    return copied.select(
        (F.col("task_no") + F.lit(id_start)).cast("long").alias("task_id"),
        name.alias("task_name"), status.alias("task_status"), "subset", "task_updated_date",
        F.col("task_id").alias("base_task_id"), "pos",
    )


def base_positions(tasks: DataFrame, names: list[str], order: list[str] | None = None) -> list[int]:
    """Positions of base tasks by name (case and outer blanks do not count)."""
    numbered = number_rows(tasks, order or ["task_id"], "base", start=0)
    wanted = sorted({n.strip().casefold() for n in names})
    hits = (
        numbered.select(folded(F.trim("task_name")).alias("key"), "base")
        .where(F.col("key").isin(wanted))
        .groupBy("key").agg(F.min("base").alias("base"), F.count("*").alias("n"))
        .collect()
    )
    found = {r["key"]: r for r in hits}
    out = []
    for name in names:
        row = found.get(name.strip().casefold())
        if row is None or row["n"] > 1:
            raise ValueError(f"{'no' if row is None else 'more than one'} base task named {name!r}")
        out.append(row["base"])
    return out


def scale_project(snapshot: Snapshot, count: int, **options) -> Snapshot:
    """Whole snapshot of a scaled project: frames, deletions, shapes and tracks follow
    their base task."""
    tasks = scale_tasks(snapshot.tasks, count, **options)
    ids = settle(tasks.select(F.col("base_task_id").alias("_base"), F.col("task_id").alias("_new"), "pos"))
    copied = ids.groupBy("_base").agg(F.count("*").alias("_copies"))
    many = copied.where(F.col("_copies") > COPIES_PER_PART)
    # only tasks of very many copies are dealt to parts, so that no task emits all of them
    dealt = not many.isEmpty()
    if dealt:
        # at most copies / COPIES_PER_PART rows
        parts = many.select(
            F.col("_base").alias("_many"), F.ceil(F.col("_copies") / F.lit(COPIES_PER_PART)).alias("_parts")
        )
        part = F.coalesce(F.pmod(F.xxhash64("pos"), F.col("_parts")), F.lit(0))
        ids = ids.join(F.broadcast(parts), F.col("_base") == F.col("_many"), "left").select("_base", "_new", part.alias("_part"))

    def follow(rows: DataFrame) -> DataFrame:
        here = F.col("task_id") == F.col("_base")
        if dealt:
            known = rows.join(F.broadcast(parts), F.col("task_id") == F.col("_many"), "left")
            last = F.coalesce(F.col("_parts"), F.lit(1).cast("long")) - F.lit(1).cast("long")
            rows_of = known.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            joined = rows_of.join(ids, here & (F.col("_at") == F.col("_part")))
        else:
            joined = rows.join(ids, here)
        return joined.withColumn("task_id", F.col("_new")).select(*rows.columns)

    return Snapshot(
        tasks.drop("base_task_id", "pos"), follow(snapshot.frames), follow(snapshot.deleted),
        follow(snapshot.shapes), snapshot.labels,
        None if snapshot.tracks is None else follow(snapshot.tracks),
    )
