import pytest
from conftest import rows

from boxmill.plans.partition import (
    deleted_images,
    image_state,
    partition_annotations,
    partition_summary,
)

ANN = "image_name string, task_id long, task_updated_date string, task_status string"
DEL = "image_name string, task_id long, task_updated_date string, frame_id int"


def run(spark, annotations, deleted=()):
    a, d = spark.createDataFrame(list(annotations), ANN), spark.createDataFrame(list(deleted), DEL)
    parts = partition_annotations(a, d)
    assert parts.count() == len(annotations)
    return (
        rows(parts, "image_name", "task_id", "part"),
        rows(deleted_images(a, d), "image_name", "task_id", "frame_id"),
    )


C, A = "completed", "annotation"


@pytest.mark.parametrize("annotations, deleted, parts, gone", [
    # one completed task
    ([("a", 1, "2026-01-01", C)], [], [("a", 1, "dataset")], []),
    # unfinished
    ([("a", 1, "2026-01-01", A)], [], [("a", 1, "in_progress")], []),
    # the later completed task counts
    ([("a", 1, "2026-01-01", C), ("a", 2, "2026-01-02", C)], [], [("a", 1, "obsolete"), ("a", 2, "dataset")], []),
    # a later unfinished task does not replace the dataset
    ([("a", 1, "2026-01-01", C), ("a", 2, "2026-01-02", A)], [], [("a", 1, "dataset"), ("a", 2, "in_progress")], []),
    # deleted later: everything is obsolete, also what is in progress
    ([("a", 1, "2026-01-01", C), ("a", 2, "2026-01-02", A)], [("a", 3, "2026-01-03", 5)],
     [("a", 1, "obsolete"), ("a", 2, "obsolete")], [("a", 3, 5)]),
    # restored after the deletion
    ([("a", 4, "2026-01-04", C)], [("a", 3, "2026-01-03", 5)], [("a", 4, "dataset")], []),
    # equal dates: the deletion wins
    ([("a", 1, "2026-01-03", C)], [("a", 3, "2026-01-03", 5)], [("a", 1, "obsolete")], [("a", 3, 5)]),
    # deletion without any annotation, also when there are none at all
    ([], [("b", 3, "2026-01-03", 1)], [], [("b", 3, 1)]),
    # several deletions: the latest task, its first record
    ([], [("b", 3, "2026-01-03", 1), ("b", 4, "2026-01-04", 9), ("b", 4, "2026-01-04", 2)], [], [("b", 4, 2)]),
    # equal dates among deletions: the first listed
    ([], [("b", 6, "2026-01-03", 1), ("b", 4, "2026-01-03", 9)], [], [("b", 4, 9)]),
    # offsets are compared as instants
    ([("a", 1, "2026-01-01T10:00:00+03:00", C), ("a", 2, "2026-01-01T08:00:00Z", C)], [],
     [("a", 1, "obsolete"), ("a", 2, "dataset")], []),
    # mixed precision
    ([("a", 1, "2026-01-01T10:00:00.250000Z", C), ("a", 2, "2026-01-01T10:00:00Z", C)], [],
     [("a", 1, "dataset"), ("a", 2, "obsolete")], []),
    # unreadable dates come first; a deletion still wins among them
    ([("a", 1, "junk", C), ("a", 2, "2020-01-01", C)], [], [("a", 1, "obsolete"), ("a", 2, "dataset")], []),
    ([("a", 1, "junk", C)], [("a", 2, "", 0)], [("a", 1, "obsolete")], [("a", 2, 0)]),
    ([("a", 1, "2020-01-01", C)], [("a", 2, "", 0)], [("a", 1, "dataset")], []),
    # equal dates of completed tasks: the highest id
    ([("a", 1, "2026-01-01", C), ("a", 2, "2026-01-01", C)], [], [("a", 1, "obsolete"), ("a", 2, "dataset")], []),
    # all rows of the current task
    ([("a", 1, "2026-01-01", C)] * 3, [], [("a", 1, "dataset")] * 3, []),
])
def test_rules(spark, annotations, deleted, parts, gone):
    assert run(spark, annotations, deleted) == (parts, gone)


def test_against_a_plain_reading_of_the_rules(spark):
    """Random history with one image holding a third of all rows."""
    import random

    rng = random.Random(5)
    names = ["hot"] * 10 + [f"i{k}" for k in range(20)]
    dates = ["", "x", *[f"2026-01-{d:02d}" for d in range(1, 9)]]
    task = {t: (rng.choice(dates), rng.choice([C, A])) for t in range(40)}
    ann = [(rng.choice(names), t, *task[t]) for t in rng.choices(range(40), k=600)]
    gone = [(rng.choice(names), t, task[t][0], rng.randrange(9)) for t in rng.choices(range(40), k=25)]
    gone = sorted(set(gone), key=lambda g: (g[1], g[3]))

    when = lambda d: d if d[:1] == "2" else ""
    expected = []
    for name, t, d, status in ann:
        a = max(when(x[2]) for x in ann if x[0] == name)
        b = [when(x[2]) for x in gone if x[0] == name]
        if b and max(b) >= a:
            part = "obsolete"
        elif status != C:
            part = "in_progress"
        else:
            best = max((when(x[2]), x[1]) for x in ann if x[0] == name and x[3] == C)[1]
            part = "dataset" if t == best else "obsolete"
        expected.append((name, t, part))
    parts, deleted = run(spark, ann, gone)
    assert sorted(parts) == sorted(expected)
    dead = {n for n, _, p in expected if p == "obsolete"}
    assert {g[0] for g in deleted} <= dead | (set(x[0] for x in gone) - set(x[0] for x in ann))


def test_summary_and_state(spark):
    a = spark.createDataFrame([("a", 1, "2026-01-01", C), ("b", 1, "2026-01-01", A)], ANN)
    d = spark.createDataFrame([("c", 2, "2026-01-01", 0)], DEL)
    assert rows(image_state(a, d)) == [("a", False, 1), ("b", False, None), ("c", True, None)]
    parts = partition_annotations(a, d)
    assert rows(partition_summary(parts, deleted_images(a, d))) == [("dataset", 1), ("deleted", 1), ("in_progress", 1)]


def test_an_image_is_combined_before_the_shuffle(spark):
    a = spark.createDataFrame([("a", 1, "2026-01-01", C)], ANN)
    plan = image_state(a, spark.createDataFrame([], DEL))._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan
