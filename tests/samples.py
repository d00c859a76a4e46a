"""Small snapshots written out by hand."""

import json

LABELS = [
    (1, "cat", "#112233", [(10, "age"), (11, "mood")]),
    (2, "dog", "", []),
]


def labels(spark):
    from boxmill.schema import LABELS as layout

    return spark.createDataFrame(LABELS, layout)


def shape(i, frame, label=1, kind="rectangle", points=(1.0, 2.0, 3.0, 4.0), **extra):
    return {"id": i, "type": kind, "frame": frame, "label_id": label, "points": list(points), **extra}


def document(task_id, frames, deleted=(), shapes=(), name=None, status="completed", date="2026-01-01", **task):
    return {
        "task": {
            "id": task_id, "name": name or f"task {task_id}", "status": status, "subset": "s",
            "updated_date": date, **task,
        },
        "data_meta": {
            "frames": [{"name": n, "width": 640, "height": 480} for n in frames],
            "deleted_frames": list(deleted),
        },
        "annotations": {"shapes": list(shapes), "tracks": []},
    }


EIGHT = [f"im{i}.jpg" for i in range(8)]


def normal(task_id=11, **kw):
    """8 frames, all annotated, 30 boxes."""
    return document(task_id, EIGHT, shapes=[shape(i + 1, i % 8) for i in range(30)], **kw)


def all_empty(task_id=12, **kw):
    return document(task_id, EIGHT, **kw)


def all_removed(task_id=13, **kw):
    return document(task_id, EIGHT, range(8), [shape(i + 1, i % 8) for i in range(30)], **kw)


def last_removed(task_id=14, **kw):
    """Frame 0 empty, frame 7 deleted, 17 boxes on frames 1 to 6."""
    return document(task_id, EIGHT, [7], [shape(i + 1, 1 + i % 6) for i in range(17)], **kw)


def write(folder, *documents):
    folder.mkdir(parents=True, exist_ok=True)
    for d in documents:
        (folder / f"{d['task']['id']}.json").write_text(json.dumps(d, indent=1, ensure_ascii=False))
    return str(folder)
