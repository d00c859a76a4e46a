"""Label definitions: usage, edits and remapping between projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill.functions import folded, hex_colour
from boxmill.operators.attributes import with_spec_targets
from boxmill.session import settle


def label_usage(shapes: DataFrame) -> DataFrame:
    """Shapes per label id, of every shape type and on deleted frames too."""
    return shapes.groupBy("label_id").agg(F.count("*").alias("shapes"))


def usage_report(labels: DataFrame, shapes: DataFrame) -> DataFrame:
    """Every defined label with its number of shapes."""
    return labels.join(label_usage(shapes), "label_id", "left").select(
        "label_id", "label_name", F.coalesce("shapes", F.lit(0)).alias("shapes")
    )


def _edits(labels: DataFrame, rows: list, layout: str) -> DataFrame:
    return labels.sparkSession.createDataFrame(rows, layout)


def name_clashes(labels: DataFrame) -> DataFrame:
    """Names that occur more than once when case is ignored."""
    return (
        labels.groupBy(folded("label_name").alias("key"))
        .agg(F.count("*").alias("labels"))
        .where("labels > 1")
    )


def apply_label_changes(
    labels: DataFrame,
    shapes: DataFrame,
    add: dict[int, str] | None = None,
    rename: dict[int, str] | None = None,
    recolor: dict[int, str] | None = None,
    delete: list[int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(labels, shapes) after the edits; deleting a label deletes its shapes.

    ``add`` maps new ids to names.  A name that exists already (ignoring case), an
    empty name or a colour other than ``#rrggbb`` is an error.
    """
    out = labels if "color" in labels.columns else labels.withColumn("color", F.lit(""))
    new_names = list((add or {}).values()) + list((rename or {}).values())
    if any(not str(n).strip() for n in new_names):
        raise ValueError("a label name is empty")
    if delete:
        gone = _edits(labels, [(int(i),) for i in delete], "label_id long")
        out = out.join(F.broadcast(gone), "label_id", "left_anti")
        shapes = shapes.join(F.broadcast(gone), "label_id", "left_anti")
    if rename:
        names = _edits(labels, [(int(i), n.strip()) for i, n in rename.items()], "label_id long, _new string")
        out = out.join(F.broadcast(names), "label_id", "left")
        out = out.withColumn("label_name", F.coalesce("_new", "label_name")).drop("_new")
    if recolor:
        colours = _edits(labels, [(int(i), c.strip()) for i, c in recolor.items()], "label_id long, _raw string")
        bad = [r[0] for r in colours.where(hex_colour("_raw").isNull()).select("_raw").collect()]
        if bad:
            raise ValueError(f"not a #rrggbb colour: {', '.join(bad)}")
        out = out.join(F.broadcast(colours), "label_id", "left")
        out = out.withColumn("color", F.coalesce(hex_colour("_raw"), "color")).drop("_raw")
    if add:
        fresh = _edits(labels, [(int(i), n.strip()) for i, n in add.items()], "label_id long, label_name string")
        out = out.unionByName(fresh.withColumn("color", F.lit("")), allowMissingColumns=True)
    if new_names:
        touched = [n.strip().casefold() for n in new_names]
        clash = [r["key"] for r in name_clashes(out).where(F.col("key").isin(touched)).collect()]
        if clash:
            raise ValueError(f"label exists already: {', '.join(sorted(clash))}")
    return out.select(*[c for c in labels.columns], *([] if "color" in labels.columns else ["color"])), shapes


def label_id_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """``label_id, new_label_id`` by equal name (the last target of a name)."""
    names = target.groupBy("label_name").agg(F.max("label_id").alias("new_label_id"))
    return source.select("label_id", "label_name").join(names, "label_name").select("label_id", "new_label_id")


def _specs(labels: DataFrame) -> DataFrame:
    return labels.select("label_name", F.explode("attributes").alias("a")).select(
        "label_name", F.col("a.id").alias("spec_id"), F.col("a.name").alias("attribute_name")
    )


def attribute_id_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """``spec_id, target`` by equal label name and attribute name."""
    keys = ["label_name", "attribute_name"]
    ids = _specs(target).groupBy(*keys).agg(F.max("spec_id").alias("target"))
    return _specs(source).join(ids, keys).groupBy("spec_id").agg(F.max("target").alias("target"))


def _renumbered(attributes: str):
    return F.transform(
        attributes,
        lambda a: F.struct(
            F.coalesce(a["target"], a["spec_id"]).alias("spec_id"),
            F.coalesce(a["value"], F.lit("")).alias("value"),
        ),
    )


def remap_shapes(shapes: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Shapes with the label and attribute ids of another project.

    A shape whose label is unknown there is dropped; an unknown attribute id stays.
    """
    moved = shapes.join(label_id_map(source, target), "label_id")
    moved = moved.withColumn("label_id", F.col("new_label_id")).drop("new_label_id")
    if "attributes" in shapes.columns:
        moved = with_spec_targets(moved, attribute_id_map(source, target))
        moved = moved.withColumn("attributes", _renumbered("attributes"))
    return moved.select(*shapes.columns)


def remap_tracks(tracks: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The same for tracks: the track's own attributes and those of each of its shapes.

    The shapes of a track are unnested under a number of the track, renumbered and put back in their order.
    """
    moved = settle(remap_shapes(tracks, source, target).withColumn("_track", F.monotonically_increasing_id()))
    none = F.array().cast("array<struct<spec_id:bigint,value:string>>")
    flat = moved.select("_track", F.posexplode("shapes").alias("_at", "_s"))
    flat = flat.withColumn("attributes", F.coalesce("_s.attributes", none))
    ids = with_spec_targets(flat, attribute_id_map(source, target))
    ids = ids.withColumn("_s", F.col("_s").withField("attributes", _renumbered("attributes")))
    # a track is one row already, so this group is as large as an input row
    packed = ids.groupBy("_track").agg(F.array_sort(F.collect_list(F.struct("_at", "_s"))).alias("_all"))
    shapes = F.coalesce(F.transform("_all", lambda e: e["_s"]), F.col("shapes"))
    return moved.join(packed, "_track", "left").withColumn("shapes", shapes).select(*tracks.columns)
