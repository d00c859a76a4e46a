"""Rules a dataset table has to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill import schema as S
from boxmill.functions import base_name


def invalid_rows(rows: DataFrame) -> DataFrame:
    """Rows breaking a rule, with the first rule they break as ``problem``.

    Rules: a bare, non-empty image name; an absolute image path or none; a split of
    train, val, test or none; a known shape kind; label and corners on box rows.
    """
    has = set(rows.columns)
    name = F.col("image_name")
    problem = F.when(F.coalesce(name, F.lit("")) == "", "image_name is empty").when(
        base_name(name) != name, "image_name is not a bare file name"
    )
    if "image_path" in has:
        problem = problem.when(~F.startswith("image_path", F.lit("/")), "image_path is not absolute")
    if "split" in has:
        problem = problem.when(~F.col("split").isin(*S.SPLITS), "split is not train, val or test")
    if "instance_shape" in has:
        shape = F.col("instance_shape")
        problem = problem.when(
            shape.isNull() | ~shape.isin(S.BOX, S.NONE, S.DELETED), "instance_shape is unknown"
        )
        needed = ["instance_label", "bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br"]
        lacking = F.lit(False)
        for c in needed:
            lacking = lacking | (F.col(c).isNull() if c in has else F.lit(True))
        problem = problem.when((shape == S.BOX) & lacking, "box row lacks label or corners")
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull())


def rule_counts(rows: DataFrame) -> DataFrame:
    return invalid_rows(rows).groupBy("problem").agg(F.count("*").alias("n_rows"))


def check_rows(rows: DataFrame) -> DataFrame:
    """The rows; raises with the number of bad rows per rule."""
    bad = {r["problem"]: r["n_rows"] for r in rule_counts(rows).collect()}  # one row per rule
    if bad:
        raise ValueError("; ".join(f"{n} rows: {p}" for p, n in sorted(bad.items())))
    return rows
