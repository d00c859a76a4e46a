"""Round trips of the driver tables; document files are packed."""

import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from boxmill import registry
from boxmill.adapters import Tables
from boxmill.registry import extract as queries
from boxmill.registry.extract import BOX_COLUMNS


@pytest.fixture
def driver_tables(spark, tmp_path):
    """Orders, lines and parts; a line number that repeats is one frame with several shapes."""
    day = datetime.datetime(2024, 1, 1)
    orders = [(k, k, "FOP"[k % 3], "5-LOW", day) for k in range(40)]
    lines = [(k % 44, k * 7 % 300, k % 60, k % 9 + 1, 1.0 + k % 50, 900.5 + k, 0.0 if k % 9 == 0 else 0.05, "RAN"[k % 3], "OF"[k % 2]) for k in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_linestatus string"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k % 25 + 1}") for k in range(60)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["document_files", "snapshot_round_trip"])
def test_round_trips_give_the_rows_of_the_tables(spark, driver_tables, monkeypatch, tmp_path, name):
    scratch = tmp_path / "scratch"
    monkeypatch.setattr(queries, "scratch_root", lambda _: str(scratch))
    found = registry.queries()[name](spark, driver_tables)
    table = Tables(spark, driver_tables)
    assert rows(found) == rows(table.records.raw().select(*BOX_COLUMNS))
    if name == "document_files":
        [folder] = scratch.glob("documents-*")
        parts = list(folder.glob("part-*"))
        # the files were plain text, ten times as large
        assert parts and all(p.name.endswith(".json.gz") for p in parts)
        assert sum(len(r[0]) for r in spark.read.text(str(folder)).collect()) > 3 * sum(p.stat().st_size for p in parts)


def test_deleted_frames_are_those_with_a_flagged_line(spark, driver_tables):
    table = Tables(spark, driver_tables)
    lines = [tuple(r) for r in table.raw("lineitem").select("l_orderkey", F.col("l_linenumber") - 1, "l_returnflag", "l_linestatus").collect()]
    assert rows(table.deleted_frames, "task_id", "frame_id") == sorted({x[:2] for x in lines if x[2:] == ("R", "O")}, key=lambda r: [(True, str(v)) for v in r])
    plan = table.deleted_frames._jdf.queryExecution().optimizedPlan().toString()
    # only flagged lines are shuffled
    assert "Filter" in plan.rpartition("Aggregate")[2] and "= R" in plan.rpartition("Aggregate")[2]
