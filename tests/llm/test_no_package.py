"""Executors need not have the package: a session started in an empty folder runs all operators and the pipeline."""

import os
import subprocess
import sys

import pytest

FOLDER = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[2] + "/shared").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")

def has_package(batches):
    for batch in batches:
        import importlib.util
        if importlib.util.find_spec("boxmill"):
            raise AssertionError("the workers see the package")
        yield batch

spark.range(4).mapInArrow(has_package, "id long").collect()
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
found = entry.queries()
for name in sorted(found):
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        found[name](spark, sys.argv[3]).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run(
        [sys.executable, "-c", SCRIPT, REPO, str(tmp_path), FOLDER], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900
    )
    assert made.returncode == 0, made.stderr[-3000:]
    assert made.stdout.count("ran op") == 13 and "ran pipeline" in made.stdout
