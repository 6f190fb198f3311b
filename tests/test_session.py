"""Stored tables on a stock session, which names no shared folder."""

import os
import subprocess
import sys

SAY = """
from pyspark.sql import SparkSession
from recollect.session import clear_scratch, release, shared_dir, stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
t = stored(spark.range(3), "x")
assert t.count() == 3 and shared_dir(spark) == shared_dir(spark)
release(t)
clear_scratch(spark)
print("fine")
"""


def test_stored_without_a_shared_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", SAY], env=env, capture_output=True, text=True, timeout=200, cwd=tmp_path)
    assert out.stdout.strip().endswith("fine"), out.stderr[-1500:]
