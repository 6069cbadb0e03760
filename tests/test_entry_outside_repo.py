"""The driver contract works from any working directory (workers import the package)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
assert E.entry(spark).count() > 0
q = E.queries()
assert q["score_batches"](spark, "/root/testdata/sf0.001").count() > 0
assert q["lemmatize"](spark, "/root/testdata/sf0.001").count() > 0
print("OK")
"""


def test_entry_and_python_udf_queries_from_elsewhere():
    cwd = tempfile.mkdtemp(prefix="quillspark-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert r.returncode == 0 and "OK" in r.stdout, r.stderr[-2000:]
