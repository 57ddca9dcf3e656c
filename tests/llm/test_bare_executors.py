"""The queries on executors that have no copy of the package: only the driver finds it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="textloom-")).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        try:
            query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        except Exception as e:
            print("FAILED", name, str(e)[-400:])
print("DONE")
"""


def test_every_query_runs_without_the_package_on_executors(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    said = [x for x in out.stdout.splitlines() if x.startswith(("FAILED", "DONE"))]
    assert said == ["DONE"], said
