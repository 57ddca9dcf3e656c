import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="textloom-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def samples(spark):
    """Make a samples DataFrame from (seq, text, source) rows."""

    def make(rows):
        return spark.createDataFrame(
            [(s, t, src, "") for s, t, src in rows], "seq bigint, text string, source string, split string")

    return make


@pytest.fixture
def plan_nodes(spark):
    """Make (operator, input columns) of the nodes of a physical plan."""
    import re

    def nodes(df):
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        found = re.findall(r"^\(\d+\) ([^\n]+)\n((?:[A-Z][^\n]*\n)*)", text, re.M)
        return [(name, " ".join(re.findall(r"Input \[\d+\]: \[([^\n]*)\]", body))) for name, body in found]

    return nodes
