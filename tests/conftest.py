import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["map-side", "shuffled"])
def either_join(request, spark, monkeypatch):
    """Run a test with small sides broadcast, and again with salted joins only."""
    if request.param == "shuffled":
        from codecat.operators import joins

        monkeypatch.setattr(joins, "ROWS_PER_TASK", 3)
        key = "spark.sql.autoBroadcastJoinThreshold"
        old = spark.conf.get(key)
        spark.conf.set(key, "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        yield request.param
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    else:
        yield request.param


@pytest.fixture
def corpus(spark):
    """Make ``files`` from a dict of contents by path."""

    def make(contents):
        return spark.createDataFrame(list(contents.items()), "path string, content string")

    return make
