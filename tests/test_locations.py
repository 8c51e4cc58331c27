"""Contents read at their places, against a join with the corpus."""

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from codecat.plans import search as find
from codecat.sources import locations
from codecat.sources.corpus import read_corpus
from codecat.sources.locations import open_locations, update_locations

KEY = "language string, name string, path string"


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    """A corpus of two parts, with an odd folder name, null and long contents, and paths that occur twice."""
    home = str(tmp_path_factory.mktemp("corpus") / "a b%c")
    rows = [(f"/d{i % 7}/f{i}.{'py' if i % 3 else 'txt'}", None if i % 11 == 0 else f"text {i} é" * (i % 40)) for i in range(400)]
    rows += [("/d1/twice.go", "one"), ("/d1/twice.go", "two"), (None, "lost"), ("/d/long.java", "x" * 300_000)]
    for part in (rows[:150], rows[150:]):
        df = spark.createDataFrame(part, "path string, content string").repartition(3)
        df.write.mode("append").option("parquet.block.size", 2000).parquet(f"{home}/corpus")
        update(spark, home)
    return home


def update(spark, home):
    update_locations(spark, f"{home}/corpus", f"{home}/index", f"{home}/checkpoint")


def hits_of(spark, paths):
    return spark.createDataFrame([("go", f"n{i}", p) for i, p in enumerate(paths)], KEY)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("few", [200, 0])
def test_lookup(spark, home, either_join, monkeypatch, few):
    monkeypatch.setattr(find, "FEW_PATHS", few)
    monkeypatch.setattr(locations, "ROWS_PER_TASK", 20)
    paths = [f"/d{i % 7}/f{i}.py" for i in range(1, 400, 3 if few else 1)] + ["/d1/twice.go", "/d1/twice.go", "/none.py", "/d/long.java"]
    hits = hits_of(spark, paths)
    found = find.lookup_located(hits, open_locations(spark, f"{home}/index"))
    expected = rows(find.lookup_content(hits, read_corpus(spark, f"{home}/corpus")))
    assert rows(found) == expected and len(expected) > 80


def test_contents_are_never_shuffled(spark, home, either_join):
    found = find.lookup_located(hits_of(spark, ["/d1/f1.py"]), open_locations(spark, f"{home}/index"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow", 1)[1]
    assert "Exchange" in below and "content" not in below.split("\n", 1)[1] and "Exchange" not in plan.split("MapInArrow")[0]


def test_index_reads_each_file_once(spark, home):
    index = spark.read.parquet(f"{home}/index")
    assert {r["batch"] for r in index.select("batch").distinct().collect()} == {0, 1}
    update(spark, home)
    assert spark.read.parquet(f"{home}/index").count() == index.count() == index.select("file", "row").distinct().count()
    corpus = read_corpus(spark, f"{home}/corpus").where("path NOT LIKE '%.txt'")
    assert rows(index.select("path")) == rows(corpus.select("path"))


def test_rows_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(locations, "ROWS_PER_TASK", 100)
    home = str(tmp_path)
    spark.range(1000).select(F.concat(F.lit("/f"), "id", F.lit(".py")).alias("path"), F.lit("x").alias("content")).coalesce(1).write.parquet(f"{home}/corpus")
    update(spark, home)
    places = open_locations(spark, f"{home}/index")
    read = locations.read_located(places)
    assert read.count() == 1000 and read.select(F.spark_partition_id()).distinct().count() >= 8


def test_no_hits_no_index_and_a_stale_one(spark, home, tmp_path):
    none = open_locations(spark, str(tmp_path / "none"))
    assert find.lookup_located(hits_of(spark, ["/d1/f1.py"]), none).count() == 0
    index = open_locations(spark, f"{home}/index")
    assert find.lookup_located(hits_of(spark, ["/none.py"]), index).count() == 0
    for stale in (index.withColumn("row", F.lit(0).cast("long")), index.withColumn("row", F.col("row") + 10_000)):
        with pytest.raises(PythonException, match="build"):
            find.lookup_located(hits_of(spark, [f"/d{i % 7}/f{i}.py" for i in range(1, 40)]), stale).collect()
