"""Joins against plain ones, with hot keys and forced limits."""

import pytest
from pyspark.sql import functions as F

from codecat.functions.paths import parent
from codecat.operators import joins


def rows(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, how):
    """Half of the left rows have one key; another hot key has no partner."""
    hot = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 8 == 1, 900)
    left = spark.range(2000).select("id", F.coalesce(hot, F.col("id") % 50).alias("k"))
    right = spark.range(30).select((F.col("id") % 25).alias("k"), F.col("id").alias("r"))
    found = joins.salted_join(left, right, "k", "id", how, rows_per_task=100)
    assert rows(found) == rows(left.join(right, "k", how))


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_hot_keys_on_the_right(spark, how):
    left = spark.range(60).select("id", (F.col("id") % 6).alias("k"))
    right = spark.range(900).select(F.when(F.col("id") % 3 > 0, 2).otherwise(F.col("id") % 4).alias("k"), F.col("id").alias("r"))
    found = joins.salted_join(left, right, "k", "id", how, rows_per_task=50)
    assert rows(found) == rows(left.join(right, "k", how))


@pytest.mark.parametrize("n_left, n_right", [(1000, 1), (1, 1000), (3000, 40)])
def test_salted_join_spreads_hot_keys(spark, n_left, n_right):
    """One key, or forty equally hot ones, on either side."""
    keys = 40 if n_left == 3000 else 1
    left = spark.range(n_left).withColumn("k", F.col("id") % keys)
    right = spark.range(n_right).select((F.col("id") % keys).alias("k"), F.col("id").alias("v"))
    key = "spark.sql.adaptive.enabled"
    thresholds = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(thresholds)
    spark.conf.set(key, "false")
    spark.conf.set(thresholds, "-1")
    try:
        found = joins.salted_join(left, right, "k", "id", rows_per_task=100 if keys == 1 else 8)
        used = found.select("k", F.spark_partition_id()).distinct().groupBy("k").agg(F.count("*").alias("tasks")).collect()
    finally:
        spark.conf.set(key, "true")
        spark.conf.set(thresholds, old)
    assert len(used) == keys and min(row["tasks"] for row in used) > (3 if keys == 1 else 1)


def test_salted_join_on_two_keys(spark):
    left = spark.range(500).selectExpr("id", "id % 2 AS a", "id % 3 AS b")
    right = spark.range(6).selectExpr("id % 2 AS a", "id % 3 AS b", "id AS r")
    found = joins.salted_join(left, right, ["a", "b"], "id", rows_per_task=10)
    assert rows(found) == rows(left.join(right, ["a", "b"]))


@pytest.mark.parametrize("value, limit", [("10485760b", 10 << 20), ("10MB", 10 << 20), ("-1", -1), ("512k", 512 << 10), ("7", 7)])
def test_broadcast_limit(spark, value, limit):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        assert joins.broadcast_limit(spark) == limit
    finally:
        spark.conf.set(key, old)


def test_fits_broadcast_measures_bytes(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    df = spark.range(10).select(F.repeat(F.lit("x"), 100).alias("s"), F.array("id").alias("a"))
    spark.conf.set(key, "2000")
    try:
        assert joins.fits_broadcast(df)
        spark.conf.set(key, "1000")
        assert not joins.fits_broadcast(df)
        assert joins.fits_broadcast(df.where("s = ''"))
    finally:
        spark.conf.set(key, old)


def test_containing_against_prefix_test(spark, either_join):
    names = ["a", "b", "a-b", "a.c"]
    files = [f"/{x}/{y}/{z}/f{i}" for x in names for y in names for z in names for i in range(2)]
    owners = ["/", "/a", "/a/b", "/a/a-b/a", "/b/a/b", "/nowhere", "/a-b"]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    df = df.withColumn("dir", parent(F.col("path")))
    found = joins.containing(df, spark.createDataFrame([(o,) for o in owners], "owner string"))
    expected = [(o, f) for f in files for o in owners if f.startswith(o.rstrip("/") + "/")]
    assert sorted((r["owner"], r["path"]) for r in found.collect()) == sorted(expected)
