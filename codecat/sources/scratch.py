"""Scratch tables in the folder that the cluster shares.

A staged table cuts the lineage: later jobs read files that outlive the
executors that wrote them.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_root() -> str:
    """A folder for local sessions without a shared one; it goes when Python ends."""
    root = tempfile.mkdtemp(prefix="codecat-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, local mode has a folder of its own; on a cluster no
    folder of one machine would do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_root()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A path of its own for one use. Nothing is created yet."""
    return f"{scratch_root(spark)}/codecat-{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_space(spark: SparkSession, label: str) -> Iterator[str]:
    """A path for the time of a ``with`` block, deleted also when the block fails."""
    path = scratch_dir(spark, label)
    try:
        yield path
    finally:
        drop_scratch(spark, path)


def staged(df: DataFrame, label: str, *partition_by: str, under: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    The table is a folder of its own, or the folder ``label`` below ``under``.
    With partition columns, rows are rebalanced first: else each of many tasks
    would write a small file per partition.
    """
    spark = df.sparkSession
    path = f"{under}/{label}" if under else scratch_dir(spark, label)
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_small(df: DataFrame, label: str) -> DataFrame:
    """:func:`staged` for few rows, such as one per group: one file, however many tasks made them.

    Each file costs those who read it one more to open, and on a local disk Hadoop starts processes to set the
    permissions of each, which share the executor's memory until they run their own program.
    """
    return staged(df.repartition(1), label)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`scratch_dir`. Goes through the JVM, so not on Spark Connect."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
