"""The keys of a stored catalogue, laid out for the anti-join of large inserts.

An insert that is too large to broadcast meets the keys that are stored. They are two 64-bit hashes per
document, in a table of Parquet files that is bucketed by them. So the new keys are shuffled to the buckets, and the stored
side is read where it lies, without an exchange, 16 bytes a document. The table lies below the catalogue's folder under a
name that scans of the catalogue pass over. It is made by the first insert that needs it, kept up by all later ones,
and made anew where it does not have as many rows as the catalogue, as after a run that was cut off, or where its buckets have grown too large.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATALOGUE_KEY
from ..sources.scratch import drop_scratch

#: Documents that a bucket is planned for, and how many times as many it may come to have.
BUCKET_ROWS, GROWTH = 2_000_000, 4
HASHES = ["key", "other"]


def hashed(documents: DataFrame) -> DataFrame:
    """Add the two hashes of each document; together they tell 10^12 documents apart but for a chance of 10^-14."""
    key = [F.col(name) for name in CATALOGUE_KEY]
    return documents.withColumns({"key": F.xxhash64(*key), "other": F.xxhash64(F.lit("other"), *key)})


def _buckets(spark: SparkSession, table: str) -> int | None:
    try:
        return spark.read.schema("buckets int").parquet(f"{table}/_buckets").first()["buckets"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@contextmanager
def _opened(spark: SparkSession, table: str, buckets: int) -> Iterator[str]:
    """The stored keys as a bucketed table, known to the session for the time of a ``with`` block."""
    path = f"{table}/_keys".replace("\\", "\\\\").replace("'", "\\'")
    name = f"codecat_keys_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} (key BIGINT, other BIGINT) USING parquet "
        f"CLUSTERED BY (key, other) SORTED BY (key, other) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    try:
        yield name
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _append(rows: DataFrame, name: str, buckets: int) -> None:
    """A file per bucket and insert."""
    rows.select(*HASHES).repartition(buckets, *HASHES).sortWithinPartitions(*HASHES).write.insertInto(name)


def add_keys(documents: DataFrame, table: str) -> None:
    """Store the keys of documents that were added to a catalogue, if it keeps keys."""
    spark = documents.sparkSession
    buckets = _buckets(spark, table)
    if buckets is not None:
        with _opened(spark, table, buckets) as name:
            _append(hashed(documents), name, buckets)


def _rebuilt(spark: SparkSession, table: str, documents: DataFrame, rows: int) -> int:
    """Make the keys anew from a catalogue of so many rows, and give the number of buckets."""
    buckets = max(1, math.ceil(rows / BUCKET_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    drop_scratch(spark, f"{table}/_keys")
    with _opened(spark, table, buckets) as name:
        _append(hashed(documents), name, buckets)
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{table}/_buckets")
    return buckets


def without_stored(new: DataFrame, table: str, documents: DataFrame, write: Callable[[DataFrame], None]) -> None:
    """Hand the documents of ``new`` whose key is not stored to ``write``; ``documents`` is the stored catalogue.

    ``new`` has one row per document.
    """
    spark = new.sparkSession
    buckets, rows = _buckets(spark, table), documents.count()
    kept = 0
    if buckets is not None:
        with _opened(spark, table, buckets) as name:
            kept = spark.table(name).count()
    if buckets is None or kept != rows or rows > GROWTH * BUCKET_ROWS * buckets:
        buckets = _rebuilt(spark, table, documents, rows)
    with _opened(spark, table, buckets) as name:
        write(anti_join(new, spark.table(name)))


def anti_join(new: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose hashes are not among the stored ones, which stay where they are."""
    return hashed(new).join(keys.hint("merge"), HASHES, "left_anti").drop(*HASHES)
