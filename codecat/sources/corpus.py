"""The corpus table: one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FILES


def read_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Read ``files(path, content)`` from Parquet with a fixed schema."""
    return spark.read.schema(FILES).parquet(*paths).where(F.col("path").isNotNull())


def stream_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Read the Parquet files of a growing corpus folder as a stream."""
    return spark.readStream.schema(FILES).parquet(path).where(F.col("path").isNotNull())


def decoded(files: DataFrame) -> DataFrame:
    """Turn binary contents into text; bad bytes become U+FFFD."""
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
