"""Stored tables that grow."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table; empty when there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def add_rows(new: DataFrame, path: str, schema) -> None:
    """Append the rows that a stored table does not have."""
    known = stored(new.sparkSession, path, schema)
    columns = known.columns
    new.select(*columns).distinct().join(known, columns, "left_anti").write.mode("append").parquet(path)
