"""Run queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

#: DuckDB type names by Spark type name.
SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def duck_rows(sf_dir: str, sql: str) -> tuple[dict[str, str], Counter]:
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    result = con.sql(sql)
    order = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    types = {result.columns[i]: str(result.types[i]) for i in order}
    return types, Counter(tuple(row[i] for i in order) for row in result.fetchall())


def spark_rows(df) -> tuple[dict[str, str], Counter]:
    names = sorted(df.columns)
    types = {name: SAME_TYPE[dict(df.dtypes)[name]] for name in names}
    return types, Counter(tuple(row) for row in df.select(*names).collect())
