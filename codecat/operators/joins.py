"""Joins that hold up when one key owns a large share of the rows.

Nothing here is broadcast without a bound: a side is measured against Spark's own
broadcast threshold, or stored first, so that Spark itself knows its size.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..sources.scratch import staged

#: A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 2_000_000

_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}


def broadcast_limit(spark: SparkSession) -> int:
    """Spark's broadcast threshold in bytes; negative when broadcasting is off."""
    return bytes_of(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))


def bytes_of(value: str) -> int:
    """A size as Spark's settings write it, such as 10m."""
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", value.strip().lower()).groups()
    return int(number) << _UNITS[unit]


def _row_size(df: DataFrame) -> Column:
    """Estimate of the bytes of a row: texts as they are, and a share per field."""
    size = F.lit(16 * (len(df.columns) + 1))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return size.cast("long")


def fits_broadcast(df: DataFrame) -> bool:
    """Measure ``df`` and compare it with the broadcast threshold.

    Runs one aggregation, so call it on the narrow side of a join only.
    """
    limit = broadcast_limit(df.sparkSession)
    if limit <= 0:
        return False
    size = df.select(F.sum(_row_size(df)).alias("size")).collect()[0]["size"]
    return (size or 0) <= limit


def fitting_groups(df: DataFrame, key: str, groups: Collection[str]) -> set[str]:
    """Those of a few groups of ``df`` that would each fit a broadcast; one aggregation."""
    limit = broadcast_limit(df.sparkSession)
    if limit <= 0:
        return set()
    rows = df.where(F.col(key).isin(*groups)).groupBy(key).agg(F.sum(_row_size(df)).alias("size"))
    return set(groups) - {row[key] for row in rows.collect() if row["size"] > limit}


#: Bits of a key filter: 262,144 rows of 64 bits at most, at any input size. Fuller filters let more rows through.
FILTER_BITS = 24


def _place(key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER_BITS)


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """``_word, _bits``: a table of bits, one set per value of a column by its hash. Null is a value like any other."""
    places = keys.select(_place(key).alias("_place"))
    bit = F.expr("shiftleft(1L, CAST(_place & 63 AS INT))")
    return staged(places.groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits")), "filter")


def marked(rows: DataFrame, key: str, words: DataFrame) -> DataFrame:
    """``rows`` with ``_likely``: false for those whose key is surely not in the filter. Nothing is shuffled."""
    placed = rows.withColumn("_place", _place(key)).withColumn("_word", F.shiftright("_place", 6))
    bit = F.expr("shiftright(_bits, CAST(_place & 63 AS INT)) & 1 = 1")
    found = placed.join(F.broadcast(words), "_word", "left").withColumn("_likely", F.coalesce(bit, F.lit(False)))
    return found.drop("_place", "_word", "_bits")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    spread: str,
    how: str = "inner",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Equi-join whose hot keys are split over several tasks, on both sides.

    The rows of each key are counted (combined before the shuffle). A key with
    more than ``rows_per_task`` rows on a side gets that many salts for the side:
    its rows there take one by a hash (of ``spread`` on the left, of all columns on
    the right), and its partners are repeated once per salt. Cold keys have the single salt 0. Works for ``inner``, ``left_semi`` and
    ``left_anti``, and for ``left``, where the right side may not be skewed.

    All hot keys are split, however many: they are stored, so Spark broadcasts
    them when they are few, and otherwise splits the joins with them as it runs.
    """
    limit = ROWS_PER_TASK if rows_per_task is None else rows_per_task
    on = [on] if isinstance(on, str) else on
    if how in ("left_semi", "left_anti"):
        right = right.select(*on).distinct()

    def salts(side: DataFrame, name: str) -> DataFrame:
        counts = side.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
        return counts.select(*on, F.ceil(F.col("_rows") / limit).cast("int").alias(name))

    hot = salts(left, "_left_salts")
    if how == "inner":
        hot = hot.join(salts(right, "_right_salts"), on, "full")
    else:
        hot = hot.withColumn("_right_salts", F.lit(1))
    hot = staged(hot, "hot")
    one = F.lit(1)
    lefts, rights = F.coalesce("_left_salts", one), F.coalesce("_right_salts", one)

    def salted(
        side: DataFrame, by: list[str], own: str, own_salts: Column, other: str, other_salts: Column
    ) -> DataFrame:
        mine = F.pmod(F.xxhash64(*by), own_salts.cast("long")).cast("int")
        marked = side.join(hot, on, "left").withColumn(own, mine)
        marked = marked.withColumn(other, F.explode(F.sequence(F.lit(0), other_salts - 1)))
        return marked.drop("_left_salts", "_right_salts")

    key = [*on, "_left_salt", "_right_salt"]
    a = salted(left, [spread], "_left_salt", lefts, "_right_salt", rights)
    b = salted(right, right.columns, "_right_salt", rights, "_left_salt", lefts)
    return a.join(b, key, how).drop("_left_salt", "_right_salt")


def sized_join(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str],
    spread: str,
    how: str = "inner",
    small: bool | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Equi-join: map-side when ``right`` is small, else salted.

    ``small`` is the outcome of a measure that bounds ``right``; by default
    ``right`` itself is measured.
    """
    if fits_broadcast(right) if small is None else small:
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, spread, how, rows_per_task)


def containing(
    files: DataFrame,
    owners: DataFrame,
    first: Column | None = None,
    small: bool | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Pair each file with every owner directory above it.

    ``files`` has ``path`` and ``dir``; ``owners`` has a unique directory
    ``owner`` and any payload. ``first`` is the depth, derived from ``dir``, at
    which ancestors start to count. The prefix condition becomes an equi-join
    on ancestors. With few owners each file expands its own ancestors and meets
    them map-side. Otherwise only distinct directories expand, so the shuffle
    grows with directories times depth, and files join the owned directories.
    ``small`` is as in :func:`sized_join`.
    """
    first = F.lit(1) if first is None else first
    above = F.explode(ancestors(F.col("dir"), first)).alias("owner")
    if fits_broadcast(owners) if small is None else small:
        return files.select("*", above).join(F.broadcast(owners), "owner")
    folders = files.select("dir").distinct().select("dir", above)
    owned = salted_join(folders, owners, "owner", "dir", "inner", rows_per_task)
    return salted_join(files, owned, "dir", "path", "inner", rows_per_task)
