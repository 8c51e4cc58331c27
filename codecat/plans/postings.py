"""Which names hold a short piece of text, stored beside the catalogue.

For each piece of ``GRAM`` characters there is a row per distinct name of a language that holds it, with the
name's number, a 64-bit hash; and a table of frequencies has the rows of each piece. Both lie below
the catalogue's folder under names that scans of the catalogue pass over, in ranges of pieces, and grow
with each insert. A batch search reads the postings of the pieces that it chose, so no name is cut to
pieces again. Postings only propose names, which are then tested in full: postings too many, as of names that come with a second
insert, cost time but change no result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a piece.
GRAM = 3
POSTINGS = "gram string, name_id long, language string"
FREQUENCIES = "gram string, names long"


def grams(text: Column, sizes: list[int]) -> Column:
    """Distinct pieces of a text, of each of the given sizes; size 0 is the empty piece."""
    parts = []
    for size in sizes:
        last = F.length(text) - size + 1
        cut = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))
        some = F.array(F.lit("")) if size == 0 else F.when(last >= 1, cut).otherwise(F.array().cast("array<string>"))
        parts.append(some)
    return F.array_distinct(F.concat(*parts))


def name_id(name_lc: Column) -> Column:
    return F.xxhash64(name_lc)


@dataclass(frozen=True)
class Postings:
    """``names(gram, name_id, language)`` and ``frequencies(gram, names)``, a row per piece and insert."""

    names: DataFrame
    frequencies: DataFrame


def add_postings(rows: DataFrame, table: str, mode: str = "append") -> None:
    """Store the postings of ``rows(name_lc, language)`` with the catalogue ``table``."""
    names = rows.select("language", "name_lc").distinct()
    held = names.select("language", name_id(F.col("name_lc")).alias("name_id"), F.explode(grams(F.col("name_lc"), [GRAM])).alias("gram"))
    # A piece that many names have is spread over ranges of their numbers.
    dealt = held.repartitionByRange("language", "gram", "name_id").sortWithinPartitions("language", "gram", "name_id")
    dealt.select("gram", "name_id", "language").write.mode(mode).partitionBy("language").parquet(f"{table}/_postings")
    counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode(mode).parquet(f"{table}/_frequencies")


def open_postings(spark: SparkSession, table: str) -> Postings | None:
    """The postings of a stored catalogue; none if it has none."""
    try:
        names = spark.read.schema(POSTINGS).parquet(f"{table}/_postings")
        return Postings(names, spark.read.schema(FREQUENCIES).parquet(f"{table}/_frequencies"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
