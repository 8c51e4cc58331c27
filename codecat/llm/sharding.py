"""Sharding by a two-pass external shuffle.

Pass one scatters whole records into buckets that fit a task's memory, by seeded
hashes. Pass two puts each bucket into random order (``shuffle`` is a Fisher-Yates
shuffle) and writes it. A bucket belongs to one shard, so the files of a shard are
complete when its buckets are written, and no record moves a second time.

The shard of a record follows from its id and the number of shards alone: the shard
with the highest hash of id and shard number. Adding a shard adds one contender, so
rows move to the new shard or stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, staged

#: Bytes of text that a bucket is planned for.
BUCKET_BYTES = 32 << 20
#: Bytes that count for a record besides its text.
OVERHEAD = 16


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def best_shard(key: Column, shards: int) -> Column:
    """The shard among ``shards`` with the highest hash together with the key (null is a key, too)."""
    rated = [F.struct(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), F.lit(s)), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*rated)["s"] if shards > 1 else F.lit(0)


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    path: str | None = None,
) -> DataFrame:
    """Write ``docs`` as shuffled shards and return them with their places.

    The table under ``path`` (default: a scratch folder) is Parquet by ``shard``; each record is a
    struct ``record`` of all columns of ``docs``, so no names clash, beside ``bucket`` and ``place``
    within the bucket. The returned rows are ``record, size, shard, slot, grown_shard``: ``slot``
    counts the rows of a shard without gaps from 0 in shuffled order, ``grown_shard`` is the shard if
    there were one more.

    The bytes per shard are summed first (one row per shard comes to the driver) and give each shard
    its number of buckets. Records scatter by id, text and the input partition they come from, so
    neither a hot id nor a row repeated a million times fills one bucket.

    Defined results: null ids share a shard, their rows still scatter over its buckets; a null text
    weighs the overhead alone; repeated rows each get a slot; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct("*").alias("record"),
        F.col(id_col).alias("_id"),
        record_size(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("_text"),
        best_shard(F.col(id_col), shards).alias("shard"),
        best_shard(F.col(id_col), shards + 1).alias("grown_shard"),
    )
    sized = dict(rows.groupBy("shard").agg(F.sum("size")).collect())
    counts = [max(1, math.ceil(sized.get(s, 0) / bucket_bytes)) for s in range(shards)]
    first = [sum(counts[:s]) for s in range(shards)]

    def by_shard(values: list[int]) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("shard"))

    scatter = F.pmod(F.xxhash64(F.lit(seed), "_id", "_text", F.spark_partition_id()), by_shard(counts).cast("long"))
    buckets = (
        rows.withColumn("bucket", (by_shard(first) + scatter).cast("int"))
        .repartitionById(sum(counts), F.col("bucket"))
        .sortWithinPartitions("bucket", F.xxhash64(F.lit(seed), "_id", "_text"))
        .groupBy("shard", "bucket")
        .agg(F.collect_list(F.struct("record", "size", "grown_shard")).alias("_rows"))
    )
    table = path or scratch_dir(spark, "shards")
    shuffled = buckets.select("shard", "bucket", F.posexplode(F.shuffle("_rows", seed)).alias("place", "_row"))
    out = shuffled.select("shard", "bucket", "place", "_row.*")
    out.write.mode("overwrite").partitionBy("shard").parquet(table)
    return placed(spark.read.schema(out.schema).parquet(table))


def placed(written: DataFrame) -> DataFrame:
    """Derive ``slot`` from bucket and place, by the sizes of the buckets before.

    There is a row per bucket. They are stored, so that Spark knows their size and joins them to the records where these lie.
    """
    filled = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("shard", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return written.join(staged(starts, "starts"), ["shard", "bucket"]).select(
        "record", "size", F.col("shard").cast("int").alias("shard"), (F.col("_start") + F.col("place")).alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard")
    )
