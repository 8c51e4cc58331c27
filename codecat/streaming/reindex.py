"""Keep a catalogue up to date with a growing corpus folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.digest import digest
from ..plans.archives import index_with_archives
from ..plans.catalogue import upsert_catalogue
from ..plans.incremental import affected
from ..schema import ARCHIVES, FILES, REJECTS, Scope
from ..sources.corpus import stream_corpus
from ..sources.scratch import scratch_space, staged
from ..sources.tables import stored


def reindex(
    spark: SparkSession,
    corpus: str,
    table: str,
    digests: str,
    checkpoint: str,
    scope: Scope = Scope(),
    rejects: str | None = None,
) -> StreamingQuery:
    """Index what was added to ``corpus`` since the last run, then stop.

    ``digests`` holds one digest per micro-batch, in ranges of paths, so that later batches skip
    what they do not touch. ``rejects`` names a folder for what the units judged in each batch lack, see :func:`kept_rejects`. A
    replayed batch replaces its digest and its rejects, and stored documents are ignored, so a run that was cut off can be
    repeated. Documents are never removed.
    """
    columns = digest(spark.createDataFrame([], FILES), scope).schema
    stored_facts = T.StructType([*columns, T.StructField("batch", T.LongType())])

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own = f"{digests}/batch={batch_id}"
        with scratch_space(session, "batch") as work:
            facts = staged(digest(batch, scope), "facts", under=work)
            ordered = facts.repartitionByRange("kind", "path").sortWithinPartitions("kind", "path")
            ordered.write.mode("overwrite").partitionBy("kind").parquet(own)
            facts = session.read.schema(stored_facts).parquet(digests)
            facts = facts.where(F.col("batch") <= batch_id)
            fresh = facts.where(F.col("batch") == batch_id)
            documents, judged = affected(facts.drop("batch"), fresh.drop("batch"), work, scope)
            upsert_catalogue(documents, table)
            if rejects is not None:
                judged.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    return (
        stream_corpus(spark, corpus)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def kept_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """``(path, stage, reason)`` of what is refused by now: the last verdict on each input, unless it was taken back."""
    judged = stored(spark, rejects, T.StructType([*REJECTS, T.StructField("batch", T.LongType())]))
    last = judged.groupBy("path", "stage").agg(F.max_by("reason", "batch").alias("reason"))
    return last.where(F.col("reason").isNotNull())


def reindex_archives(
    spark: SparkSession, archives: str, table: str, state: str, checkpoint: str, **options
) -> StreamingQuery:
    """Expand and index the archives that were added to a growing folder since the last run, then stop.

    ``archives`` holds Parquet files of ``(path, content)``. ``state`` is as of :func:`index_with_archives`, as are the
    options: it names what was expanded before, so a replayed batch expands nothing twice.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        index_with_archives(batch.sparkSession, batch, table, state, **options)

    found = spark.readStream.schema(ARCHIVES).parquet(archives).where(F.col("path").isNotNull())
    return found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
