"""A corpus pipeline of the operators in ``codecat.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``.

Defined results of all stages: an empty table gives no rows; null ids, null languages and sources, repeated rows and columns of any
name pass through, where the stage's operator does not say otherwise. Texts without words go in the first stage,
since they score 0. Of equal texts and of similar ones the row with the smallest id stays; rows with a null id are
equal to others, but similar to none.

Stages that hand texts to Python bound the size of Arrow batches in the session (``spark.sql.execution.arrow.maxBytesPerBatch``): 64 MB
per batch, Spark's default, stand in the executor and again in its Python workers, once per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codecat.llm import exact_dedup, mixing, ngram_join, quality_classifier, segmentation
from codecat.operators.joins import bytes_of
from codecat.sources.scratch import staged


#: Bytes of an Arrow batch between an executor and its Python workers.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit to BATCH_BYTES where it is above. It stays so, as a stage's last step runs when its result is written."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bytes_of(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects. It is fitted to labelled rows of this stage's input."""
    bound_batches(spark)
    chain = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, chain)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of equal texts, the one with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of similar texts: five-word shingles, a similarity of 0.8 or more."""
    bound_batches(spark)
    return ngram_join.drop_near_duplicates(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does: not at all, once or twice."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document; a document that the mix takes twice has the same ones twice."""
    bound_batches(spark)
    return segmentation.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", tokens),
]

#: The classifier is trained and the segmentations are sampled: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
