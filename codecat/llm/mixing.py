"""Mixing sources to target weights by hash-threshold histograms.

Every document has a uniform hash. Taking all documents of a source whose hash is
below a threshold is a random sample without sorting, and a larger budget takes a
superset of a smaller one. The threshold is found from histograms: words are summed
by source and the leading hash bits, the bucket in which the budget is reached is
found, and only that bucket is summed again by its next bits.

Per level a source has at most ``2 ** BITS`` sums, combined before the shuffle, so a
hot source costs no more than a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .words import WORD

#: Hash bits per level, and levels. After all of them a bucket is a single hash value.
BITS, LEVELS = 12, 4
#: Weights dealt to the sources in code point order, again and again.
WEIGHTS = (3, 1, 2)


def row_hash(id_col: Column, text: Column, seed: int) -> Column:
    """48 uniform bits of id, text and seed."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``target`` to ``source, source_size``: ``share`` of all words by weight.

    A target stops at ``most`` times its source's size, and the excess goes to the others by weight
    until none is above. That fixed point is reached in one pass: by rising cap per weight, sources
    stay capped as long as their cap is below the even level of what is left. The two windows have
    no partition, over one narrow row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).alias("_weight"),
        (F.col("source_size") * F.lit(float(most))).alias("_cap"),
    ).withColumn("_rise", F.col("_cap") / F.col("_weight"))
    rising = Window.orderBy("_rise", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    levels = ranked.select(
        "*",
        (
            (
                F.sum("source_size").over(everything) * F.lit(float(share))
                - F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            )
            / F.sum("_weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
        ).alias("_level"),
    )
    even = F.max(F.when(F.col("_rise") > F.col("_level"), F.col("_level"))).over(everything)
    return levels.select("*", even.alias("_even")).select(
        "source",
        "source_size",
        F.when(F.col("_rise") <= F.col("_level"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_even")).alias("target"),
    )


def mix(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, times, taken``.

    ``size`` counts words, ``times`` says how often the mix takes the document, ``taken`` is their
    product. A source whose target exceeds its size is taken whole as often as it fits; the rest of
    the target is filled by the hash threshold, to within half a document.

    The tables of sources are stored, so Spark knows their size and joins small ones without moving rows.

    Defined results: a null text has size 0 and is taken along for nothing; a null source is a source
    of its own; null ids are told apart by their texts; rows equal in id and text share one hash and
    so one fate; an empty table gives no rows; other columns are not looked at.
    """
    rows = measured(docs, seed, id_col, text_col, source_col)
    sources = sources_with_thresholds(rows, share, most, weights)
    return (
        rows.alias("r")
        .join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "size", "source_size", "target", times().alias("times"), (F.col("size") * times()).alias("taken"))
    )


def times() -> Column:
    """How often a row with ``hash`` is taken from its source."""
    return F.col("base") + F.coalesce((F.col("hash") < F.col("threshold")).cast("long"), F.lit(0))


def measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The narrow table ``doc_id, source, size, hash`` that all sums are taken from."""
    return staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            row_hash(F.col(id_col), F.col(text_col), seed).alias("hash"),
        ),
        "mix",
    )


def thresholds(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per source ``source, source_size, target, base, budget, threshold``: rows are taken ``base`` times, and once
    more if their hash is below the threshold."""
    return sources_with_thresholds(measured(docs, seed, id_col, text_col, source_col), share, most, weights)


def sources_with_thresholds(rows: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    sources = staged(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
        .withColumn("base", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")),
        "mix-targets",
    )
    # Without a budget there is no threshold: not even documents without words are taken once more.
    at = sources.where("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("used"))
    for level in range(LEVELS):
        inside = rows.select("source", "size", F.shiftright("hash", BITS * (LEVELS - level)).alias("prefix"),
                             F.shiftright("hash", BITS * (LEVELS - 1 - level)).alias("next"))
        at = staged(boundary(inside, at), "mix-boundary")
    threshold = at.select(
        F.col("source"),
        (
            F.col("prefix")
            + (F.col("used") + F.col("last") - F.col("budget") < F.col("budget") - F.col("used")).cast("long")
        ).alias("threshold"),
    )
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    return staged(sources.alias("s").join(threshold.alias("t"), same, "left").select("s.*", "t.threshold"), "mix-thresholds")


def boundary(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Per source, the sub-bucket of the boundary bucket ``prefix`` in which its budget is reached.

    ``used`` counts the words below it and ``last`` those in it. Only rows of boundary buckets are summed.
    """
    key = F.col("r.source").eqNullSafe(F.col("a.source")) & (F.col("r.prefix") == F.col("a.prefix"))
    sums = (
        rows.alias("r")
        .join(at.alias("a"), key)
        .groupBy("r.source", "a.budget", "a.used", "r.next")
        .agg(F.sum("r.size").alias("words"))
    )
    up_to = Window.partitionBy("source").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
    reached = sums.withColumn("below", F.col("used") + F.sum("words").over(up_to) - F.col("words"))
    first = reached.where(F.col("below") + F.col("words") > F.col("budget")).groupBy("source").agg(
        F.min_by(F.struct("budget", "next", "below", "words"), "next").alias("b")
    )
    return first.select("source", "b.budget", F.col("b.next").alias("prefix"), F.col("b.below").alias("used"), F.col("b.words").alias("last"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, **options) -> DataFrame:
    """The rows of ``docs`` as often as :func:`mix` takes them, with all their columns.

    The threshold of a source is applied to the rows as they are read; they do not move.

    Defined results: documents without words are taken as often as their source is taken whole, so not at all where a source has no words; rows equal in
    id and text share one fate; a null source is a source of its own; columns of any name are handed on; an empty table gives no rows.
    """
    chosen = thresholds(docs, id_col=id_col, text_col=text_col, seed=seed, **options)
    source = F.col(options.get("source_col", "source"))
    rows = docs.select(F.struct("*").alias("_doc"), source.alias("_source"), row_hash(F.col(id_col), F.col(text_col), seed).alias("hash"))
    joined = rows.alias("r").join(chosen.alias("s"), F.col("r._source").eqNullSafe(F.col("s.source")))
    copies = F.explode(F.array_repeat(F.lit(0), times().cast("int")))
    return joined.select("_doc", copies).select("_doc.*")
