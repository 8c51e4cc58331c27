"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Two texts are equal when they are identical after each run of white space
(space, U+0009 to U+000D) is replaced by one space. A null text counts as empty.

* Round one groups by the normalised length, round two by length and a hash of
  the first characters. Both are counts over a stored table of narrow rows, from one scan.
* Round three reads the whole text, but only of rows whose group still has
  another member, and groups them by SHA-256.

Texts do not move. The groups that are left are broadcast to the second scan if they were measured to fit;
otherwise it hashes all texts where they lie, which costs less than moving them. No group is gathered: each round is a combined
aggregate whose one row per key is joined back to narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast, key_filter, marked
from ..sources.scratch import staged
from .words import SPACE

#: Characters that the second round looks at.
PREFIX = 256


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, prefix: int = PREFIX
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the smallest id among the equal texts. ``text_sha256`` is null for a row that an
    earlier round proved unique, unless ``digest_all``.

    Defined results: rows that repeat an id and a text count as copies, one of which is kept; a null
    id comes after all others, and where all ids of a group are null one row is kept and ``keep_id``
    is null; texts without words are equal to each other only if their normalised forms are; an empty
    table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("_text")).select(
        "doc_id",
        "_text",
        F.length("_text").alias("_length"),
        F.xxhash64(F.substring("_text", 1, prefix)).alias("_prefix"),
    )
    full = F.sha2(F.col("_text").cast("binary"), 256)
    facts = ["doc_id", "_length", "_prefix"]
    narrow = staged(rows.select(*facts, *([full.alias("text_sha256")] if digest_all else [])), "exact-facts")
    lengths = narrow.groupBy("_length").count().where("count > 1").select("_length")
    heads = (
        narrow.join(lengths, "_length", "left_semi")
        .groupBy("_length", "_prefix")
        .count()
        .where("count > 1")
        .select("_length", "_prefix", F.lit(True).alias("_shared"))
    )
    heads = staged(heads, "exact-heads")
    digest = F.col("text_sha256")
    if digest_all:
        marked = narrow.join(heads, ["_length", "_prefix"], "left")
    elif fits_broadcast(heads):
        marked = rows.join(F.broadcast(heads), ["_length", "_prefix"], "left")
        digest = F.when(F.col("_shared"), full)
    else:
        marked = rows.select(*facts, full.alias("text_sha256")).join(heads, ["_length", "_prefix"], "left")
        digest = F.when(F.col("_shared"), digest)
    hashed = staged(marked.select(*facts, digest.alias("text_sha256"), F.coalesce("_shared", F.lit(False)).alias("_shared")), "exact")
    key = ["_length", "_prefix", "text_sha256"]
    per_id = hashed.groupBy("doc_id", "_shared", *key).agg(F.count(F.lit(1)).alias("_rows"))
    groups = (
        per_id.where("_shared")
        .groupBy(*key)
        .agg(F.min("doc_id").alias("keep_id"), F.sum("_rows").alias("group_size"), F.lit(True).alias("_shared"))
    )
    return per_id.join(groups, [*key, "_shared"], "left").select(
        "doc_id",
        F.when(F.col("_shared"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", "_rows").alias("group_size"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"),
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Only ids travel to the rows: those of dropped texts, stored once so that Spark knows their size. Texts are hashed
    again only where an id is among them. Where these are too many to broadcast, a filter of fixed size tells the rows that may
    have one, and only those are shuffled.

    Defined results: null texts are equal to empty ones; of rows that repeat an id and a text one stays; a null id gives way to any other, and of
    null ids alone one row stays; columns of any name are handed on; an empty table gives no rows.
    """
    found = exact_duplicates(docs, id_col, text_col).where("text_sha256 is not null")
    verdict = found.groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows")
    )
    odd = staged(verdict.where("not _kept or _rows > 1"), "dropped")
    digest = F.sha2(normalised(F.col("_text")).cast("binary"), 256)
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("doc_id"))
    if fits_broadcast(odd):
        # The digest depends on both sides, so it is no key of the join: it is computed where ids meet.
        near, far = rows, None
        same &= F.when(F.col("text_sha256").isNotNull(), digest) == F.col("text_sha256")
    else:
        # Most rows have none of these ids, and stay where they lie; the others' digests are keys.
        rows = marked(rows, "_id", key_filter(odd, "doc_id"))
        near, far = rows.where("_likely").select("_doc", "_id", digest.alias("_digest")), rows.where("not _likely")
        same &= F.col("_digest") == F.col("text_sha256")
    single = near.join(odd, same, "left_anti").select("_doc")
    repeated = odd.where("_kept")
    if not repeated.isEmpty():
        again = near.join(repeated, same, "left_semi")
        again = again if far is not None else again.withColumn("_digest", digest)
        single = single.unionByName(again.dropDuplicates(["_id", "_digest"]).select("_doc"))
    if far is not None:
        single = single.unionByName(far.select("_doc"))
    return single.select("_doc.*")
