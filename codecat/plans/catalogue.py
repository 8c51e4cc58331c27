"""Build the catalogue and keep it as a table."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import lower_ascii
from ..operators.digest import KINDS, READ_KINDS, digest, small_markers
from ..operators.gomod import go_files, go_rejects
from ..operators.java import java_rejects, java_symbols
from ..operators.joins import fits_broadcast
from ..operators.npm import npm_modules, npm_rejects
from ..operators.python_env import python_modules, python_rejects
from ..schema import CATALOGUE, CATALOGUE_KEY, CATALOGUE_TABLE, REJECTS, Scope
from ..sources.scratch import scratch_space, staged
from ..sources.tables import add_rows, stored
from .keys import add_keys, without_stored
from .postings import add_postings, open_postings


def documents_of(
    facts: DataFrame,
    languages: Collection[str] | None = None,
    scope: Scope = Scope(),
    small: Collection[str] | None = None,
) -> DataFrame:
    """Distinct ``(language, name, path)`` of a digest.

    Languages are matched case-sensitively; an unknown one adds nothing.
    ``small`` is the outcome of :func:`small_markers`, if known.
    """
    small = small_markers(facts) if small is None else small
    producers = {
        "java": lambda: java_symbols(facts),
        "python": lambda: python_modules(facts, scope, "venv" in small),
        "javascript": lambda: npm_modules(facts, scope, "manifest" in small),
        "go": lambda: go_files(facts, scope, small="gomod" in small),
    }
    parts = [
        produce().select(F.lit(language).alias("language"), "name", "path")
        for language, produce in producers.items()
        if languages is None or language in languages
    ]
    if not parts:
        return facts.sparkSession.createDataFrame([], CATALOGUE)
    return reduce(DataFrame.unionByName, parts).distinct()


def rejects_of(
    facts: DataFrame,
    languages: Collection[str] | None = None,
    scope: Scope = Scope(),
    small: Collection[str] | None = None,
) -> DataFrame:
    """``(path, stage, reason)`` of the inputs that yield nothing."""
    small = small_markers(facts) if small is None else small
    producers = {
        "java": lambda: java_rejects(facts),
        "python": lambda: python_rejects(facts, scope, "venv" in small),
        "javascript": lambda: npm_rejects(facts, scope, "manifest" in small),
        "go": lambda: go_rejects(facts, scope),
    }
    parts = [
        produce()
        for language, produce in producers.items()
        if languages is None or language in languages
    ]
    if not parts:
        return facts.sparkSession.createDataFrame([], REJECTS)
    return reduce(DataFrame.unionByName, parts)


def _kinds(languages: Collection[str] | None) -> list[str] | None:
    """File kinds to digest; Python needs all, as any file can show a package directory."""
    if languages is None or "python" in languages:
        return None
    return [kind for language in KINDS if language in languages for kind in KINDS[language]]


def _with_contents(languages: Collection[str] | None) -> list[str]:
    """File kinds whose contents are read; Python goes by paths alone."""
    return [kind for language in KINDS if languages is None or language in languages for kind in READ_KINDS[language]]


def build_catalogue(
    files: DataFrame,
    languages: Collection[str] | None = None,
    scope: Scope = Scope(),
    stage: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(catalogue, rejects)`` of a corpus ``files(path, content)``.

    With ``stage`` the corpus is scanned once and its digest is written to a
    scratch table partitioned by kind, from which all producers read. Without
    it the plans are fully lazy and every producer scans the corpus.
    """
    facts = digest(files, scope, _kinds(languages), _with_contents(languages))
    if stage:
        facts = staged(facts, "digest", "kind")
    small = small_markers(facts)
    return documents_of(facts, languages, scope, small), rejects_of(facts, languages, scope, small)


def open_catalogue(spark: SparkSession, table: str) -> DataFrame:
    """The stored catalogue; empty when there is none yet."""
    return stored(spark, table, CATALOGUE_TABLE)


def _write(documents: DataFrame, table: str, mode: str) -> None:
    """Store documents by language, in ranges of the lower-cased name.

    Each file holds a range of names, in order, so a search for a whole name skips
    files as well as row groups. The rows are stored first: finding the ranges
    reads them once more. A table with postings keeps them: those of added rows come first, so a
    run that was cut off leaves too many at worst; those of a new table come last, and are missing until then.
    Stored keys are kept up, too.
    """
    spark = documents.sparkSession
    kept = open_postings(spark, table) is not None
    with scratch_space(spark, "ranges") as work:
        rows = documents.select("name", "path", lower_ascii(F.col("name")).alias("name_lc"), "language")
        rows = staged(rows, "rows", under=work)
        if kept and mode == "append":
            add_postings(rows, table)
        (
            rows.repartitionByRange("language", "name_lc")
            .sortWithinPartitions("language", "name_lc")
            .write.mode(mode)
            .partitionBy("language")
            .parquet(table)
        )
        if kept and mode == "overwrite":
            add_postings(rows, table, "overwrite")
        if mode == "append":
            add_keys(rows, table)


def build_postings(spark: SparkSession, table: str) -> None:
    """Give a stored catalogue postings, which its inserts keep up from then on."""
    add_postings(open_catalogue(spark, table), table, "overwrite")


def reset_catalogue(documents: DataFrame, table: str) -> None:
    """Replace the whole table, all languages."""
    _write(documents.select(*CATALOGUE_KEY).distinct(), table, "overwrite")


def upsert_catalogue(documents: DataFrame, table: str) -> None:
    """Append the documents whose key is not stored yet. One writer at a time.

    When the documents are measured small, the stored keys among them are
    found map-side; otherwise they are shuffled to the buckets of the stored keys (:mod:`codecat.plans.keys`).
    Either way the stored side is scanned but not shuffled.
    """
    spark = documents.sparkSession
    new = documents.select(*CATALOGUE_KEY).distinct()
    stored_rows = open_catalogue(spark, table).select(*CATALOGUE_KEY)
    if stored_rows.isEmpty():
        _write(new, table, "append")
        return
    with scratch_space(spark, "upsert") as work:
        new = staged(new, "new", under=work)
        if fits_broadcast(new):
            known = stored_rows.join(F.broadcast(new), CATALOGUE_KEY, "left_semi")
            _write(new.join(known, CATALOGUE_KEY, "left_anti"), table, "append")
        else:
            without_stored(new, table, stored_rows, lambda rows: _write(rows, table, "append"))


def index(
    files: DataFrame,
    table: str,
    languages: Collection[str] | None = None,
    remove: bool = False,
    scope: Scope = Scope(),
    rejects: str | None = None,
) -> None:
    """Build and store: insert-or-ignore, or with ``remove`` start afresh.

    ``remove`` drops all languages, also when only some are built. ``rejects`` names a table ``(path, stage, reason)`` of
    the inputs that yield nothing, kept in the same way, from the same pass over the corpus. It is written
    after the catalogue, so a run that was cut off is done again.
    """
    spark = files.sparkSession
    with scratch_space(spark, "index") as work:
        facts = digest(files, scope, _kinds(languages), _with_contents(languages))
        facts = staged(facts, "digest", "kind", under=work)
        small = small_markers(facts)
        documents = documents_of(facts, languages, scope, small)
        if remove:
            reset_catalogue(documents, table)
        else:
            upsert_catalogue(documents, table)
        if rejects is not None:
            refused = rejects_of(facts, languages, scope, small).distinct()
            if remove:
                refused.write.mode("overwrite").parquet(rejects)
            else:
                add_rows(refused, rejects, REJECTS)


def catalogue_counts(catalogue: DataFrame) -> DataFrame:
    """``(language, documents)``."""
    return catalogue.groupBy("language").agg(F.count(F.lit(1)).alias("documents"))
