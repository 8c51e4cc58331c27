"""Index a corpus together with the source archives that it holds."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.digest import digest, joined_parts, read_parts
from ..operators.maven import artifact_rejects, artifacts, java_sources, jdk_archives
from ..schema import EXTRACTED, REJECTS, Scope
from ..sources.archives import expand_archives, expand_mounted, expansion_rejects
from ..sources.scratch import scratch_space, staged
from ..sources.tables import add_rows, stored
from .catalogue import documents_of, rejects_of, reset_catalogue, upsert_catalogue


def index_with_archives(
    spark: SparkSession,
    archives: DataFrame,
    table: str,
    state: str,
    files: DataFrame | None = None,
    root: str = "/java",
    versions: Sequence[str] = ("17",),
    languages: Collection[str] | None = None,
    remove: bool = False,
    scope: Scope = Scope(),
) -> None:
    """Expand new archives below ``root``, index them with ``files``, and keep what was done.

    ``archives`` are ``(path, content)``, or ``(path)`` alone where executors see
    them as files. Below ``state`` two tables are kept: ``extracted(out_dir)``, so
    that a second run expands nothing twice, and ``rejects(path, stage, reason)``
    of all stages. They are written after the catalogue, so a run that was cut
    off is done again. ``remove`` starts afresh: all archives, rejects and documents.
    """
    paths = archives.select("path")
    done = stored(spark, f"{state}/extracted", EXTRACTED)
    wanted = java_sources(artifacts(paths), jdk_archives(paths, versions))
    with scratch_space(spark, "archives") as work:
        if not remove:
            wanted = wanted.join(done, "out_dir", "left_anti")
        wanted = staged(wanted, "new", under=work)
        in_place = "content" not in archives.columns
        expanded = expand_mounted(wanted, root) if in_place else expand_archives(archives, wanted, root)
        # Contents are read on their way out of the archives and not stored: only facts and rejects are.
        read = staged(read_parts(expanded, scope), "read", under=work)
        fresh = joined_parts(read)
        every = fresh if files is None else fresh.unionByName(digest(files, scope))
        facts = staged(every, "digest", "kind", under=work)
        documents = documents_of(facts, languages, scope)
        rejects = rejects_of(facts, languages, scope).unionByName(artifact_rejects(paths)).unionByName(expansion_rejects(read))
        if remove:
            reset_catalogue(documents, table)
            rejects.distinct().write.mode("overwrite").parquet(f"{state}/rejects")
            wanted.select("out_dir").write.mode("overwrite").parquet(f"{state}/extracted")
        else:
            upsert_catalogue(documents, table)
            add_rows(rejects, f"{state}/rejects", REJECTS)
            add_rows(wanted, f"{state}/extracted", EXTRACTED)


def rejects(spark: SparkSession, state: str) -> DataFrame:
    """The stored ``(path, stage, reason)`` of all runs."""
    return stored(spark, f"{state}/rejects", REJECTS)


def extracted(spark: SparkSession, state: str) -> DataFrame:
    """The stored ``(out_dir)`` of all runs."""
    return stored(spark, f"{state}/extracted", EXTRACTED)
