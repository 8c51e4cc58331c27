"""Source archives: Maven artifacts and the JDK, and where each is extracted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base, ends_with_any, parent, under

#: Endings of the archives that are extracted.
ARTIFACT_SUFFIXES = ("-javadoc.jar", "-sources.jar")
#: Fixed value: output directory of the JDK sources of one machine and version.
JDK_OUT_DIR = "sources/jdk"
#: Fixed value: directory that holds the installed JDKs of a machine.
JVM_ROOT = "/usr/lib/jvm"


def _parsed(files: DataFrame, repos: Sequence[str]) -> DataFrame:
    """Artifact archives with their coordinates; ``group_id`` is null when not parsed.

    The repository is the rightmost ``repository`` component that has an
    artifact, a version and a file after it.
    """
    path = F.col("path")
    found = files.where(ends_with_any(path, ARTIFACT_SUFFIXES) & under(path, repos)).select("path")
    parts = F.split(path, "/")
    head = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 3, F.lit(0)))
    from_end = F.array_position(F.reverse(head), "repository").cast("int")
    artifact, version = F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2))
    stem = F.regexp_replace(base(path), r"\.[^.]*\z", "")
    start = F.concat(artifact, F.lit("-"), version, F.lit("-"))
    rest = F.substring(stem, F.length(start) + 1, F.length(stem))
    group = F.array_join(
        F.slice(head, F.size(head) - from_end + 2, F.greatest(from_end - 1, F.lit(0))), "."
    )
    return found.select(
        "path",
        F.when(from_end > 0, group).alias("group_id"),
        artifact.alias("artifact_id"),
        version.alias("version"),
        F.when(stem.startswith(start), rest).otherwise("").alias("classifier"),
    )


def artifacts(files: DataFrame, repos: Sequence[str] = ("/",)) -> DataFrame:
    """``(path, group_id, artifact_id, version, classifier, out_dir)``.

    ``repos`` limits the search to given roots.
    """
    out_dir = F.concat_ws(
        "/",
        F.nullif("classifier", F.lit("")),
        F.nullif(F.replace(F.col("group_id"), F.lit("."), F.lit("/")), F.lit("")),
        "artifact_id",
        "version",
    )
    parsed = _parsed(files, repos).where(F.col("group_id").isNotNull())
    return parsed.withColumn("out_dir", out_dir)


def artifact_rejects(files: DataFrame, repos: Sequence[str] = ("/",)) -> DataFrame:
    """Archives whose path is no artifact path."""
    bad = _parsed(files, repos).where(F.col("group_id").isNull())
    return bad.select("path", F.lit("maven").alias("stage"), F.lit("bad path").alias("reason"))


def new_artifacts(found: DataFrame, extracted: DataFrame) -> DataFrame:
    """Artifacts still to be extracted.

    ``extracted(out_dir)`` are done. Of several artifacts with one output
    directory the first by path components is taken, as the directory exists
    once that one is extracted.
    """
    first = found.groupBy("out_dir").agg(
        F.min_by(F.struct(*[c for c in found.columns if c != "out_dir"]), F.split("path", "/")).alias("first")
    )
    done = extracted.select("out_dir").distinct()
    return first.join(done, "out_dir", "left_anti").select("first.*", "out_dir")


def jdk_archives(
    files: DataFrame, versions: Sequence[str], jvm_root: str = JVM_ROOT
) -> DataFrame:
    """``(jvm_root, version, path)``: the JDK source archive of each version.

    A corpus may hold several machines, so every directory that is or ends
    with ``jvm_root`` is searched. In each, the first JDK by name whose name is
    ``java-<version>`` or goes on with a non-digit is taken.
    """
    path = F.col("path")
    sources = files.where(path.contains(jvm_root + "/") & path.endswith("/lib/src.zip"))
    home = parent(parent(path))
    named = sources.select(
        "path", base(home).alias("jdk"), parent(home).alias("jvm_root")
    ).where(F.col("jvm_root").endswith(jvm_root))
    wanted = F.explode(F.array(*[F.lit(v) for v in versions])).alias("version")
    start = F.concat(F.lit("java-"), F.col("version"))
    after = F.substring(F.col("jdk"), F.length(start) + 1, F.lit(1))
    matches = named.select("*", wanted).where(
        F.col("jdk").startswith(start) & ~after.rlike("[0-9]")
    )
    return matches.groupBy("jvm_root", "version").agg(F.min_by("path", "jdk").alias("path"))


def jdk_out_dir(jvm_root: Column, version: Column) -> Column:
    """A directory per machine and version: ``sources/<version><machine's root>/jdk``.

    The last component is the one after which packages of the JDK are read.
    """
    top, last = JDK_OUT_DIR.rsplit("/", 1)
    return F.concat(F.lit(top + "/"), version, jvm_root, F.lit("/" + last))


def java_sources(found: DataFrame, jdks: DataFrame) -> DataFrame:
    """``(path, out_dir)`` of every archive to extract: artifacts and JDKs.

    An output directory takes one archive, the first by path components, so
    files of different machines never share a path.
    """
    jdk = jdks.select("path", jdk_out_dir(F.col("jvm_root"), F.col("version")).alias("out_dir"))
    every = found.select("path", "out_dir").unionByName(jdk)
    return every.groupBy("out_dir").agg(F.min_by("path", F.split("path", "/")).alias("path")).select("path", "out_dir")


def source_trees(found: DataFrame) -> DataFrame:
    """Artifacts whose extracted tree is read for Java symbols."""
    return found.where(F.col("classifier") == "sources")
