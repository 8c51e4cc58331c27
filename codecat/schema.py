"""Table schemas and the settings shared by all catalogue jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


FILES = _strings("path", "content")
ARCHIVES = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())]
)
CATALOGUE = _strings("language", "name", "path")
REJECTS = _strings("path", "stage", "reason")
#: Output directories of the archives that were expanded.
EXTRACTED = _strings("out_dir")

#: The key on which a catalogue row is unique.
CATALOGUE_KEY = ["language", "name", "path"]

#: Stored form of the catalogue. ``name_lc`` is the name with ASCII letters
#: lower-cased, so that a search is a predicate on a plain column.
CATALOGUE_TABLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("name_lc", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)

#: The languages and their codes.
LANGUAGE_CODES = {"java": 0, "python": 1, "javascript": 2, "go": 3}


@dataclass(frozen=True)
class Scope:
    """Where in the corpus to look. A corpus may hold the trees of many machines.

    ``homes``
        Roots below which Python environments and npm roots are searched.
    ``go_paths``
        Roots below which Go modules are searched.
    ``java_sources``
        Directory under which extracted Java sources lie; a Java file counts
        when its path contains this text.
    ``excluded``
        Path parts that rule out an npm root.
    ``jdk_fix``
        When true, keep ``jdk`` components below the JDK module directory in
        the package name instead of dropping each with its successor.
    """

    homes: tuple[str, ...] = ("/",)
    go_paths: tuple[str, ...] = ("/",)
    java_sources: str = "/java/sources/"
    excluded: tuple[str, ...] = ("/anaconda3/",)
    jdk_fix: bool = False
