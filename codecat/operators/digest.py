"""The one pass over file contents.

A digest keeps a narrow row per relevant file: its path, its kind, and the few
facts that are read from contents. All joins run on digests, so contents are
scanned once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code, paths
from ..schema import Scope
from .joins import fitting_groups

#: Marker files by kind.
MARKERS = {
    "pyvenv.cfg": "venv",
    "package.json": "manifest",
    "go.mod": "gomod",
}
#: Endings of source files.
JS_SUFFIXES = (".js", ".ts", ".jsx", ".tsx")
#: Java files that declare no type.
JAVA_NON_CODE = ("package-info.java", "module-info.java")

#: Kinds that each language reads.
KINDS = {
    "java": ("java",),
    "python": ("venv", "python", "env"),
    "javascript": ("manifest", "js"),
    "go": ("gomod", "go"),
}

#: Those of them whose contents are read.
READ_KINDS = {"java": ("java",), "python": (), "javascript": ("manifest",), "go": ("gomod",)}


def is_go_source(path: Column) -> Column:
    """A Go file that is not a test."""
    return path.endswith(".go") & ~paths.base(path).contains("_test.go")


def is_java_source(path: Column, scope: Scope) -> Column:
    """A Java file with code in an extracted sources tree."""
    in_tree = path.contains(scope.java_sources)
    return path.endswith(".java") & in_tree & ~paths.base(path).isin(*JAVA_NON_CODE)


def file_kind(path: Column, scope: Scope = Scope()) -> Column:
    """Kind of a file; null when no language reads it.

    ``env`` marks other files below a ``site-packages`` directory: they are
    never listed, but show that the directory is there.
    """
    kind = F.when(paths.base(path) == "pyvenv.cfg", "venv")
    for name in ("package.json", "go.mod"):
        kind = kind.when(paths.base(path) == name, MARKERS[name])
    return (
        kind.when(is_java_source(path, scope), "java")
        .when(path.endswith(".py"), "python")
        .when(paths.ends_with_any(path, JS_SUFFIXES), "js")
        .when(is_go_source(path), "go")
        .when(path.contains("/site-packages/"), "env")
    )


def digest(
    files: DataFrame,
    scope: Scope = Scope(),
    kinds: Collection[str] | None = None,
    read: Collection[str] = ("java", "manifest", "gomod"),
) -> DataFrame:
    """Reduce ``files(path, content)`` to facts. Lazy; unused facts are pruned.

    ``kinds`` limits the rows, ``read`` the kinds whose contents count; the facts of
    others are null, and if no kind is read, contents are not scanned.
    """
    return _facts(files, scope, kinds, read, [])


def _facts(files: DataFrame, scope: Scope, kinds: Collection[str] | None, read: Collection[str], kept: list[str]) -> DataFrame:
    """Facts of each row; the columns ``kept`` come along, and rows with a reason are passed on without a kind."""
    path, kind = F.col("path"), F.col("kind")
    content = F.col("content") if read else F.lit(None).cast("string").alias("content")
    known = files.select("path", content, file_kind(path, scope).alias("kind"), *kept)
    content = F.col("content")
    wanted = kind.isNotNull() if kinds is None else kind.isin(*kinds)
    known = known.where(wanted | F.col("reason").isNotNull() if "reason" in kept else wanted)
    # Raw values are a projection of their own, so that each is computed once.
    raw = known.select(
        "path",
        paths.parent(path).alias("dir"),
        "kind",
        F.when(kind == "java", code.declared_package(content)).alias("package"),
        F.when(kind == "java", code.java_types(content)).alias("types"),
        F.when(kind == "manifest", code.parsed_manifest(content)).alias("manifest"),
        F.when(kind == "gomod", code.declared_module(content)).alias("module"),
        *kept,
    )
    package = code.java_package(path, F.col("package"), scope.jdk_fix)
    return raw.select(
        "path",
        "dir",
        "kind",
        F.when(kind == "java", package).alias("package"),
        "types",
        code.manifest_text(F.col("manifest"), "name").alias("name"),
        code.manifest_text(F.col("manifest"), "version").alias("version"),
        code.go_module(F.col("module")).alias("module"),
        *kept,
    )


FACTS = ["path", "dir", "kind", "package", "types", "name", "version", "module"]


def read_parts(expanded: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Facts of each row of ``expanded(archive, path, part, more, content, reason)``, and its rejects, in one pass.

    To be stored, so that contents are read once; :func:`joined_parts` and the rejects then come from it.
    """
    text = F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    kept = ["archive", "part", "more", "reason"]
    return _facts(expanded.select("path", text, *kept), scope, None, ("java", "manifest", "gomod"), kept)


def joined_parts(read: DataFrame) -> DataFrame:
    """The digest of the files in ``read``, as :func:`digest` has it of whole contents.

    Of files in parts the first package and module count, and all types in order. Only their facts are grouped. A file
    whose reading ended with a reason has the facts of the parts before.
    """
    accepted = read.where(F.col("reason").isNull() & F.col("kind").isNotNull())
    whole = accepted.where((F.col("part") == 0) & ~F.col("more"))
    parts = accepted.where((F.col("part") > 0) | F.col("more"))

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("part"))).alias(name)

    def same(name: str) -> Column:
        return F.first(name).alias(name)

    ordered = F.sort_array(F.collect_list(F.struct("part", "types")))
    types = F.array_distinct(F.flatten(F.transform(ordered, lambda p: p["types"])))
    grouped = parts.groupBy("path").agg(
        same("dir"), same("kind"), first("package"), F.when(F.first("kind") == "java", types).alias("types"),
        first("name"), first("version"), first("module"),
    )
    return whole.select(FACTS).unionByName(grouped.select(FACTS))


def digest_parts(expanded: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """The digest of files that may come in parts."""
    return joined_parts(read_parts(expanded, scope))


def small_markers(facts: DataFrame) -> set[str]:
    """Kinds of marker files that are few enough to broadcast, by one measure.

    This bounds all that is derived from them one to one: environments,
    packages and modules.
    """
    columns = ["path", "dir", "kind", "name", "version", "module"]
    return fitting_groups(facts.select(*columns), "kind", list(MARKERS.values()))
