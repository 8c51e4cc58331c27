"""JavaScript and TypeScript: source files of npm packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, depth, eligible_npm_root, npm_root, parent
from ..schema import Scope
from .joins import containing, fits_broadcast, sized_join


def _below_roots(facts: DataFrame, kind: str, scope: Scope) -> DataFrame:
    below = facts.where(F.col("kind") == kind).withColumn("root", npm_root(F.col("path")))
    return below.where(eligible_npm_root(F.col("root"), scope.homes, scope.excluded))


def npm_roots(files: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """``(root)``: the outermost ``node_modules`` directories that are searched."""
    root = npm_root(F.col("path"))
    roots = files.select(root.alias("root")).distinct()
    return roots.where(eligible_npm_root(F.col("root"), scope.homes, scope.excluded))


def _manifests(facts: DataFrame, scope: Scope) -> DataFrame:
    """Manifests in directories that are searched: no hidden one below the root."""
    inside = F.substring(F.col("dir"), F.length("root") + 1, F.length("dir"))
    return _below_roots(facts, "manifest", scope).where(~inside.contains("/."))


def _topmost(manifests: DataFrame, small: bool) -> DataFrame:
    """Manifests that no other manifest lies above, valid or not."""
    folders = manifests.select("dir", "root")
    proper = ancestors(F.col("dir"), depth(F.col("root")), depth(F.col("dir")) - 1)
    shadowed = sized_join(
        folders.select("dir", F.explode(proper).alias("above")),
        folders.select(F.col("dir").alias("above")),
        "above",
        "dir",
        "left_semi",
        small,
    )
    # One row per directory on both sides, so neither can be skewed.
    return manifests.join(shadowed.select("dir").distinct(), "dir", "left_anti")


def _packages(manifests: DataFrame, small: bool) -> DataFrame:
    relative = F.replace(F.col("path"), F.col("root"), F.lit(""))
    valid = F.col("name").isNotNull() & F.col("version").isNotNull()
    return _topmost(manifests, small).where(valid).select(
        "root",
        parent(F.concat("root", relative)).alias("dir"),
        relative.alias("manifest"),
        "name",
        "version",
    )


def npm_packages(
    facts: DataFrame, scope: Scope = Scope(), small: bool | None = None
) -> DataFrame:
    """``(root, dir, manifest, name, version)`` of the topmost valid packages.

    ``manifest`` is the path of the manifest without the root. ``small`` tells
    that the manifests were measured to fit a broadcast.
    """
    manifests = _manifests(facts, scope)
    return _packages(manifests, fits_broadcast(manifests) if small is None else small)


def npm_rejects(
    facts: DataFrame, scope: Scope = Scope(), small: bool | None = None
) -> DataFrame:
    """Topmost manifests without a usable name and version."""
    manifests = _manifests(facts, scope)
    small = fits_broadcast(manifests) if small is None else small
    bad = _topmost(manifests, small).where(F.col("name").isNull() | F.col("version").isNull())
    return bad.select(
        "path", F.lit("javascript").alias("stage"), F.lit("bad manifest").alias("reason")
    )


def npm_modules(
    facts: DataFrame, scope: Scope = Scope(), small: bool | None = None
) -> DataFrame:
    """``(root, package, version, name, path)`` of every source of a package.

    The name is the path below the root. Nested ``node_modules`` and hidden
    directories inside a package are included.
    """
    manifests = _manifests(facts, scope)
    # A bound of the manifests is one of the packages.
    small = fits_broadcast(manifests) if small is None else small
    owners = _packages(manifests, small).select(
        F.col("dir").alias("owner"), F.col("name").alias("package"), "version"
    )
    sources = _below_roots(facts, "js", scope).select("path", "dir", "root")
    root_depth = depth(npm_root(F.concat("dir", F.lit("/"))))
    owned = containing(sources, owners, root_depth, small)
    name = F.substring(F.col("path"), F.length("root") + 2, F.length("path"))
    return owned.select("root", "package", "version", name.alias("name"), "path")
