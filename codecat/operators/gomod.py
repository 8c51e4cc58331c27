"""Go: source files named by the modules that contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import under
from ..schema import Scope
from .joins import containing


def _in_scope(facts: DataFrame, kind: str, scope: Scope) -> DataFrame:
    return facts.where((F.col("kind") == kind) & under(F.col("path"), scope.go_paths))


def go_modules(facts: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """``(mod_dir, module)`` of each ``go.mod`` that names its module."""
    named = _in_scope(facts, "gomod", scope).where(F.col("module").isNotNull())
    return named.select(F.col("dir").alias("mod_dir"), "module").distinct()


def go_rejects(facts: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """``go.mod`` files without a module name."""
    return (
        _in_scope(facts, "gomod", scope)
        .where(F.col("module").isNull())
        .select("path", F.lit("go").alias("stage"), F.lit("no module name").alias("reason"))
    )


def go_files(
    facts: DataFrame,
    scope: Scope = Scope(),
    modules: DataFrame | None = None,
    small: bool | None = None,
) -> DataFrame:
    """``(name, path)``: each Go file once per enclosing module.

    ``small`` tells that the modules were measured to fit a broadcast.
    """
    modules = go_modules(facts, scope) if modules is None else modules
    sources = _in_scope(facts, "go", scope).select("path", "dir")
    owned = containing(sources, modules.withColumnRenamed("mod_dir", "owner"), small=small)
    below = F.substring(F.col("path"), F.length("owner") + 1, F.length("path"))
    return owned.select(F.concat("module", below).alias("name"), "path")
