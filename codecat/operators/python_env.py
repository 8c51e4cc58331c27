"""Python: modules in the packages of virtual environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, depth, parent, prefixes_ending, under
from ..schema import Scope
from ..sources.scratch import staged
from .joins import sized_join

SITE_PACKAGES = "site-packages"


def _below_site_packages(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("path").contains(f"/{SITE_PACKAGES}/"))


def _outer_depth(site: Column) -> Column:
    """Depth of the nearest ``site-packages`` strictly above ``site``; 0 if none."""
    places = prefixes_ending(parent(site), SITE_PACKAGES)
    return F.coalesce(depth(F.try_element_at(places, F.lit(-1))), F.lit(0))


def virtual_envs(facts: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """``(venv)``: directories with an environment marker."""
    found = facts.where((F.col("kind") == "venv") & under(F.col("path"), scope.homes))
    return found.select(F.col("dir").alias("venv")).distinct()


def site_packages(
    facts: DataFrame, scope: Scope = Scope(), small: bool | None = None
) -> DataFrame:
    """``(venv, site_packages)``: the last package directory of each environment.

    A ``site-packages`` inside another one, as seen from the environment, does
    not count. "Last" is by comparison of path components, not of strings.
    ``small`` tells that the environments were measured to fit a broadcast.
    """
    sites = (
        _below_site_packages(facts)
        .select(F.explode(prefixes_ending(F.col("dir"), SITE_PACKAGES)).alias("site"))
        .distinct()
    )
    above = ancestors(F.col("site"), _outer_depth(F.col("site")) + 1)
    candidates = sites.select("site", F.explode(above).alias("venv"))
    owned = sized_join(candidates, virtual_envs(facts, scope), "venv", "site", small=small)
    return owned.groupBy("venv").agg(
        F.max_by("site", F.split("site", "/")).alias("site_packages")
    )


def python_modules(
    facts: DataFrame, scope: Scope = Scope(), small: bool | None = None
) -> DataFrame:
    """``(venv, site_packages, name, path)``: files beside an ``__init__.py``."""
    modules = _below_site_packages(facts.where(F.col("kind") == "python")).select("path", "dir")
    packages = (
        modules.where(F.col("path").endswith("/__init__.py"))
        .select("dir", F.explode(prefixes_ending(F.col("dir"), SITE_PACKAGES)).alias("site_packages"))
        .distinct()
    )
    # One row per environment: what bounds those, bounds these.
    sites = site_packages(facts, scope, small)
    owned = staged(sized_join(packages, sites, "site_packages", "dir", small=small), "packages")
    found = sized_join(modules, owned, "dir", "path")
    return found.select("venv", "site_packages", _module_name().alias("name"), "path")


def _module_name() -> Column:
    """Dotted name of a file relative to its package directory."""
    name = F.replace(F.col("path"), F.col("site_packages"), F.lit(""))
    for ending in (r"\A/", r"/__init__\.py\z", r"\.py\z"):
        name = F.regexp_replace(name, ending, "")
    return F.replace(name, F.lit("/"), F.lit("."))


def python_rejects(
    facts: DataFrame, scope: Scope = Scope(), small: bool | None = None
) -> DataFrame:
    """Environments without a package directory."""
    # One row per environment on both sides, so neither can be skewed.
    bare = virtual_envs(facts, scope).join(site_packages(facts, scope, small), "venv", "left_anti")
    marker = F.concat(F.rtrim(F.col("venv"), F.lit("/")), F.lit("/pyvenv.cfg"))
    return bare.select(
        marker.alias("path"),
        F.lit("python").alias("stage"),
        F.lit("no site-packages").alias("reason"),
    )
