"""Documents that a new part of a corpus adds.

New files can complete older ones: a marker may come after the sources that it
makes listable. Each language therefore has a unit that can be rebuilt alone:
a Java file, a Python environment, an npm root, a Go module.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import npm_root
from ..operators.digest import small_markers
from ..operators.gomod import go_files, go_modules, go_rejects
from ..operators.java import java_rejects, java_symbols
from ..operators.joins import containing, sized_join
from ..operators.npm import npm_modules, npm_rejects
from ..operators.python_env import python_modules, python_rejects, virtual_envs
from ..schema import CATALOGUE, REJECTS, Scope
from ..sources.scratch import staged


def _is_python(kind: Column, path: Column) -> Column:
    return kind.isin("python", "venv") | path.contains("/site-packages/")


#: Which facts each language reads.
_READS = {
    "java": lambda kind, path: kind == "java",
    "python": _is_python,
    "javascript": lambda kind, path: kind.isin("manifest", "js"),
    "go": lambda kind, path: kind.isin("gomod", "go"),
}


def _read_by(facts: DataFrame, language: str) -> DataFrame:
    return facts.where(_READS[language](F.col("kind"), F.col("path")))


#: Up to so many touched units are found by ranges of paths, which skip the rest of the stored facts.
FEW_UNITS = 100


def below_any(path: Column, folders: Collection[str]) -> Column:
    """Whether a path lies below one of some folders, as ranges that a scan can skip by."""
    ranges = [(path >= f"{folder.rstrip('/')}/") & (path < f"{folder.rstrip('/')}0") for folder in folders]
    return reduce(or_, ranges, F.lit(False))


def _few(units: DataFrame) -> list[str] | None:
    """The folders of some units; none if they are many."""
    found = [row[0] for row in units.limit(FEW_UNITS + 1).collect()]
    return found if len(found) <= FEW_UNITS else None


def _python_units(facts: DataFrame, fresh: DataFrame, scope: Scope, small: bool, work: str) -> DataFrame:
    """Facts below the environments that have a fresh file below them."""
    envs = virtual_envs(facts, scope).withColumnRenamed("venv", "owner")
    touched = containing(_read_by(fresh, "python").select("path", "dir"), envs, small=small)
    touched = touched.select("owner").distinct()
    few = _few(touched)
    rows = _read_by(facts, "python")
    below = containing(rows, touched, small=small) if few is None else rows.where(below_any(F.col("path"), few))
    # Read several times over, so computed once.
    return staged(below.select("path", "dir", "kind").distinct(), "python", under=work)


def _npm_units(facts: DataFrame, fresh: DataFrame, work: str) -> DataFrame:
    """Facts below the npm roots that have a fresh file."""
    root = npm_root(F.col("path")).alias("root")
    touched = _read_by(fresh, "javascript").select(root).where(F.col("root").isNotNull()).distinct()
    few = _few(touched)
    rows = _read_by(facts, "javascript")
    if few is None:
        rooted = rows.select("*", root).where(F.col("root").isNotNull())
        found = sized_join(rooted, touched, "root", "path", "left_semi")
    else:
        found = rows.where(below_any(F.col("path"), few))
    return staged(found.select("path", "dir", "kind", "name", "version"), "npm", under=work)


def _go_documents(facts: DataFrame, fresh: DataFrame, scope: Scope, small: bool) -> DataFrame:
    """Fresh files in all modules, and all files in fresh modules."""
    modules = go_modules(fresh, scope)
    few = _few(modules.select("mod_dir").distinct())
    rows = facts if few is None else facts.where(below_any(F.col("path"), few))
    return go_files(fresh, scope, go_modules(facts, scope), small).unionByName(go_files(rows, scope, modules, small))


def _cleared(units: DataFrame, scope: Scope) -> DataFrame:
    """``(path, stage)`` of the markers of touched environments."""
    marker = F.concat(F.rtrim(F.col("venv"), F.lit("/")), F.lit("/pyvenv.cfg"))
    return virtual_envs(units, scope).select(marker.alias("path"), F.lit("python").alias("stage"))


def _judged(units: DataFrame, rejects: DataFrame) -> DataFrame:
    """A row per unit: its reason, or null where nothing is wrong with it any more. One row per unit on both sides."""
    return units.distinct().join(rejects, ["path", "stage"], "left").select("path", "stage", "reason")


def affected(facts: DataFrame, fresh: DataFrame, work: str, scope: Scope = Scope()) -> tuple[DataFrame, DataFrame]:
    """Distinct documents of the units that ``fresh`` touches, and ``(path, stage, reason)`` of the units judged.

    ``facts`` is the digest of the whole corpus so far, ``fresh`` its new part.
    A language that reads no fresh file is left out. Touched units are read by ranges of paths, if they are few, and staged
    below the folder ``work``, which the results read. A null reason takes an earlier one back.
    """
    read = [F.max(test(F.col("kind"), F.col("path"))).alias(language) for language, test in _READS.items()]
    touched = fresh.agg(*read).collect()[0]
    small = small_markers(facts) if any(touched[x] for x in ("python", "javascript", "go")) else set()
    envs, manifests, modules = (kind in small for kind in ("venv", "manifest", "gomod"))
    documents, judged = {}, []
    if touched["java"]:
        documents["java"] = java_symbols(fresh)
        judged.append(java_rejects(fresh))
    if touched["python"]:
        units = _python_units(facts, fresh, scope, envs, work)
        documents["python"] = python_modules(units, scope, envs)
        judged.append(_judged(_cleared(units, scope), python_rejects(units, scope, envs)))
    if touched["javascript"]:
        units = _npm_units(facts, fresh, work)
        documents["javascript"] = npm_modules(units, scope, manifests)
        markers = units.where("kind = 'manifest'").select("path", F.lit("javascript").alias("stage"))
        judged.append(_judged(markers, npm_rejects(units, scope, manifests)))
    if touched["go"]:
        documents["go"] = _go_documents(facts, fresh, scope, modules)
        judged.append(go_rejects(fresh, scope))
    spark = facts.sparkSession
    found = [rows.select(F.lit(language).alias("language"), "name", "path") for language, rows in documents.items()]
    return (
        reduce(DataFrame.unionByName, found).distinct() if found else spark.createDataFrame([], CATALOGUE),
        reduce(DataFrame.unionByName, judged).distinct() if judged else spark.createDataFrame([], REJECTS),
    )


def affected_documents(facts: DataFrame, fresh: DataFrame, work: str, scope: Scope = Scope()) -> DataFrame:
    """The documents of :func:`affected`."""
    return affected(facts, fresh, work, scope)[0]
