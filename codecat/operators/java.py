"""Java: qualified names of the types declared in each source file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code import is_comment_line, java_lines, java_name, java_top
from ..schema import Scope
from .digest import is_java_source


def java_packages(facts: DataFrame) -> DataFrame:
    """``(path, package)`` of each Java file that has a package."""
    found = facts.where((F.col("kind") == "java") & F.col("package").isNotNull())
    return found.select("path", "package")


def java_symbols(facts: DataFrame) -> DataFrame:
    """``(name, path)`` of each declared type. Per file: no shuffle."""
    declared = facts.where(F.col("kind") == "java").select(
        "path", "package", F.explode_outer("types").alias("declared")
    )
    name = java_name(F.col("package"), java_top(F.col("path")), F.col("declared"))
    return declared.where(F.col("package").isNotNull() & F.col("declared").isNotNull()).select(
        name.alias("name"), "path"
    )


def java_rejects(facts: DataFrame) -> DataFrame:
    """Java files without a package, or without any type."""
    reason = F.when(F.col("package").isNull(), "no package").when(
        F.size("types") == 0, "no types"
    )
    rejects = facts.where(F.col("kind") == "java").select(
        "path", F.lit("java").alias("stage"), reason.alias("reason")
    )
    return rejects.where(F.col("reason").isNotNull())


def code_lines(files: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """``(path, line_no, line)``: the lines that are read for declarations."""
    return (
        files.where(is_java_source(F.col("path"), scope))
        .select("path", F.posexplode(java_lines(F.col("content"))).alias("at", "line"))
        .where(~is_comment_line(F.col("line")))
        .select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")
    )
