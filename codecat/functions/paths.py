"""Path expressions. Paths are absolute, ``/``-separated and normalised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_MODULES = "/node_modules"


def base(path: Column) -> Column:
    """Last component."""
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Path without its last component; ``/`` for a file at the root."""
    return F.regexp_replace(path, r"(?!\A)/[^/]*\z|(?<=\A/)[^/]+\z", "")


def depth(directory: Column) -> Column:
    """Number of components, counting the root: ``/`` is 1, ``/a`` is 2."""
    slashes = F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit("")))
    return F.when(directory == "/", F.lit(1)).otherwise(slashes + 1)


def prefix(directory: Column, components: Column) -> Column:
    """The first ``components`` components of a directory."""
    head = F.call_function("substring_index", directory, F.lit("/"), components)
    return F.when(components == 1, F.lit("/")).otherwise(head)


def ancestors(directory: Column, first: Column | int = 1, last: Column | None = None) -> Column:
    """Array of the prefixes of ``directory`` of depth ``first`` to ``last``.

    ``last`` defaults to the depth of the directory, so that it is contained.
    """
    first = F.lit(first) if isinstance(first, int) else first
    last = depth(directory) if last is None else last
    wanted = F.transform(F.sequence(first, last), lambda i: prefix(directory, i))
    return F.when(first <= last, wanted).otherwise(F.array().cast("array<string>"))


def prefixes_ending(directory: Column, component: str) -> Column:
    """Array of the prefixes of ``directory`` whose last component is ``component``."""
    found = F.transform(
        F.split(directory, "/"),
        lambda part, i: F.when(part == component, prefix(directory, i + 1)),
    )
    return F.array_compact(found)


def ends_with_any(path: Column, suffixes: Sequence[str]) -> Column:
    """Case-sensitive test for any of the given endings."""
    test = F.lit(False)
    for suffix in suffixes:
        test = test | path.endswith(suffix)
    return test


def under(path: Column, roots: Sequence[str]) -> Column:
    """The path is one of ``roots`` or lies below one of them."""
    if "/" in roots:
        return F.lit(True)
    test = F.lit(False)
    for root in roots:
        test = test | (path == root) | path.startswith(root.rstrip("/") + "/")
    return test


def visible_under(path: Column, roots: Sequence[str]) -> Column:
    """As :func:`under`, and no component from the root's own name down is hidden."""
    test = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        shown = ~F.substring(path, F.lit(root.rfind("/") + 1 if root else 1), F.length(path)).contains("/.")
        test = test | (under(path, [root or "/"]) & shown)
    return test


def npm_root(path: Column) -> Column:
    """Directory of the outermost ``node_modules`` above ``path``, or null."""
    at = F.instr(path, NODE_MODULES + "/")
    return F.when(at > 0, F.substring(path, F.lit(1), at + len(NODE_MODULES) - 1))


def eligible_npm_root(root: Column, homes: Sequence[str], excluded: Sequence[str]) -> Column:
    """The root is visible below a home and has no excluded part."""
    test = root.isNotNull() & visible_under(root, homes)
    for part in excluded:
        test = test & ~root.contains(part)
    return test
