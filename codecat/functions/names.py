"""Expressions over names, languages and result lines."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LANGUAGE_CODES

#: The white space that separates words (no vertical tab).
BLANK = r"[\t\n\f\r ]"


def lower_ascii(text: Column) -> Column:
    """Lower-case A to Z only, so that non-ASCII letters keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fuzzy_pattern(query: Column) -> Column:
    """LIKE pattern of a query column: blanks become ``%``, wrapped in ``%``."""
    return F.concat(F.lit("%"), F.regexp_replace(query, BLANK + "+", "%"), F.lit("%"))


def like_pattern(query: str, exact: bool = False) -> str:
    """LIKE pattern of one query, in the lower case of :func:`lower_ascii`."""
    pattern = query if exact else "%" + re.sub(BLANK + "+", "%", query) + "%"
    return pattern.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def escape_like(pattern: Column | str) -> Column | str:
    """Make backslashes plain characters of a LIKE pattern."""
    if isinstance(pattern, str):
        return pattern.replace("\\", "\\\\")
    return F.replace(pattern, F.lit("\\"), F.lit("\\\\"))


def _pairs(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def language_code(name: Column) -> Column:
    """Code of a language name in any case; -1 when unknown."""
    return F.coalesce(F.try_element_at(_pairs(LANGUAGE_CODES), F.lower(name)), F.lit(-1))


def language_name(code: Column) -> Column:
    """Name of a language code; empty when unknown."""
    names = {code: name for name, code in LANGUAGE_CODES.items()}
    return F.coalesce(F.try_element_at(_pairs(names), code), F.lit(""))


def listing_line(language: Column, name: Column) -> Column:
    """Result line of a document."""
    return F.concat_ws("\t", language, name)


def path_comment(language: Column, path: Column) -> Column:
    """The path as a comment line of the language."""
    slashes = language.isin("java", "javascript", "go")
    return F.concat(F.when(slashes, F.lit("// ")).otherwise(F.lit("# ")), path)


def with_header(language: Column, path: Column, content: Column) -> Column:
    """Source text under a comment that names its path."""
    return F.concat(path_comment(language, path), F.lit("\n\n"), content)
