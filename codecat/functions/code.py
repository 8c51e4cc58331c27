"""Extraction of declarations from file contents.

All are built-in expressions over the whole content, so a file is not exploded
to rows on the way to its declarations. Only a line feed ends a line, hence the
``d`` flag where a pattern looks for line starts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import BLANK
from .paths import base

#: Characters trimmed at the ends of a line (Unicode white space).
TRIMMED = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: Marks that make a line a comment when they are its first word.
COMMENT_MARK = r"(?://|/\*|\*/|\*)"
#: Words that start a type declaration.
TYPE_WORDS = ("class", "interface", "record", "enum")
#: Fixed value: a package clause.
PACKAGE_CLAUSE = rf"package{BLANK}+([a-zA-Z0-9_.]+);"
#: Fixed value: a note that is removed from a line before it is read.
PACKAGE_NOTE = "/* package */"

_IN_LINE_BLANK = BLANK.replace(r"\n", "")
_COMMENT_LINE = rf"\A[{TRIMMED}]*{COMMENT_MARK}(?:{BLANK}|\z)"
# The look-ahead spares most positions the alternatives.
_TYPE_NAME = (
    f"(?=[{''.join(word[0] for word in TYPE_WORDS)}])(?:{'|'.join(TYPE_WORDS)})"
    rf"{_IN_LINE_BLANK}+([a-zA-Z0-9_$]+)"
)


def _lines(content: Column) -> Column:
    return F.split(F.replace(content, F.lit(PACKAGE_NOTE), F.lit("")), "\n", -1)


def java_lines(content: Column) -> Column:
    """Array of lines, trimmed and without package notes."""
    return F.transform(_lines(content), lambda line: F.btrim(line, F.lit(TRIMMED)))


def is_comment_line(line: Column) -> Column:
    """The first word of a line is exactly a comment mark."""
    return line.rlike(_COMMENT_LINE)


def java_types(content: Column) -> Column:
    """Array of the distinct names declared outside comment lines.

    A plain substring test leaves few lines for the regular expressions. They
    are joined again, and as the pattern does not cross a line feed, one
    extraction finds all names.
    """

    def candidate(line: Column) -> Column:
        has_word = reduce(or_, [line.contains(word) for word in TYPE_WORDS])
        return has_word & ~is_comment_line(line)

    code = F.array_join(F.filter(_lines(content), candidate), "\n")
    return F.array_distinct(F.regexp_extract_all(code, F.lit(_TYPE_NAME), 1))


def jdk_package(path: Column, fix: bool = False) -> Column:
    """Package of a JDK source: directories after the JDK module directory.

    Every ``jdk`` component is dropped with the component after it; with
    ``fix`` only the first pair is.
    """
    folder = F.concat(F.lit("/"), F.substring(path, F.lit(1), F.length(path) - F.length(base(path))))
    tail = F.regexp_replace(folder, r"(?s)\A.*?/jdk/", "/jdk/")
    pair = r"\A/jdk/[^/]*" if fix else r"/jdk/[^/]*"
    kept = F.regexp_replace(F.regexp_replace(tail, pair, ""), "/+", ".")
    return F.regexp_replace(kept, r"\A\.|\.\z", "")


def declared_package(content: Column) -> Column:
    """Name in the first package clause; empty when there is none."""
    return F.regexp_extract(content, PACKAGE_CLAUSE, 1)


def java_package(path: Column, declared: Column, jdk_fix: bool = False) -> Column:
    """Package of a Java file: from the path for JDK sources, else as declared.

    Null when none is declared.
    """
    return F.when(path.contains("/jdk/"), jdk_package(path, jdk_fix)).when(declared != "", declared)


def java_top(path: Column) -> Column:
    """Name of the top-level type: file name without extension."""
    return F.regexp_replace(base(path), r"\.[^.]*\z", "")


def java_name(package: Column, top: Column, declared: Column) -> Column:
    """Qualified name of a declared type. Nested types hang off the top-level one."""
    inner = F.concat_ws(".", package, top, declared)
    return F.when(declared == top, F.concat_ws(".", package, top)).otherwise(inner)


def declared_module(content: Column) -> Column:
    """Module name as written in a ``go.mod``; empty when there is none."""
    word = BLANK.replace("[", "[^", 1)
    return F.regexp_extract(content, rf"(?md)^module{BLANK}+({word}+)", 1)


def go_module(declared: Column) -> Column:
    """Module name without quotes; null when none is declared."""
    return F.when(declared != "", F.btrim(declared, F.lit('"')))


def parsed_manifest(content: Column) -> Column:
    """Struct of the fields of a manifest that are read, with their JSON types."""
    return F.from_json(
        content,
        "name VARIANT, version VARIANT, _bad STRING",
        {
            "columnNameOfCorruptRecord": "_bad",
            "allowSingleQuotes": "false",
            "allowNonNumericNumbers": "false",
        },
    )


def manifest_text(parsed: Column, field: str) -> Column:
    """A field of a parsed manifest.

    Null unless the content starts with a valid JSON object in which the field
    is a JSON string.
    """
    value = parsed[field]
    usable = parsed["_bad"].isNull() & (F.schema_of_variant(value) == "STRING")
    return F.when(usable, F.try_variant_get(value, "$", "string"))
