import pytest
from pyspark.sql import functions as F

from codecat.functions import code
from codecat.operators.digest import digest
from codecat.operators.java import code_lines, java_rejects, java_symbols
from codecat.schema import Scope

ANYWHERE = Scope(java_sources="")

GARDEN = """/* a class note before the package */
package org.garden.tools;
import java.util.List;
interface Sharp { void cut(List<String> stems); }
// this enum is only mentioned
 * so is this class
public final class Shears implements Sharp {
  private enum Blade { STRAIGHT, CURVED }
  /* no interface here */ public void cut(List<String> stems) { String s = "new " + Blade.CURVED; }
  protected @interface Kept {}
}
"""


def names(df):
    return sorted(row["name"] for row in df.collect())


def test_words_in_comment_lines_declare_nothing(corpus):
    files = corpus({"org/garden/tools/Shears.java": GARDEN})
    assert names(java_symbols(digest(files, ANYWHERE))) == [
        "org.garden.tools.Shears",
        "org.garden.tools.Shears.Blade",
        "org.garden.tools.Shears.Kept",
        "org.garden.tools.Shears.Sharp",
    ]


@pytest.mark.parametrize(
    "line, declared",
    [
        ("class A{} class B {}", ["A", "B"]),
        ("/** a class of things", ["of"]),
        ("//class A", ["A"]),
        ("// class A", []),
        ("  * class A", []),
        ("*/ class A", []),
        ("*/class A", ["A"]),
        ("/*\tclass A", []),
        ("\u00a0// class A", []),
        ("//\u00a0class A", ["A"]),
        ("\x0b* class A", []),
        ("//\x0bclass A", ["A"]),
        ("/* package */ class A", ["A"]),
        ("/* package *// class A", ["A"]),
        ("/* package */// class A", []),
        ("cla/* package */ss A", ["A"]),
        ("subclass foo", ["foo"]),
        ("class\x0bA", []),
        ("class\r\tA", ["A"]),
        ("x\r// class A", ["A"]),
        ("class", []),
        ("class A$1_ record é enum E", ["A$1_", "E"]),
        ("int x; // see class A", ["A"]),
        ("class\nA", []),
    ],
)
def test_declaration_lines(corpus, line, declared):
    files = corpus({"/java/sources/T.java": "first\n" + line + "\nlast"})
    found = files.select(code.java_types(F.col("content")).alias("t")).first()["t"]
    assert sorted(found) == sorted(declared)


def reference_jdk_package(path):
    """The rule stated on components: each ``jdk`` takes its successor with it."""
    kept, seen, skip = [], False, False
    for part in path.split("/")[:-1]:
        if skip:
            skip = False
        elif part == "jdk":
            seen = skip = True
        elif seen and part:
            kept.append(part)
    return ".".join(kept)


def test_jdk_packages(spark):
    paths = [
        "/s/jdk/java.base/java/util/A.java",
        "/s/jdk/java.base/jdk/internal/misc/A.java",
        "/s/jdk/java.base/A.java",
        "/s/jdk/jdk/a/A.java",
        "/s/jdk/jdk/jdk/a/b/A.java",
        "/s/jdk/m/x/jdk/A.java",
        "/s/jdk/m/jdkx/xjdk/A.java",
        "/jdk/m/a/A.java",
        "jdk/m/jdk/n/a/A.java",
        "/s/a.jdk/jdk/m/a/jdk.java",
    ]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = df.select("path", code.jdk_package(F.col("path")).alias("p")).collect()
    assert {r["path"]: r["p"] for r in rows} == {p: reference_jdk_package(p) for p in paths}
    fixed = df.select("path", code.jdk_package(F.col("path"), fix=True).alias("p")).collect()
    by_path = {r["path"]: r["p"] for r in fixed}
    assert by_path["/s/jdk/java.base/jdk/internal/misc/A.java"] == "jdk.internal.misc"
    assert by_path["/s/jdk/java.base/java/util/A.java"] == "java.util"


def test_packages_and_rejects(corpus):
    files = corpus(
        {
            "/java/sources/a/A.java": "// package in.comment;\nclass A",
            "/java/sources/a/B.java": "package\n\t x.y ;\npackage z;\nclass B class C",
            "/java/sources/a/NoPackage.java": "class NoPackage",
            "/java/sources/a/NoType.java": "package q;\nint x;",
            "/java/sources/jdk/m/Top.java": "class Top",
            "/java/sources/a/package-info.java": "package q; class P",
            "/java/sources/a/module-info.java": "package q; class P",
            "/elsewhere/Other.java": "package q; class Other",
            "/java/sources/a/Kt.kt": "package q; class Kt",
            "/java/sources/a/Dotted.v1.java": "package q; class Dotted class v1",
        }
    )
    facts = digest(files)
    assert names(java_symbols(facts)) == [
        ".Top",
        "in.comment.A",
        "q.Dotted.v1.Dotted",
        "q.Dotted.v1.v1",
        "z.B",
        "z.B.C",
    ]
    assert sorted((r["path"][16:], r["reason"]) for r in java_rejects(facts).collect()) == [
        ("NoPackage.java", "no package"),
        ("NoType.java", "no types"),
    ]


def test_code_lines(corpus):
    files = corpus({"/java/sources/A.java": " a \r\n// b\n\n\u3000* c\n/* package */ d\n"})
    rows = code_lines(files).collect()
    assert sorted((r["line_no"], r["line"]) for r in rows) == [(1, "a"), (3, ""), (5, "d"), (6, "")]
