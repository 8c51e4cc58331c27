import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from codecat.operators import maven
from codecat.operators.digest import digest, digest_parts
from codecat.operators.java import java_symbols
from codecat.sources import archives, corpus as corpora, file_tree, frontier, parts


def packed(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for name, data in entries:
            target.writestr(name, data)
    return out.getvalue()


def test_maven_coordinates(spark):
    m2 = "/h/.m2/repository"
    given = {
        f"{m2}/org/x/lib/1.0/lib-1.0-sources.jar": ("org.x", "lib", "1.0", "sources", "sources/org/x/lib/1.0"),
        f"{m2}/lib/1.0/lib-1.0-javadoc.jar": ("", "lib", "1.0", "javadoc", "javadoc/lib/1.0"),
        f"{m2}/org/lib/1.0/other-sources.jar": ("org", "lib", "1.0", "", "org/lib/1.0"),
        f"{m2}/repository/y/lib/2/lib-2-tests-sources.jar": ("y", "lib", "2", "tests-sources", "tests-sources/y/lib/2"),
        f"{m2}/a/repository/lib/2-sources.jar": ("a", "repository", "lib", "", "a/repository/lib"),
        f"{m2}/lib/x-sources.jar": None,
        "/h/elsewhere/org/lib/1/lib-1-sources.jar": None,
        f"{m2}/org/lib/1.0/lib-1.0.jar": "other",
        f"{m2}/org/lib/1.0/lib-1.0-sources.jar.sha1": "other",
    }
    files = spark.createDataFrame([(p,) for p in given], "path string")
    found = {r["path"]: tuple(r)[1:] for r in maven.artifacts(files).collect()}
    assert found == {p: v for p, v in given.items() if isinstance(v, tuple)}
    rejected = {r["path"] for r in maven.artifact_rejects(files).collect()}
    assert rejected == {p for p, v in given.items() if v is None}
    assert maven.artifacts(files, ["/other"]).count() == 0


def test_new_artifacts_takes_the_first_in_walk_order(spark):
    rows = [("/r/a-b/x", "o1"), ("/r/a/x", "o1"), ("/r/c", "o2"), ("/r/d", "o3")]
    found = spark.createDataFrame(rows, "path string, out_dir string")
    done = spark.createDataFrame([("o3",), ("o3",)], "out_dir string")
    assert sorted(map(tuple, maven.new_artifacts(found, done).collect())) == [("/r/a/x", "o1"), ("/r/c", "o2")]


def test_jdk_archives(spark):
    given = [
        "/usr/lib/jvm/java-1.17.0-x/lib/src.zip",
        "/usr/lib/jvm/java-17-openjdk-b/lib/src.zip",
        "/usr/lib/jvm/java-17-openjdk-a/lib/modules",
        "/usr/lib/jvm/java-17/lib/src.zip",
        "/usr/lib/jvm/java-171/lib/src.zip",
        "/usr/lib/jvm/java-11/demo/lib/src.zip",
        "/m2/usr/lib/jvm/java-17-z/lib/src.zip",
        "/opt/jvm/java-17/lib/src.zip",
    ]
    files = spark.createDataFrame([(p,) for p in given], "path string")
    found = maven.jdk_archives(files, ["1", "11", "17"])
    assert sorted(map(tuple, found.collect())) == [
        ("/m2/usr/lib/jvm", "17", given[6]),
        ("/usr/lib/jvm", "1", given[0]),
        ("/usr/lib/jvm", "17", given[3]),
    ]


def test_archives_to_symbols(spark):
    """From archives to Java symbols; refused entries are reported."""
    jar = "/h/.m2/repository/org/lib/1/lib-1-sources.jar"
    doc = "/h/.m2/repository/org/lib/1/lib-1-javadoc.jar"
    src = "/usr/lib/jvm/java-17/lib/src.zip"
    bad = "/h/.m2/repository/org/bad/1/bad-1-sources.jar"
    data = {
        jar: packed([
            ("META-INF/", ""), ("org/A.java", "package org; class A"), ("org/A.java", "package org; class A class In"),
            ("../up/B.java", "package up; class B"), ("/abs/C.java", "package abs; class C"),
            ("./x//D.java", "package x; class D"), ("bytes.bin", b"\xff\xfe"),
        ]),
        doc: packed([("org/E.java", "package org; class E")]),
        src: packed([("java.base/java/util/List.java", "class List")]),
        bad: b"no zip",
    }
    table = spark.createDataFrame([(p, bytearray(d)) for p, d in data.items()], "path string, content binary")
    found = table.select("path")
    wanted = maven.java_sources(maven.artifacts(found), maven.jdk_archives(found, ["17"]))
    expanded = archives.expand_archives(table, wanted, "/out/java/")
    files = archives.expanded_files(expanded)
    assert sorted(r["path"] for r in files.collect()) == [
        "/out/java/javadoc/org/lib/1/org/E.java",
        "/out/java/sources/17/usr/lib/jvm/jdk/java.base/java/util/List.java",
        "/out/java/sources/org/lib/1/bytes.bin",
        "/out/java/sources/org/lib/1/org/A.java",
        "/out/java/sources/org/lib/1/x/D.java",
    ]
    assert sorted(r["name"] for r in java_symbols(digest(files)).collect()) == [
        "java.util.List", "org.A", "org.A.In", "x.D",
    ]
    rejects = {(r["path"], r["reason"]) for r in archives.expansion_rejects(expanded).collect()}
    assert rejects == {
        (f"{jar}!../up/B.java", "entry leaves its directory"),
        (f"{jar}!/abs/C.java", "entry leaves its directory"),
        (bad, "bad archive: BadZipFile"),
    }
    assert files.where("path LIKE '%bytes.bin'").first()["content"] == "\ufffd\ufffd"


def test_expand_mounted(spark, tmp_path):
    jar = tmp_path / "lib-1-sources.jar"
    jar.write_bytes(packed([("A.java", "package q; class A"), ("../B.java", "")]))
    wanted = [(str(jar), "sources/lib/1"), (str(tmp_path / "gone.jar"), "sources/gone/1")]
    expanded = archives.expand_mounted(spark.createDataFrame(wanted, "path string, out_dir string"), "/out")
    assert archives.expanded_files(expanded).collect() == [("/out/sources/lib/1/A.java", "package q; class A")]
    assert sorted(r["reason"] for r in archives.expansion_rejects(expanded).collect()) == [
        "bad archive: FileNotFoundError", "entry leaves its directory",
    ]


@pytest.mark.parametrize("method", [zipfile.ZIP_LZMA, zipfile.ZIP_BZIP2, zipfile.ZIP_DEFLATED])
def test_damaged_entries_are_rejects(method):
    packing = io.BytesIO()
    with zipfile.ZipFile(packing, "w", method) as out:
        out.writestr("good.txt", "x" * 50)
        out.writestr("bad.txt", os.urandom(5000))
    data = bytearray(packing.getvalue())
    middle = data.index(b"bad.txt") + 1500
    data[middle : middle + 200] = bytes(200)
    rows = list(archives._entries("a", "/o", io.BytesIO(bytes(data))))
    assert [r[1] for r in rows if r[5] is None and r[2] == 0][0] == "/o/good.txt"
    assert rows[-1][1] == "/o/bad.txt" and rows[-1][5].startswith("bad entry: ")


def test_io_errors_are_no_rejects(tmp_path):
    with pytest.raises(IsADirectoryError):
        list(archives._entries(str(tmp_path), "/o", str(tmp_path)))


def test_long_entries_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(parts, "PART_BYTES", 1000)
    lines = "".join(f"line {i}\n" for i in range(600))
    data = packed([("a.txt", lines), ("b.java", "class B"), ("c.java", ""), ("d.txt", "x" * 2500), ("e.txt", "y" * 1500 + "\nz")])
    rows = list(archives._entries("a", "/o", io.BytesIO(data)))
    by_path = {}
    for _, path, part, more, content, reason in rows:
        assert reason is None
        by_path.setdefault(path, []).append((part, more, content.decode()))
    assert {p: "".join(c for _, _, c in v) for p, v in by_path.items()} == {
        "/o/a.txt": lines, "/o/b.java": "class B", "/o/c.java": "", "/o/d.txt": "x" * 2500, "/o/e.txt": "y" * 1500 + "\nz",
    }
    for found in by_path.values():
        assert [(i, more) for i, more, _ in found] == [(i, i < len(found) - 1) for i in range(len(found))]
        assert all(c.endswith("\n") for _, more, c in found if more)
    assert len(by_path["/o/a.txt"]) > 2 and len(by_path["/o/d.txt"]) == 1 and len(by_path["/o/e.txt"]) == 2
    files = archives.expanded_files(spark.createDataFrame(rows, archives.EXPANDED))
    assert sorted(r["path"] for r in files.collect()) == ["/o/b.java", "/o/c.java", "/o/d.txt"]


def test_what_fits_no_row_is_a_reject(spark, monkeypatch):
    monkeypatch.setattr(parts, "PART_BYTES", 10)
    monkeypatch.setattr(parts, "MOST_BYTES", 40)
    data = packed([("package.json", " " * 50), ("a.txt", "x" * 50), ("b.txt", "ok\n" + "y" * 50), ("sub/package.json", " " * 40)])
    rows = list(archives._entries("a", "/o", io.BytesIO(data)))
    assert {r[1]: r[5] for r in rows if r[5]} == {"/o/package.json": "manifest too long", "/o/a.txt": "line too long", "/o/b.txt": "line too long"}
    assert ("a", "/o/b.txt", 0, True, b"ok\n", None) in rows
    rejects = archives.expansion_rejects(spark.createDataFrame(rows, archives.EXPANDED))
    assert sorted(r["path"] for r in rejects.collect()) == ["a!/o/a.txt", "a!/o/b.txt", "a!/o/package.json"]


SOURCE = """/* é */
// package no;
package

 a.b.c;
package late;
/* class Hidden */ class Shown
 * class Star
class One { enum Two } interface /* package */ Three
record	Four class One
"""


@pytest.mark.parametrize("part_bytes", [1, 10, 33, 1 << 20])
def test_facts_do_not_depend_on_parts(spark, monkeypatch, part_bytes):
    """Packages, types, modules and manifests are those of whole contents, wherever these are cut."""
    files = {
        "/java/sources/p/A.java": SOURCE, "/java/sources/p/B.java": SOURCE.replace("package", "// nothing", 1), "/java/sources/p/C.java": "",
        "/java/sources/q/jdk/m/x/D.java": "\xff\n\n class D\n\n" * 9, "/g/go.mod": "// x\nmodule\n\n \"g/h\"\nmodule late\n", "/n/package.json": '{"name":\n"q",\n\n"version":"1"}\n',
        "/v/pyvenv.cfg": "\n" * 40, "/x/notes.txt": "module z\n",
    }
    monkeypatch.setattr(parts, "PART_BYTES", part_bytes)
    rows = [("a", p, *r) for p, text in files.items() for r in parts.parts_of(io.BytesIO(text.encode()), p)]
    rows.append(("a", "/java/sources/p/bad.java", 0, False, None, "bad entry: x"))
    found = digest_parts(spark.createDataFrame(rows, archives.EXPANDED).repartition(4))
    plain = digest(spark.createDataFrame(list(files.items()), "path string, content string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.select(found.columns).collect()), key=str)
    assert (len(rows) > 60) == (part_bytes < 10)


def test_mounted_archives_spread_over_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.jar").write_bytes(packed([("A.java", f"class A{i}")]))
    wanted = [(str(tmp_path / f"{i}.jar"), f"sources/{i}") for i in range(40)]
    expanded = archives.expand_mounted(spark.createDataFrame(wanted, "path string, out_dir string"), "/out")
    assert expanded.select("path").distinct().count() == 40
    assert expanded.select(F.spark_partition_id()).distinct().count() >= 4


def test_machines_with_the_same_entries(spark):
    """Two hosts have one JDK version each, and one artifact twice."""
    same = packed([("java.base/java/util/List.java", "class List")])
    jdks = [f"/hosts/h{i}/usr/lib/jvm/java-17/lib/src.zip" for i in range(2)]
    jars = [f"/hosts/h{i}/.m2/repository/org/lib/1/lib-1-sources.jar" for i in range(2)]
    table = spark.createDataFrame([(p, bytearray(same)) for p in jdks + jars], "path string, content binary")
    found = table.select("path")
    wanted = maven.java_sources(maven.artifacts(found), maven.jdk_archives(found, ["17"]))
    files = archives.expanded_files(archives.expand_archives(table, wanted, "/out/java"))
    assert sorted(r["path"] for r in files.collect()) == [
        f"/out/java/sources/17/hosts/h{i}/usr/lib/jvm/jdk/java.base/java/util/List.java" for i in range(2)
    ] + ["/out/java/sources/org/lib/1/java.base/java/util/List.java"]


def test_large_archives_come_in_batches(monkeypatch):
    monkeypatch.setattr(archives, "BATCH_BYTES", 1000)
    data = packed([(f"f{i}", "x" * 300) for i in range(20)])
    batch = archives.pa.RecordBatch.from_pydict({"path": ["a"], "out_dir": ["/o"], "content": [data]})
    out = list(archives._expand(iter([batch])))
    assert len(out) > 3 and sum(b.num_rows for b in out) == 20


@pytest.fixture
def tree(tmp_path):
    for name in ["a/__init__.py", "a/b/_x.py", ".venv/c.py", "d/.e/f.js", "top.txt", "d/anaconda3/g.js"]:
        file = tmp_path / "tree" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(name.encode() + b"\xff")
    for i in range(30):
        (tmp_path / "tree" / "a" / f"n{i}.txt").write_bytes(b"")
    os.symlink(tmp_path / "tree" / "a", tmp_path / "tree" / "link")
    return str(tmp_path / "tree")


def listed(spark, tree, **options):
    df = spark.read.format("file_tree").options(path=tree, **options).load()
    return sorted(r["path"][len(tree) + 1 :] for r in df.collect())


@pytest.mark.parametrize("partitions", ["1", "3", "64"])
def test_file_tree(spark, tree, partitions):
    file_tree.register(spark)
    everything = sorted(
        os.path.relpath(os.path.join(folder, name), tree)
        for folder, _, names in os.walk(tree)
        for name in names
    )
    assert listed(spark, tree, partitions=partitions) == everything
    assert listed(spark, tree, partitions=partitions, suffixes=".py,.js", skipHidden="true") == [
        "a/__init__.py", "a/b/_x.py", "d/anaconda3/g.js",
    ]
    assert "d/anaconda3/g.js" not in listed(spark, tree, partitions=partitions, exclude="/anaconda3/")


def test_file_tree_contents(spark, tree):
    file_tree.register(spark)
    df = spark.read.format("file_tree").load(tree).where("path LIKE '%top.txt'")
    assert corpora.decoded(df).select("length", "content").first() == (8, "top.txt\ufffd")
    bare = spark.read.format("file_tree").option("content", "false").load(tree)
    assert bare.where(F.col("content").isNotNull()).count() == 0


def test_file_tree_reports_what_it_cannot_read(spark, tree, monkeypatch):
    reader = file_tree._TreeReader({"path": tree})

    def refuse(folder, own=reader._children):
        if folder.endswith("/d"):
            raise PermissionError(folder)
        return own(folder)

    monkeypatch.setattr(reader, "_children", refuse)
    os.remove(os.path.join(tree, "top.txt"))
    os.mkfifo(os.path.join(tree, "pipe"))
    rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert [(r["path"], r["reason"]) for r in rows if r["reason"]] == [(f"{tree}/d", "unreadable folder")]
    gone = next(e for e in reader._children(f"{tree}/a")[1] if e.name == "n1.txt")
    os.remove(gone.path)
    assert reader._row(gone)[3] == "unreadable file: FileNotFoundError"


def test_file_tree_names_long_files(spark, tree, monkeypatch):
    monkeypatch.setattr(file_tree, "MOST_BYTES", 5)
    reader = file_tree._TreeReader({"path": tree})
    rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert {r["reason"] for r in rows if r["path"].endswith("top.txt")} == {"content too long"}


def test_read_corpus(spark, tmp_path, corpus):
    corpus({"/a": "x"}).union(spark.createDataFrame([(None, "y")], "path string, content string")).write.parquet(
        str(tmp_path / "c")
    )
    assert corpora.read_corpus(spark, str(tmp_path / "c")).collect() == [("/a", "x")]


def walked(spark, root, **options):
    rows = frontier.scan_tree(spark, root, **options).collect()
    return sorted(r["path"][len(root) + 1 :] for r in rows if r["reason"] is None)


@pytest.mark.parametrize("entries", [1, 7, 20_000])
def test_frontier_lists_a_tree(spark, tree, entries):
    everything = sorted(os.path.relpath(os.path.join(folder, name), tree) for folder, _, names in os.walk(tree) for name in names)
    assert walked(spark, tree, entries_per_round=entries) == everything
    assert walked(spark, f"{tree}", entries_per_round=entries, suffixes=[".py", ".js"], skip_hidden=True) == [
        "a/__init__.py", "a/b/_x.py", "d/anaconda3/g.js",
    ]
    assert "d/anaconda3/g.js" not in walked(spark, tree, entries_per_round=entries, exclude=["/anaconda3/"])


def test_frontier_deals_a_lopsided_tree_anew(spark, tmp_path):
    """One chain of folders holds all the others; rounds still deal them to many tasks."""
    deep = tmp_path / "deep" / "er" / "still"
    for i in range(60):
        (deep / f"d{i}" / "e").mkdir(parents=True)
        (deep / f"d{i}" / "e" / "f.txt").write_text(str(i))
    found = frontier.scan_tree(spark, str(tmp_path), entries_per_round=3)
    assert found.count() == 60
    assert found.select(F.input_file_name()).distinct().count() >= 8


def test_frontier_reports_what_it_cannot_read(spark, tree, tmp_path):
    rows = frontier.scan_tree(spark, str(tmp_path / "none")).collect()
    assert [(r["path"], r["reason"]) for r in rows] == [(str(tmp_path / "none"), "unreadable folder: FileNotFoundError")]
    os.mkfifo(os.path.join(tree, "pipe"))
    with open(os.fsencode(tree) + b"/n\xff.txt", "wb") as file:
        file.write(b"odd")
    found = frontier.scan_tree(spark, tree)
    assert not any("pipe" in r["path"] for r in found.collect())
    os.remove(os.path.join(tree, "a", "n1.txt"))
    read = {os.path.basename(r["path"]): r for r in frontier.read_tree(found).collect()}
    assert read["n\ufffd.txt"]["content"] == b"odd" and read["top.txt"]["content"] == b"top.txt\xff"
    assert read["n1.txt"]["reason"] == "unreadable file: FileNotFoundError"
    assert archives.expansion_rejects(frontier.read_tree(found)).first()["stage"] == "tree"


def test_tree_to_symbols(spark, tmp_path):
    home = tmp_path / "java" / "sources" / "a"
    home.mkdir(parents=True)
    (home / "A.java").write_text("package a;\nclass A { class B }")
    files = frontier.read_tree(frontier.scan_tree(spark, str(tmp_path)))
    assert sorted(r["name"] for r in java_symbols(digest_parts(files)).collect()) == ["a.A", "a.A.B"]
