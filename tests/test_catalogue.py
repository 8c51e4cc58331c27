import pytest
from pyspark.sql import functions as F

from codecat.operators.digest import digest
from codecat.plans import catalogue as store
from codecat.plans import keys
from codecat.plans import search as find
from codecat.streaming.reindex import reindex

TREE = {
    "/java/sources/a/A.java": "package a; class A class B",
    "/java/sources/a/N.java": "int n;",
    "/v/pyvenv.cfg": "",
    "/v/site-packages/p/__init__.py": "",
    "/n/node_modules/q/package.json": '{"name":"q","version":"1"}',
    "/n/node_modules/q/x.js": "",
    "/g/go.mod": "module g",
    "/g/x.go": "",
    "/g/notes.txt": "",
}
DOCUMENTS = [
    ("go", "g/x.go", "/g/x.go"),
    ("java", "a.A", "/java/sources/a/A.java"),
    ("java", "a.A.B", "/java/sources/a/A.java"),
    ("javascript", "q/x.js", "/n/node_modules/q/x.js"),
    ("python", "p", "/v/site-packages/p/__init__.py"),
]


def rows(df):
    return sorted(map(tuple, df.select("language", "name", "path").collect()))


@pytest.fixture
def table(tmp_path):
    return str(tmp_path / "catalogue")


@pytest.mark.parametrize("stage", [True, False])
def test_build(corpus, stage):
    built, rejects = store.build_catalogue(corpus(TREE), stage=stage)
    assert rows(built) == DOCUMENTS
    assert [tuple(r) for r in rejects.collect()] == [("/java/sources/a/N.java", "java", "no package")]


def test_build_some_languages(corpus):
    built, rejects = store.build_catalogue(corpus(TREE), languages=["go", "Java", "cobol"])
    assert rows(built) == DOCUMENTS[:1]
    assert rejects.count() == 0
    built, rejects = store.build_catalogue(corpus(TREE), languages=["cobol"])
    assert rows(built) == [] and rejects.count() == 0


def test_repeated_files_give_one_document(corpus):
    files = corpus(TREE)
    assert rows(store.build_catalogue(files.union(files).union(files))[0]) == DOCUMENTS


def test_counts(corpus):
    built, _ = store.build_catalogue(corpus(TREE))
    assert dict(map(tuple, store.catalogue_counts(built).collect())) == {
        "go": 1, "java": 2, "javascript": 1, "python": 1,
    }


def test_open_missing_table(spark, table):
    assert store.open_catalogue(spark, table).count() == 0


def test_insert_or_ignore_and_reset(spark, corpus, table, either_join):
    docs = spark.createDataFrame(DOCUMENTS, "language string, name string, path string")
    store.upsert_catalogue(docs.where("language <> 'go'"), table)
    store.upsert_catalogue(docs.union(docs), table)
    store.upsert_catalogue(docs.limit(0), table)
    assert rows(store.open_catalogue(spark, table)) == DOCUMENTS
    other = {"/h/go.mod": "module h", "/h/y.go": ""}
    store.index(corpus(other), table)
    assert len(rows(store.open_catalogue(spark, table))) == len(DOCUMENTS) + 1
    # A reset drops all languages, also when one is built.
    store.index(corpus(other), table, languages=["go"], remove=True)
    assert rows(store.open_catalogue(spark, table)) == [("go", "h/y.go", "/h/y.go")]


def test_large_inserts_leave_the_stored_side_alone(spark, table, monkeypatch):
    """Beyond the broadcast limit, stored keys are read by bucket; they are kept up, and made anew when they are short."""
    def docs(numbers):
        return spark.createDataFrame([("go", f"n{i % 7}", f"/p{i}") for i in numbers], "language string, name string, path string")

    plans, own = [], keys.anti_join
    monkeypatch.setattr(keys, "anti_join", lambda new, known: plans.append(own(new, known)) or plans[-1])
    monkeypatch.setattr(store, "fits_broadcast", lambda df: False)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        store.upsert_catalogue(docs(range(50)), table)
        assert keys._buckets(spark, table) is None
        store.upsert_catalogue(docs(range(30, 80)), table)
        plan = plans[-1]._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("SortMergeJoin") :].split("FileScan")
        assert "Bucketed: true" in side[-1] and "Exchange" not in side[-2].rsplit("Sort [", 1)[1]
        assert len(rows(store.open_catalogue(spark, table))) == 80
        monkeypatch.setattr(store, "fits_broadcast", lambda df: True)
        store.upsert_catalogue(docs(range(70, 90)), table)
        monkeypatch.setattr(store, "fits_broadcast", lambda df: False)
        with keys._opened(spark, table, keys._buckets(spark, table)) as name:
            assert spark.table(name).distinct().count() == spark.table(name).count() == 90
        # A run that was cut off before it stored its keys.
        with monkeypatch.context() as cut:
            cut.setattr(store, "add_keys", lambda rows, table: None)
            store._write(docs(range(90, 95)), table, "append")
        store.upsert_catalogue(docs(range(85, 100)), table)
        store.upsert_catalogue(docs(range(85, 100)), table)
        assert rows(store.open_catalogue(spark, table)) == sorted(("go", f"n{i % 7}", f"/p{i}") for i in range(100))
        store.reset_catalogue(docs(range(10)), table)
        assert keys._buckets(spark, table) is None
        store.upsert_catalogue(docs(range(5, 15)), table)
        assert len(rows(store.open_catalogue(spark, table))) == 15
        assert not [t for t in spark.catalog.listTables() if t.name.startswith("codecat_keys")]
    finally:
        spark.conf.set(limit, old)


def test_stored_search_is_pruned(spark, table):
    docs = spark.createDataFrame(DOCUMENTS, "language string, name string, path string")
    store.upsert_catalogue(docs, table)
    stored = store.open_catalogue(spark, table)
    fuzzy = find.search(stored, "A", language="java")
    plan = fuzzy._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(language" in plan
    assert "StringContains(name_lc,a)" in plan
    assert rows(fuzzy) == DOCUMENTS[1:3]
    exact = find.search(stored, "A.a", exact=True)
    assert "EqualTo(name_lc,a.a)" in exact._jdf.queryExecution().executedPlan().toString()
    assert rows(exact) == DOCUMENTS[1:2]


def test_files_hold_ranges_of_names(spark, table):
    """A whole name lies in the range of one file per language, so the others are skipped."""
    names = [(lang, f"name{(7919 * i) % 4000:05d}", f"/p{i}") for i in range(4000) for lang in ("go", "java")]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        store.upsert_catalogue(spark.createDataFrame(names, "language string, name string, path string"), table)
    finally:
        spark.conf.unset(key)
    stored = store.open_catalogue(spark, table)
    ranges = stored.groupBy("language", F.input_file_name().alias("file")).agg(F.min("name_lc").alias("low"), F.max("name_lc").alias("high"))
    files = sorted((r["language"], r["low"], r["high"]) for r in ranges.collect())
    assert len(files) > 6
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(files, files[1:]))


def test_contents_are_read_only_where_needed(spark, tmp_path, corpus):
    """The staged digest of a Python-only build does not scan contents."""
    corpus(TREE).write.parquet(str(tmp_path / "files"))
    files = spark.read.schema("path string, content string").parquet(str(tmp_path / "files"))
    plan = digest(files, kinds=None, read=store._with_contents(["python"]))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    found = store.build_catalogue(files, languages=["python"])[0]
    everything = store.build_catalogue(files)[0].where("language = 'python'")
    assert rows(found) == rows(everything)


def test_archives_are_expanded_once(spark, tmp_path, table, monkeypatch):
    import io
    import zipfile

    from codecat.plans import archives

    def packed(name, text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as target:
            target.writestr(name, text)
        return bytearray(out.getvalue())

    repo, state = "/h/.m2/repository/org/lib", str(tmp_path / "state")
    first = [(f"{repo}/1/lib-1-sources.jar", packed("A.java", "package org; class A")), (f"{repo}/2/lib-2-sources.jar", bytearray(b"bad"))]
    more = [(f"{repo}/3/lib-3-sources.jar", packed("B.java", "package org; class B")), ("/h/odd-sources.jar", bytearray(b""))]
    table_of = lambda rows: spark.createDataFrame(rows, "path string, content binary")
    archives.index_with_archives(spark, table_of(first), table, state)
    asked = []
    expand = archives.expand_archives
    monkeypatch.setattr(archives, "expand_archives", lambda a, wanted, root: asked.append(wanted.count()) or expand(a, wanted, root))
    archives.index_with_archives(spark, table_of(first + more), table, state)
    archives.index_with_archives(spark, table_of(first + more), table, state)
    assert asked == [1, 0]
    assert [r[:2] for r in rows(store.open_catalogue(spark, table))] == [("java", "org.A"), ("java", "org.B")]
    assert sorted(map(tuple, archives.extracted(spark, state).collect())) == [("sources/org/lib/1",), ("sources/org/lib/2",), ("sources/org/lib/3",)]
    assert [r[1:] for r in sorted(map(tuple, archives.rejects(spark, state).collect()))] == [
        ("archive", "bad archive: BadZipFile"), ("maven", "bad path"),
    ]
    archives.index_with_archives(spark, table_of(more), table, state, remove=True)
    assert [r[1] for r in rows(store.open_catalogue(spark, table))] == ["org.B"]
    assert sorted(map(tuple, archives.extracted(spark, state).collect())) == [("sources/org/lib/3",)]


def test_plans_use_no_nested_loops(corpus):
    built, rejects = store.build_catalogue(corpus(TREE), stage=False)
    for df in (built, rejects):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_path_producers_do_not_read_contents(spark, tmp_path, corpus):
    from codecat.operators.python_env import python_modules

    corpus(TREE).write.parquet(str(tmp_path / "files"))
    files = spark.read.schema("path string, content string").parquet(str(tmp_path / "files"))
    plan = python_modules(digest(files))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan
    assert "content:string" not in plan


def test_stream_increments(spark, tmp_path, corpus):
    """Markers may come after the sources that they make listable."""
    folder = {name: str(tmp_path / name) for name in ("corpus", "table", "digests", "checkpoint")}
    late = [p for p in TREE if p.endswith((".cfg", "package.json", "go.mod"))]
    parts = [
        {p: c for p, c in TREE.items() if p not in late},
        {p: TREE[p] for p in late},
        {"/g/sub/z.go": "", "/v/site-packages/p/z.py": "", "/n/node_modules/q/in/z.js": ""},
        {},
    ]
    seen = []
    for part in parts:
        if part:
            corpus(part).coalesce(1).write.mode("append").parquet(folder["corpus"])
        reindex(spark, folder["corpus"], folder["table"], folder["digests"], folder["checkpoint"]).awaitTermination()
        seen.append(rows(store.open_catalogue(spark, folder["table"])))
    added = [
        ("go", "g/sub/z.go", "/g/sub/z.go"),
        ("javascript", "q/in/z.js", "/n/node_modules/q/in/z.js"),
        ("python", "p.z", "/v/site-packages/p/z.py"),
    ]
    assert seen == [DOCUMENTS[1:3], DOCUMENTS, sorted(DOCUMENTS + added), sorted(DOCUMENTS + added)]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from codecat.sources import scratch

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch.scratch_root(Session)
    Session.conf = Conf({"spark.master": "spark://host:7077", "spark.checkpoint.dir": "/shared/"})
    assert scratch.scratch_root(Session) == "/shared"
