"""Search against SQLite, whose LIKE is the one to match."""

import itertools
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from codecat.functions import names
from codecat.plans import catalogue as store
from codecat.plans import search as find
from codecat.plans.postings import open_postings

NAMES = [
    "com.abc.HashMap", "com.abc.hashMap", "Hash Map", "hash\tmap", "HASH_MAP", "hash%map", "a\\b",
    "a\\\\b", "ÉCOLE", "école", "", "%", "_", "x\ny", "m", "日本語", "日本", "K", "k", "\U0001f600x",
]
QUERIES = [
    "hash map", "HASH", "", " ", "a b", "%", "_", "__", "école", "ÉCOLE", "É", "a\\b", "\\", "x y",
    "m", "日_語", "_x", "k", "hash\x0bmap", "h\u00a0m", "a%_p",
]


@pytest.fixture(scope="module")
def sqlite():
    return sqlite3.connect(":memory:")


@pytest.fixture(scope="module")
def catalogue(spark):
    languages = ["java", "python", "javascript", "go"]
    rows = [(languages[i % 4], name, f"/p{i}") for i, name in enumerate(NAMES)]
    return spark.createDataFrame(rows, "language string, name string, path string").cache()


def in_sqlite(sqlite, pattern, code=-1):
    """Paths of the names that SQLite's LIKE accepts, of one language or all."""
    alike = (sqlite.execute("VALUES (? LIKE ?)", (name, pattern)).fetchone()[0] for name in NAMES)
    return sorted(f"/p{i}" for i, hit in enumerate(alike) if hit and code in (-1, i % 4))


def fuzzy(query):
    out, blank = "", False
    for char in query:
        if char in "\t\n\f\r ":
            out += "" if blank else "%"
            blank = True
        else:
            out, blank = out + char, False
    return f"%{out}%"


@pytest.mark.parametrize("exact", [False, True])
def test_search_matches_sqlite(sqlite, catalogue, exact):
    for query in QUERIES:
        found = find.search(catalogue, query, exact=exact)
        expected = in_sqlite(sqlite, query if exact else fuzzy(query))
        assert sorted(r["path"] for r in found.collect()) == expected, query


def test_search_language(sqlite, catalogue):
    for language, code in [("Python", 1), ("GO", 3), ("rust", -1), (None, -1), ("", -1)]:
        found = find.search(catalogue, "a", language=language)
        assert sorted(r["path"] for r in found.collect()) == in_sqlite(sqlite, "%a%", code)


def test_search_batch_matches_sqlite(spark, sqlite, catalogue, either_join):
    asked = [(i, q if i % 2 else fuzzy(q), None) for i, q in enumerate(QUERIES * 2)]
    asked += [(100, "%a%", "JAVA"), (101, "%a%", "go"), (102, "%a%", "rust"), (103, "%zzz%a%", None)]
    asked += [(200 + i, "%Map%", "java") for i in range(10)]
    queries = spark.createDataFrame(asked, "qid int, pattern string, language string")
    found = find.search_batch(catalogue, queries).select("qid", "path")
    codes = {"JAVA": 0, "java": 0, "go": 3}
    expected = [
        (qid, path)
        for qid, pattern, language in asked
        for path in in_sqlite(sqlite, pattern, codes.get(language, -1))
    ]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.fixture
def stored(spark, catalogue, tmp_path):
    """The names as a stored catalogue: postings are built midway, and some names come twice."""
    table = str(tmp_path / "catalogue")
    store.upsert_catalogue(catalogue.where("language <> 'go'"), table)
    store.build_postings(spark, table)
    store.upsert_catalogue(catalogue.withColumn("path", F.concat("path", F.when(F.col("language") == "java", "/again").otherwise(""))), table)
    return table


def test_search_batch_by_postings_matches_sqlite(spark, sqlite, stored, either_join, monkeypatch):
    monkeypatch.setattr(find, "FEW_GRAMS", 3)
    asked = [(i, q if i % 2 else fuzzy(q), None) for i, q in enumerate(QUERIES * 2)]
    asked += [(100, "%a%", "JAVA"), (101, "%a%", "go"), (102, "%hash%", "rust"), (103, "%zzz%a%", None), (104, "%hash%map%", "java"), (105, "%map%", "go")]
    queries = spark.createDataFrame(asked, "qid int, pattern string, language string")
    names = store.open_catalogue(spark, stored)
    found = find.search_batch(names, queries, open_postings(spark, stored))
    plain = find.search_batch(names, queries)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    codes = {"JAVA": 0, "java": 0, "go": 3}
    expected = {(qid, path) for qid, pattern, language in asked for path in in_sqlite(sqlite, pattern, codes.get(language, -1))}
    assert {(r["qid"], r["path"].removesuffix("/again")) for r in found.collect()} == expected


def test_postings_follow_the_catalogue(spark, catalogue, stored):
    def held(table):
        postings = open_postings(spark, table)
        names = {(r["gram"], r["name_id"], r["language"]) for r in postings.names.collect()}
        return names, {r["gram"] for r in postings.frequencies.collect()}

    def expected(df):
        rows = df.select("language", find.lower_ascii(F.col("name")).alias("n")).distinct()
        rows = rows.select("language", F.xxhash64("n").alias("i"), "n").collect()
        names = {(r["n"][k : k + 3], r["i"], r["language"]) for r in rows for k in range(len(r["n"]) - 2)}
        return names, {n[0] for n in names}

    assert held(stored) == expected(store.open_catalogue(spark, stored))
    store.reset_catalogue(catalogue.where("language = 'java'"), stored)
    assert held(stored) == expected(catalogue.where("language = 'java'"))
    assert store.open_catalogue(spark, stored).count() == 5


def test_catalogues_without_postings_get_none(spark, catalogue, tmp_path):
    table = str(tmp_path / "plain")
    store.upsert_catalogue(catalogue, table)
    store.reset_catalogue(catalogue, table)
    assert open_postings(spark, table) is None and open_postings(spark, str(tmp_path / "none")) is None


def test_search_batch_by_postings_scans_names_once(spark, stored):
    queries = spark.createDataFrame([(1, "%Map%", None), (2, "%k%", None), (3, "%hash%", "java")], "qid int, pattern string, language string")
    found = find.search_batch(store.open_catalogue(spark, stored), queries, open_postings(spark, stored))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("name_lc") and plan.count("parquet") == len(re.findall(r"Relation \[", plan))
    assert len(re.findall(r"Relation \[name#", plan)) == 1
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("by_postings", [False, True])
def test_search_batch_tests_few_names_a_query(spark, tmp_path, monkeypatch, by_postings):
    """Each piece of three characters is in many names, so queries times such names would grow with the square of the input."""
    numbers = ["".join(digits) for digits in itertools.product("012", repeat=6)]
    names = spark.createDataFrame([("java", f"Doc{n}", f"/{n}") for n in numbers], "language string, name string, path string")
    queries = spark.createDataFrame([(n, f"%doc{n}%", "Java") for n in numbers], "qid string, pattern string, language string")
    table, met = str(tmp_path / "catalogue"), []
    store.upsert_catalogue(names, table)
    store.build_postings(spark, table)
    for name in ("_met_by_pieces", "_met_by_postings"):
        monkeypatch.setattr(find, name, lambda *args, f=getattr(find, name): met.append(f(*args)) or met[-1])
    found = find.search_batch(store.open_catalogue(spark, table), queries, open_postings(spark, table) if by_postings else None)
    assert sorted((r["qid"], r["path"]) for r in found.collect()) == [(n, f"/{n}") for n in numbers]
    assert met[0].count() <= 4 * len(numbers)


def test_search_batch_without_queries(spark, catalogue):
    none = spark.createDataFrame([], "qid int, pattern string, language string")
    assert find.search_batch(catalogue, none).count() == 0


def test_search_batch_has_no_nested_loop(spark, catalogue):
    queries = spark.createDataFrame([(1, "%Map%", None)], "qid int, pattern string, language string")
    plan = find.search_batch(catalogue, queries)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_of_languages(spark):
    df = spark.createDataFrame(
        [("Java", 0), ("PYTHON", 1), ("javascript", 2), ("Go", 3), ("rust", -1), ("", 9)],
        "name string, code int",
    )
    codes = df.select(names.language_code(F.col("name")).alias("c")).collect()
    assert [r["c"] for r in codes] == [0, 1, 2, 3, -1, -1]
    back = df.select(names.language_name(F.col("code")).alias("n")).collect()
    assert [r["n"] for r in back] == ["java", "python", "javascript", "go", "", ""]


def test_listing_resolve_render(spark):
    docs = spark.createDataFrame(
        [
            ("java", "b", "/2"), ("java", "b", "/1"), ("go", "b", "/0"), ("python", "B", "/3"),
            ("go", "é", "/4"), ("go", "z", "/5"),
        ],
        "language string, name string, path string",
    )
    listing = find.search_listing(docs)
    assert [r["line"] for r in listing.collect()] == ["go\tb", "go\tz", "go\té", "java\tb", "python\tB"]
    resolved = sorted(map(tuple, find.resolve_name(docs).collect()))
    assert resolved == [
        ("go", "b", "/0"), ("go", "z", "/5"), ("go", "é", "/4"), ("java", "b", "/1"), ("python", "B", "/3"),
    ]
    picked = listing.where("line = 'java\tb'")
    assert find.resolve_name(docs, picked).collect() == [("java", "b", "/1")]
    assert find.resolve_name(docs, picked, ignore_language=True).collect() == [("go", "b", "/0")]
    files = spark.createDataFrame(
        [("/1.java", "x"), ("/3.py", ""), ("/9.txt", "no")], "path string, content string"
    )
    hits = spark.createDataFrame(
        [("java", "b", "/1.java"), ("java", "c", "/1.java"), ("python", "B", "/3.py"), ("go", "g", "/gone.go")],
        "language string, name string, path string",
    )
    shown = find.render_source(find.lookup_content(hits, files))
    assert sorted((r["name"], r["source"]) for r in shown.collect()) == [
        ("B", "# /3.py\n\n"), ("b", "// /1.java\n\nx"), ("c", "// /1.java\n\nx"),
    ]
