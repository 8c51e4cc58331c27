"""One query per operator, over corpora derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import gomod, java, maven, npm, python_env
from ..operators.digest import JS_SUFFIXES, MARKERS, digest
from ..plans import catalogue as store
from ..plans import search as find
from ..plans.archives import extracted, index_with_archives
from ..plans.archives import rejects as stored_rejects
from ..plans.postings import open_postings
from ..schema import REJECTS
from ..sources import frontier
from ..sources.archives import expand_archives as expand
from ..sources.corpus import read_corpus
from ..sources.locations import open_locations, update_locations
from ..sources.scratch import scratch_dir
from ..sources.tables import stored
from ..streaming.reindex import kept_rejects, reindex, reindex_archives
from . import fixture

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    """Query functions by key."""
    return dict(_QUERIES)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(fixture.files(spark, sf_dir))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.build_catalogue(fixture.files(spark, sf_dir))[0]


# --- files -----------------------------------------------------------------


@_query
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.length("content").cast("long").alias("chars")
    return fixture.files(spark, sf_dir).select("path", chars)


@_query
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a tree of files that a job writes, walked in rounds and read."""
    root = fixture.mounted(scratch_dir(spark, "tree"))
    fixture.write_tree(fixture.files(spark, sf_dir), root)
    read = frontier.read_tree(frontier.scan_tree(spark, root))
    path = F.substring("path", F.lit(len(root) + 1), F.length("path")).alias("path")
    return read.select(path, F.octet_length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


@_query
def marker_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    marker = paths.base(path)
    found = fixture.files(spark, sf_dir).where(marker.isin(*MARKERS, "__init__.py"))
    return found.select("path", paths.parent(path).alias("dir"), marker.alias("marker"))


@_query
def filter_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture.files(spark, sf_dir).select("path")
    return files.where(paths.ends_with_any(F.col("path"), JS_SUFFIXES))


@_query
def path_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = paths.ancestors(paths.parent(F.col("path")))
    return fixture.files(spark, sf_dir).select("path", F.explode(above).alias("ancestor"))


# --- java ------------------------------------------------------------------


@_query
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.code_lines(fixture.files(spark, sf_dir))


@_query
def java_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.java_packages(_facts(spark, sf_dir))


@_query
def java_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.java_symbols(_facts(spark, sf_dir))


# --- python ----------------------------------------------------------------


@_query
def site_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_env.site_packages(_facts(spark, sf_dir))


@_query
def python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_env.python_modules(_facts(spark, sf_dir))


# --- javascript ------------------------------------------------------------


@_query
def npm_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return npm.npm_roots(fixture.files(spark, sf_dir))


@_query
def npm_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return npm.npm_packages(_facts(spark, sf_dir))


@_query
def npm_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return npm.npm_modules(_facts(spark, sf_dir))


# --- go --------------------------------------------------------------------


@_query
def go_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gomod.go_modules(_facts(spark, sf_dir))


@_query
def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gomod.go_files(_facts(spark, sf_dir))


# --- catalogue -------------------------------------------------------------


@_query
def build_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)


@_query
def index_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.build_catalogue(fixture.files(spark, sf_dir))[1]


@_query
def index_kept_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects that are kept beside the catalogue, of two runs that overlap."""
    home = scratch_dir(spark, "rejects")
    files = fixture.files(spark, sf_dir)
    for languages in (["java", "go"], None):
        store.index(files, f"{home}/catalogue", languages=languages, rejects=f"{home}/rejects")
    return stored(spark, f"{home}/rejects", REJECTS)


def _indexed_archives(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Archives indexed in two runs that overlap; gives the catalogue and the state."""
    home = scratch_dir(spark, "archives")
    archives = fixture.archives(spark, sf_dir)
    for some in (archives.where(F.length("path") % 2 == 0), archives):
        index_with_archives(spark, some, f"{home}/catalogue", f"{home}/state", root=fixture.EXTRACTED)
    return f"{home}/catalogue", f"{home}/state"


@_query
def index_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_catalogue(spark, _indexed_archives(spark, sf_dir)[0]).select("language", "name", "path")


@_query
def index_stored_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_rejects(spark, _indexed_archives(spark, sf_dir)[1])


@_query
def index_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark, _indexed_archives(spark, sf_dir)[1])


@_query
def index_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset over a table with other documents leaves the new ones alone."""
    target = scratch_dir(spark, "catalogue")
    documents = _built(spark, sf_dir)
    store.upsert_catalogue(documents.where("language <> 'go'"), target)
    store.reset_catalogue(documents.where("language <> 'java'"), target)
    return store.open_catalogue(spark, target).select("language", "name", "path")


@_query
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fuzzy search with a language and an exact one, on the stored table."""
    target = scratch_dir(spark, "catalogue")
    store.upsert_catalogue(_built(spark, sf_dir), target)
    catalogue = store.open_catalogue(spark, target)
    fuzzy = find.search(catalogue, "pkg m", language="python")
    return fuzzy.unionByName(find.search(catalogue, "example.com/m_/f%3.go", exact=True))


@_query
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.catalogue_counts(_built(spark, sf_dir))


@_query
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inserts that overlap, the second one with repeated rows."""
    target = scratch_dir(spark, "catalogue")
    documents = _built(spark, sf_dir)
    store.upsert_catalogue(documents.where(F.length("name") % 2 == 0), target)
    store.upsert_catalogue(documents.union(documents), target)
    return store.open_catalogue(spark, target).select("language", "name", "path")


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """A corpus folder that grows twice and is then left alone, indexed as a stream; gives the folder of the tables."""
    home = scratch_dir(spark, "stream")
    files = fixture.files(spark, sf_dir)
    late = F.length("path") % 3 == 0
    for part in (files.where(~late), files.where(late), None):
        if part is not None:
            part.write.mode("append").parquet(f"{home}/corpus")
        run = reindex(spark, f"{home}/corpus", f"{home}/catalogue", f"{home}/digests", f"{home}/checkpoint", rejects=f"{home}/rejects")
        run.awaitTermination()
    return home


@_query
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = _streamed(spark, sf_dir)
    return store.open_catalogue(spark, f"{home}/catalogue").select("language", "name", "path")


@_query
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream refuses in the end: markers that came late turn some rejects into documents."""
    return kept_rejects(spark, f"{_streamed(spark, sf_dir)}/rejects")


@_query
def stream_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of archives that grows once, indexed as a stream."""
    home = scratch_dir(spark, "archives")
    archives = fixture.archives(spark, sf_dir)
    late = F.length("path") % 2 == 0
    for part in (archives.where(late), archives.where(~late)):
        part.write.mode("append").parquet(f"{home}/archives")
        run = reindex_archives(spark, f"{home}/archives", f"{home}/catalogue", f"{home}/state", f"{home}/checkpoint", root=fixture.EXTRACTED)
        run.awaitTermination()
    return store.open_catalogue(spark, f"{home}/catalogue").select("language", "name", "path")


# --- search ----------------------------------------------------------------


@_query
def search_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.search(_built(spark, sf_dir), "Doc 1 \t R")


@_query
def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.search(_built(spark, sf_dir), "Example.com/m_/f%3.GO", exact=True)


@_query
def search_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.search(_built(spark, sf_dir), "pkg m", language="Python")


@_query
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per part against a stored catalogue that got postings and grew afterwards."""
    target = scratch_dir(spark, "catalogue")
    files = fixture.files(spark, sf_dir)
    store.index(files, target, languages=["java", "python"])
    store.build_postings(spark, target)
    store.index(files, target)
    asked = fixture.name_queries(spark, sf_dir)
    return find.search_batch(store.open_catalogue(spark, target), asked, open_postings(spark, target))


@_query
def search_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.search_listing(_built(spark, sf_dir))


@_query
def resolve_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _built(spark, sf_dir)
    return find.resolve_name(built, find.search_listing(built))


def _located(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Sources of a search in a stored corpus that grew once; contents are read at their places."""
    home = scratch_dir(spark, "corpus")
    files = fixture.files(spark, sf_dir)
    late = F.length("path") % 5 == 0
    for part in (files.where(~late), files.where(late)):
        part.write.mode("append").parquet(f"{home}/corpus")
        update_locations(spark, f"{home}/corpus", f"{home}/locations", f"{home}/checkpoint")
    built = store.build_catalogue(read_corpus(spark, f"{home}/corpus"))[0]
    hits = find.search(find.resolve_name(built), query)
    return find.lookup_located(hits, open_locations(spark, f"{home}/locations"))


@_query
def lookup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir, "F 1")


@_query
def render_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find.render_source(_located(spark, sf_dir, "m 2"))


@_query
def fuzzy_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = names.fuzzy_pattern(F.col("text")).alias("pattern")
    return fixture.table(spark, sf_dir, "documents").select("doc_id", pattern)


@_query
def language_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = fixture.table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """CASE doc_id % 6 WHEN 0 THEN 'Java' WHEN 1 THEN 'PYTHON' WHEN 2 THEN 'javascript'
            WHEN 3 THEN 'Go' WHEN 4 THEN '' ELSE lang END AS lang_name""",
    )
    return named.select("*", names.language_code(F.col("lang_name")).alias("code"))


@_query
def language_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = fixture.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "CAST(doc_id % 6 - 1 AS INT) AS code"
    )
    return coded.select("*", names.language_name(F.col("code")).alias("name"))


# --- archives --------------------------------------------------------------


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maven.artifacts(fixture.artifact_paths(spark, sf_dir))


def _jdks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maven.jdk_archives(fixture.jvm_paths(spark, sf_dir), ["8", "11", "1"])


@_query
def maven_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark, sf_dir).drop("out_dir")


@_query
def maven_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maven.artifact_rejects(fixture.artifact_paths(spark, sf_dir))


@_query
def artifact_out_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _artifacts(spark, sf_dir).select("path", "out_dir")


@_query
def maven_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maven.source_trees(_artifacts(spark, sf_dir)).select("path", "out_dir")


@_query
def new_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _artifacts(spark, sf_dir)
    extracted = found.where(F.col("version") == "1.0").select("out_dir")
    return maven.new_artifacts(found, extracted).select("out_dir", "path")


@_query
def jdk_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jdks(spark, sf_dir)


@_query
def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maven.java_sources(_artifacts(spark, sf_dir), _jdks(spark, sf_dir))


@_query
def expand_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that hold the documents, expanded; contents are shown by digest."""
    archives = fixture.archives(spark, sf_dir)
    found = fixture.archive_paths(spark, sf_dir)
    wanted = maven.java_sources(maven.artifacts(found), maven.jdk_archives(found, ["17"]))
    return expand(archives, wanted, fixture.EXTRACTED).select(
        "archive",
        *[F.coalesce(value, F.lit("")).alias(name) for name, value in (
            ("path", F.col("path")), ("digest", F.md5("content")), ("reason", F.col("reason")))],
    )
