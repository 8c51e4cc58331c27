"""Search a catalogue and fetch the sources found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import escape_like, like_pattern, listing_line, lower_ascii, with_header
from ..functions.paths import ends_with_any
from ..operators.joins import fits_broadcast, key_filter, marked, sized_join
from ..schema import CATALOGUE_KEY, LANGUAGE_CODES
from ..sources.locations import SOURCE_SUFFIXES, read_located
from ..sources.scratch import staged
from .postings import GRAM, Postings, grams, name_id

#: So few paths or pieces are looked up by their values, which skips the other files and row groups of an index.
FEW_PATHS = FEW_GRAMS = 200
#: A pattern whose rarest piece more names have is keyed by a longer piece.
FEW_NAMES = 16
#: Sizes of longer pieces; below the 16 digits of a name's number.
LONGER = (4, 6, 8, 12)

def _name_lc(catalogue: DataFrame) -> Column:
    if "name_lc" in catalogue.columns:
        return F.col("name_lc")
    return lower_ascii(F.col("name"))


def search(
    catalogue: DataFrame, query: str, language: str | None = None, exact: bool = False
) -> DataFrame:
    """``(language, name, path)`` of the documents whose name is LIKE the query.

    A fuzzy query matches its words in order, anywhere. An exact one is the
    LIKE pattern itself. Both ignore ASCII case, and ``%`` and ``_`` are
    wildcards. No language, or an unknown one, searches all.
    """
    known = (language or "").lower()
    if known in LANGUAGE_CODES:
        catalogue = catalogue.where(F.col("language") == known)
    pattern = escape_like(like_pattern(query, exact))
    return catalogue.where(_name_lc(catalogue).like(pattern)).select(*CATALOGUE_KEY)


def _query_grams(pattern: Column) -> Column:
    """Pieces that every match of a LIKE pattern contains.

    All of size GRAM where the pattern has such a literal run, else its
    longest run, which is shorter or empty.
    """
    runs = F.split(pattern, "[%_]+")
    long_runs = F.filter(runs, lambda run: F.length(run) >= GRAM)
    pieces = F.flatten(F.transform(long_runs, lambda run: grams(run, [GRAM])))
    longest = F.array_max(F.transform(runs, lambda run: F.struct(F.length(run).alias("n"), run.alias("run"))))
    return F.when(F.size(pieces) > 0, pieces).otherwise(F.array(longest["run"]))


def _longer_pieces(pattern: Column) -> Column:
    """Longer pieces that every match of a LIKE pattern contains: of each literal run those of the largest size that it has."""
    runs = F.filter(F.split(pattern, "[%_]+"), lambda run: F.length(run) >= LONGER[0])

    def cut(run: Column) -> Column:
        size = F.lit(LONGER[0])
        for more in LONGER[1:]:
            size = F.when(F.length(run) >= more, more).otherwise(size)
        return F.transform(F.sequence(F.lit(1), F.length(run) - size + 1), lambda i: F.substring(run, i, size))

    return F.array_distinct(F.flatten(F.transform(runs, cut)))


def search_batch(catalogue: DataFrame, queries: DataFrame, postings: Postings | None = None) -> DataFrame:
    """``(qid, language, name, path)`` for many queries at once.

    ``queries(qid, pattern, language)`` hold LIKE patterns; a null or unknown
    language searches all. Names and patterns are keyed by short pieces of
    text; each pattern takes the one of its pieces that is rarest among the
    names, and only rows that meet on a piece are tested in full. This is an
    equi-join, and exact for every pattern. Equal queries are tested once.

    With the ``postings`` of a stored catalogue, frequencies and proposed names are read from them, and the
    catalogue is scanned once, for the names proposed. Patterns without a whole piece are
    matched by their shorter ones in the same scan, and those whose rarest piece many names have by a longer piece.
    Without postings, names are cut to pieces twice.
    """
    known = F.lower("language")
    asked = queries.select(
        "qid",
        lower_ascii(F.col("pattern")).alias("pattern"),
        F.when(known.isin(*LANGUAGE_CODES), known).otherwise("").alias("asked"),
    )
    patterns = asked.select("pattern", "asked").distinct()
    cut = F.explode(F.array_distinct(_query_grams(F.col("pattern")))).alias("gram")
    pieces = staged(patterns.select("pattern", "asked", cut), "pieces")
    keyed = catalogue.select(*CATALOGUE_KEY, _name_lc(catalogue).alias("_name_lc"))
    met = _met_by_pieces(keyed, pieces) if postings is None else _met_by_postings(keyed, pieces, postings)
    found = met.where(F.col("asked").isin("", F.col("language")) & F.like(F.col("_name_lc"), escape_like(F.col("pattern"))))
    return sized_join(found, asked, ["pattern", "asked"], "path").select("qid", *CATALOGUE_KEY)


def _rarest(pieces: DataFrame, counts: DataFrame, few: bool) -> DataFrame:
    """``(pattern, asked, gram, names)``: the rarest piece of each pattern. One that no name has leaves its pattern without a match."""
    rarest = F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("rarest")
    chosen = sized_join(pieces, counts, "gram", "pattern", "left", few)
    return staged(chosen.groupBy("pattern", "asked").agg(rarest).select("pattern", "asked", "rarest.gram", "rarest.names"), "patterns")


def _met_by_pieces(keyed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Names and patterns that share the pattern's rarest piece; all names are cut to pieces."""
    whole = F.length("gram") >= GRAM
    longer = pieces.where(whole).select("pattern", "asked").distinct()
    longer = longer.select("pattern", "asked", F.explode(_longer_pieces(F.col("pattern"))).alias("gram"))
    pieces = staged(pieces.unionByName(longer), "all-pieces")
    # At most GRAM + 1 sizes, and those of longer pieces.
    sizes = [row[0] for row in pieces.select(F.length("gram")).distinct().collect()]
    of_name = F.explode(grams(F.col("_name_lc"), sizes or [GRAM])).alias("gram")
    used = pieces.select("gram").distinct()
    few = fits_broadcast(used)
    words = None if few else key_filter(used, "gram")
    counts = (
        sized_join(_likely(keyed.select("path", of_name), "gram", words), used, "gram", "path", "left_semi", few)
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("names"))
    )
    chosen = _rarest(pieces, counts, few).drop("names")
    small = fits_broadcast(chosen)
    # Drop the pieces that no pattern took before the shuffle.
    words = None if small else key_filter(chosen, "gram")
    return sized_join(_likely(keyed.select("*", of_name), "gram", words), chosen, "gram", "path", small=small)


def _likely(rows: DataFrame, key: str, words: DataFrame | None) -> DataFrame:
    return rows if words is None else marked(rows, key, words).where("_likely").drop("_likely")


def _met_by_postings(keyed: DataFrame, pieces: DataFrame, postings: Postings) -> DataFrame:
    """Names and patterns that share the pattern's rarest piece, as the postings have it, a longer or its only, shorter piece.

    Names meet patterns on a key: the name's number, as 16 hexadecimal digits, or a piece shorter than that.
    """
    whole = F.length("gram") >= GRAM
    long = pieces.where(whole)
    counts = postings.frequencies.groupBy("gram").agg(F.sum("names").alias("names"))
    used = long.select("gram").distinct()
    few = fits_broadcast(used)
    counts = staged(sized_join(counts, used, "gram", "gram", "left_semi", few), "counts")
    chosen = _rarest(long, counts, few)
    many = (F.col("names") > FEW_NAMES) & (F.size(_longer_pieces(F.col("pattern"))) > 0)
    keys = [
        pieces.where(~whole).withColumnRenamed("gram", "key"),
        _longer_keys(chosen.where(many).select("pattern", "asked"), counts, few),
        _numbers(chosen.where(~many).select("pattern", "asked", "gram"), postings.names),
    ]
    targets = staged(reduce(DataFrame.unionByName, keys), "targets")
    sizes = [row[0] for row in targets.select(F.length("key")).distinct().collect() if row[0] < 16]
    own = F.array(F.lpad(F.hex(name_id(F.col("_name_lc"))), 16, "0"))
    cut = F.concat(own, grams(F.col("_name_lc"), sizes)) if sizes else own
    small = fits_broadcast(targets)
    words = None if small else key_filter(targets, "key")
    return sized_join(_likely(keyed.select("*", F.explode(cut).alias("key")), "key", words), targets, "key", "path", small=small)


def _longer_keys(patterns: DataFrame, counts: DataFrame, few: bool) -> DataFrame:
    """``(pattern, asked, key)``: of each pattern the longer piece that is rarest if its parts of size GRAM occurred independently."""
    most = counts.agg(F.max("names")).collect()[0][0] or 1
    cut = patterns.select("pattern", "asked", F.explode(_longer_pieces(F.col("pattern"))).alias("key"))
    starts = F.sequence(F.lit(1), F.length("key") - GRAM + 1, F.lit(GRAM))
    parts = cut.select("*", F.explode(F.transform(starts, lambda i: F.substring("key", i, F.lit(GRAM)))).alias("gram"))
    share = F.sum(F.log(F.coalesce("names", F.lit(0.5)) / most)).alias("share")
    rated = sized_join(parts, counts, "gram", "pattern", "left", few).groupBy("pattern", "asked", "key").agg(share)
    return rated.groupBy("pattern", "asked").agg(F.min_by("key", F.struct("share", "key")).alias("key"))


def _numbers(chosen: DataFrame, names: DataFrame) -> DataFrame:
    """``(pattern, asked, key)``: the numbers of the names that the postings have for each pattern's piece."""
    taken = [row["gram"] for row in chosen.select("gram").distinct().limit(FEW_GRAMS + 1).collect()]
    if len(taken) <= FEW_GRAMS:
        names = names.where(F.col("gram").isin(taken))
    proposed = sized_join(names, chosen, "gram", "name_id").where(F.col("asked").isin("", F.col("language")))
    # A name may have postings from several inserts.
    return proposed.select(F.lpad(F.hex("name_id"), 16, "0").alias("key"), "pattern", "asked").distinct()


def search_listing(hits: DataFrame) -> DataFrame:
    """``(line)``: the distinct result lines in byte order."""
    line = listing_line(F.col("language"), F.col("name"))
    return hits.select(line.alias("line")).distinct().orderBy("line")


def resolve_name(
    hits: DataFrame, lines: DataFrame | None = None, ignore_language: bool = False
) -> DataFrame:
    """``(language, name, path)``: one document per name, the least path.

    ``lines(line)`` limits the names to picked result lines. With
    ``ignore_language`` names of different languages are one name.
    """
    key = ["name"] if ignore_language else ["language", "name"]
    least = F.min(F.struct("path", "language")).alias("least")
    found = hits.groupBy(*key).agg(least)
    if lines is not None:
        words = F.split("line", "\t")
        picked = lines.select(words[0].alias("language"), words[1].alias("name"))
        # One row per key on both sides, so neither can be skewed.
        found = found.join(picked.select(*key).distinct(), key, "left_semi")
    return found.select(F.col("least.language").alias("language"), "name", "least.path")


def lookup_content(hits: DataFrame, files: DataFrame) -> DataFrame:
    """``(language, name, path, content)``: documents with their source.

    The hits are stored first, so they are computed once and Spark knows their
    size: few meet the corpus map-side, and contents are not shuffled. For many,
    only files that a catalogue can name take part in the shuffle; a stored corpus
    with an index does without it, see :func:`lookup_located`.
    """
    wanted = staged(hits.select(*CATALOGUE_KEY), "hits")
    sources = files.where(ends_with_any(F.col("path"), SOURCE_SUFFIXES))
    return sources.select("path", "content").join(wanted, "path").select(*CATALOGUE_KEY, "content")


def lookup_located(hits: DataFrame, locations: DataFrame) -> DataFrame:
    """As :func:`lookup_content`, by an index ``locations(path, file, row)`` of a stored corpus.

    Hits meet the index, which is as narrow as they are; then tasks read the rows that were named, and no
    others. A path that is in the corpus several times has a row for each, one that is not there none.
    """
    wanted = staged(hits.select(*CATALOGUE_KEY), "hits")
    few = [row["path"] for row in wanted.select("path").distinct().limit(FEW_PATHS + 1).collect()]
    if len(few) <= FEW_PATHS:
        locations = locations.where(F.col("path").isin(few))
    places = staged(sized_join(locations, wanted, "path", "file"), "places")
    return read_located(places).select(*CATALOGUE_KEY, "content")


def render_source(sources: DataFrame) -> DataFrame:
    """``(language, name, path, source)``: sources under a comment with the path."""
    source = with_header(F.col("language"), F.col("path"), F.col("content"))
    return sources.select(*CATALOGUE_KEY, source.alias("source"))
