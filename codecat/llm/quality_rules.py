"""Quality rules: basic limits, then robust multivariate outliers.

Each document gets a vector of transformed statistics. Per language and source the
minimum covariance determinant (MCD) gives a centre and a covariance that outliers
cannot bend; a document whose Mahalanobis distance is too large is rejected.

The MCD is searched by concentration steps: estimate from a subset, rank all rows by
distance, take the nearest ``CORE`` share as the next subset, until the determinant, which never
rises, falls no more in any group. Two starts (median with MAD, and moments) run side by side, and the one with
the smaller determinant wins. A step is two combined aggregates: a histogram of the
log distances, whose cumulated counts give the limit of the subset, and the sums and
products within it. Nothing but sums per group moves, so a hot source costs no more
than a small one.

Many statistics are zero for most documents, and a covariance of constants is
singular. So each coordinate has a least spread (``Statistic.least``), added to the
variance: smaller differences than that are never an anomaly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged, staged_small
from .words import SPACE

#: The basic limits: least words, and most per cent of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Share of a group that a concentration step keeps. Steps end when no logarithm of a determinant falls by more than
#: the tolerance; as none rises, and there are only so many subsets, they do, and the bound is for the unforeseen.
CORE, TOLERANCE, MOST_STEPS = 0.75, 0.01, 50
#: Groups with fewer rows are put together: first by language, then all.
LEAST_GROUP = 100
#: Bins per unit of the logarithm of a squared distance.
BINS = 50


@dataclass(frozen=True)
class Statistic:
    """A coordinate: its value and the least spread that it is given."""

    value: str
    least: float


#: The transformed statistics. Roots and logarithms draw in the long tails of counts and shares. The share of repeated
#: words is bounded by the basic limits, so it has no tail to draw in: a root would leave it too short to reject by itself.
STATISTICS = (
    Statistic("ln(1 + n_words)", 0.5),
    Statistic("ln(word_chars / n_words)", 0.05),
    Statistic("sqrt(n_symbols / word_chars)", 0.04),
    Statistic("n_repeat_words / n_words", 0.07),
    Statistic("ln(1 + n_dup_lines)", 0.5),
)
#: Median of chi-square with as many degrees of freedom as statistics (5), and the squared distance beyond which a row is
#: rejected. Real statistics have heavier tails than a normal law, so this is ten times as far as its outermost rows go.
CHI_MEDIAN, CUTOFF = 4.3515, 100.0


def text_statistics(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``doc_id``, the columns ``more``, and the base statistics of each whole text (null: none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    triples = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    triples = F.when(F.size("_words") >= 3, triples).otherwise(F.array().cast("array<bigint>"))
    first = docs.select(F.col(id_col).alias("doc_id"), *more, text.alias("_text"))
    split = first.select("*", F.array_remove(F.split("_text", SPACE), "").alias("_words"), lines.alias("_lines"))
    counted = split.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        triples.alias("_triples"),
    ).drop("_text", "_words", "_lines")
    return with_repeated_words(counted).drop("_triples")


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words within three-word windows that occur twice or more in ``_triples``, their hashes.

    Most texts have none, which counting distinct hashes shows. In the others each hash gives its low bits for
    its place, so that sorting plain numbers brings equal windows together; neighbours are then compared in full.
    Each step is a column of its own, as a function over elements would compute an expression for every element.
    """
    repeated = F.size(F.array_distinct("_triples")) < F.size("_triples")
    bits = F.length(F.bin(F.size("_triples").cast("long"))).alias("_bits")
    marked = rows.select("*", bits, repeated.alias("_repeated"))
    numbers = F.transform("_triples", lambda g, i: F.call_function("shiftleft", g, F.col("_bits")).bitwiseOR(i.cast("long")))
    ranked = marked.select("*", F.when(F.col("_repeated"), F.sort_array(numbers)).alias("_ranked"),
                           (F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1).alias("_mask"))

    def window(number: Column) -> Column:
        return F.get("_triples", number.bitwiseAND(F.col("_mask")).cast("int"))

    again = F.filter(
        "_ranked",
        lambda x, k: (window(x) == window(F.get("_ranked", k - 1))) | (window(x) == window(F.get("_ranked", k + 1))),
    )
    places = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.col("_mask")).cast("int")))
    placed = ranked.select("*", F.when(F.col("_repeated"), places).alias("_places"))
    words = F.coalesce(covered(F.col("_places")), F.lit(0)).cast("long").alias("n_repeat_words")
    return placed.select("*", words).drop("_bits", "_repeated", "_ranked", "_mask", "_places")


def covered(places: Column) -> Column:
    """Words covered by three-word windows at sorted places: each adds those that the one before it has not covered."""
    steps = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
    )
    return steps["n"]


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    cutoff: float = CUTOFF,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the base statistics, ``base_failed``, ``distance`` and ``kept``.

    ``distance`` is the squared robust Mahalanobis distance within the document's group, null for rows
    that fail the basic limits, which are no part of the estimates either.

    Defined results: a null or empty text has no words and fails; null languages and sources form groups
    like any other; small groups are put together (``LEAST_GROUP``), and if even all small groups together
    are too few, their rows are kept; repeated rows count as often as they occur; an empty table gives no
    rows; other columns are not looked at.
    """
    lang, source = F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    base = text_statistics(docs, id_col, text_col, lang, source).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    )
    measured = staged(base, "statistics")
    coordinates = [F.expr(s.value).cast("double").alias(f"x{i}") for i, s in enumerate(STATISTICS)]
    judged = measured.where("not base_failed")
    groups = group_names(judged)
    found = judged.join(groups, same_group(judged, groups)).select(
        judged["doc_id"], "group", *coordinates
    )
    estimates = mcd(found.drop("doc_id"))
    placed = measured.join(groups, same_group(measured, groups), "left").select(
        measured["*"], groups["group"], *(F.when(~F.col("base_failed"), c).alias(f"x{i}") for i, c in enumerate(coordinates))
    )
    rated = distance(placed.join(estimates, "group", "left")).select(
        *(c for c in measured.columns if c not in ("lang", "source")), (F.col("d2") / F.col("scale")).alias("distance")
    )
    return rated.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))


def same_group(rows: DataFrame, groups: DataFrame) -> Column:
    return rows["lang"].eqNullSafe(groups["lang"]) & rows["source"].eqNullSafe(groups["source"])


def group_names(judged: DataFrame) -> DataFrame:
    """``lang, source, group`` for groups that are large enough, alone or put together. One row per pair."""
    pairs = judged.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") < LEAST_GROUP
    by_lang = F.sum(F.when(small, F.col("_n"))).over(Window.partitionBy("lang"))
    name = (
        F.when(~small, F.to_json(F.struct("lang", "source", F.lit(2).alias("level"))))
        .when(by_lang >= LEAST_GROUP, F.to_json(F.struct("lang", F.lit(1).alias("level"))))
        .otherwise(F.lit("rest"))
    )
    named = pairs.select("lang", "source", "_n", name.alias("group"))
    sizes = named.groupBy("group").agg(F.sum("_n").alias("_all")).where(F.col("_all") >= LEAST_GROUP).select("group")
    return staged_small(named.join(sizes, "group").select("lang", "source", "group"), "groups")


def mcd(rows: DataFrame) -> DataFrame:
    """Estimates per ``group`` of ``rows(group, x0, x1, …)``: mean ``m*``, Cholesky factor ``l*_*``, ``scale``."""
    points = staged(rows, "points")
    start = centre_and_spread(points).unionByName(factor(moments(points.withColumn("start", F.lit("moments")))))
    at = staged_small(start, "mcd")
    for _ in range(MOST_STEPS):
        rated = distance(points.join(at, "group"))
        binned = rated.select("group", "start", *x_names(), distance_bin(F.col("d2")).alias("bin"))
        limit = staged_small(quantile_bin(binned, CORE), "limit")
        core = binned.join(limit, ["group", "start"]).where("bin <= limit")
        before, at = at, staged_small(factor(moments(core)), "mcd")
        fell = before.select("group", "start", F.col("logdet").alias("_before")).join(at, ["group", "start"])
        if fell.where(F.col("_before") - F.col("logdet") > TOLERANCE).isEmpty():
            break
    best = at.groupBy("group").agg(F.min_by(F.struct(*(c for c in at.columns if c != "group")), F.struct("logdet", "start")).alias("b")).select("group", "b.*")
    rated = distance(points.join(best, "group")).select("group", "start", distance_bin(F.col("d2")).alias("bin"))
    middle = quantile_bin(rated, 0.5).select("group", (F.exp(F.col("limit") / BINS) / CHI_MEDIAN).alias("scale"))
    return staged_small(best.join(middle, "group").drop("start", "logdet"), "mcd")


def x_names() -> list[str]:
    return [f"x{i}" for i in range(len(STATISTICS))]


def distance_bin(d2: Column) -> Column:
    return F.floor(F.ln(d2 + 1e-6) * BINS)


def quantile_bin(binned: DataFrame, share: float) -> DataFrame:
    """Per group and start the first bin that reaches ``share`` of the rows, from counts per bin."""
    counts = binned.groupBy("group", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("group", "start")
    summed = counts.select(
        "group", "start", "bin",
        F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("n").over(group).alias("all"),
    )
    return summed.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy("group", "start").agg(F.min("bin").alias("limit"))


def centre_and_spread(points: DataFrame) -> DataFrame:
    """The first start: median and MAD per coordinate, from histograms of 1/100 units, as a diagonal factor."""
    long = points.select("group", F.posexplode(F.array(*x_names())).alias("start", "x"))
    binned = long.select("group", "start", "x", F.round(F.col("x") * 100).cast("long").alias("bin"))
    median = staged_small(quantile_bin(binned, 0.5).withColumnRenamed("limit", "median"), "median")
    away = binned.join(median, ["group", "start"]).select("group", "start", F.abs(F.col("bin") - F.col("median")).alias("bin"))
    mad = quantile_bin(away, 0.5).withColumnRenamed("limit", "mad")
    both = median.join(mad, ["group", "start"]).groupBy("group").pivot("start", list(range(len(STATISTICS)))).agg(
        F.first("median").alias("m"), F.first("mad").alias("s")
    )
    spread = [F.greatest(F.col(f"{i}_s") * 0.014826, F.lit(s.least)) for i, s in enumerate(STATISTICS)]
    return both.select(
        "group",
        F.lit("median").alias("start"),
        *((F.col(f"{i}_m") / 100.0).alias(f"m{i}") for i in range(len(STATISTICS))),
        *((spread[i] if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i in range(len(STATISTICS)) for j in range(i + 1)),
        reduce(lambda a, b: a + b, (F.ln(s) for s in spread)).alias("logdet"),
    )


def moments(rows: DataFrame) -> DataFrame:
    """Means and covariances per group and start, with the least spreads added to the variances."""
    p = range(len(STATISTICS))
    pairs = [(i, j) for i in p for j in range(i + 1)]
    return rows.groupBy("group", "start").agg(
        *(F.avg(f"x{i}").alias(f"m{i}") for i in p),
        *((F.covar_pop(f"x{i}", f"x{j}") + (STATISTICS[i].least ** 2 if i == j else 0.0)).alias(f"c{i}_{j}") for i, j in pairs),
    )


def factor(estimates: DataFrame) -> DataFrame:
    """Replace the covariance by its lower Cholesky factor and the logarithm of its determinant."""
    p = range(len(STATISTICS))
    for i in p:
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), F.col(f"c{i}_{j}"))  # noqa: B023
            estimates = estimates.withColumn(f"l{i}_{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}_{j}"))
    logdet = reduce(lambda a, b: a + b, (F.ln(f"l{i}_{i}") for i in p))
    return estimates.withColumn("logdet", logdet).drop(*(f"c{i}_{j}" for i in p for j in range(i + 1)))


def distance(rows: DataFrame) -> DataFrame:
    """Add ``d2``, the squared Mahalanobis distance, by forward substitution."""
    p = range(len(STATISTICS))
    for i in p:
        rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"z{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))  # noqa: B023
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    d2 = reduce(lambda a, b: a + b, (F.col(f"z{i}") * F.col(f"z{i}") for i in p))
    return rows.withColumn("d2", d2).drop(*(f"z{i}" for i in p))
