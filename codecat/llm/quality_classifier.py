"""Document quality from line labels of a linear-chain conditional random field.

Every line with a word is labelled good or bad. A line is described by its own
statistics and by those of its neighbours; the chain adds how labels follow each other.
Forward-backward gives the marginal of "good" per line, and their mean, weighted by the
lines' lengths, is the quality of the document, put on the scale of a probability by a
logistic curve.

The model is fitted on the driver to a bounded sample of labelled documents
(``SAMPLE`` of each label, none above ``SAMPLE_LINES`` lines or ``SAMPLE_BYTES``), whose
lines take the document's label. Scoring is one pass over whole texts; rows never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .words import give_back, giving_back, slices, words_of

#: The most documents of each label that the model is fitted to, and the most lines and bytes of each.
SAMPLE, SAMPLE_LINES, SAMPLE_BYTES = 2000, 1000, 100_000
#: A document is good from this score on.
GOOD = 0.7
#: Rows whose CRC-32 of the id, modulo 4, is this are never learned from.
HELD_OUT = 2

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_BYTES, [ord(c) for c in ".?!:;"])
_MARK = np.isin(_BYTES, [ord(c) for c in "!#$%&*<>@\\^_`{|}~"])
_PLAIN = np.isin(_BYTES, [ord(c) for c in ".,;:?'\"()-"])
#: Statistics of a line, in the order of the columns of :func:`line_features`.
STATISTICS = (
    "log words", "log bytes", "mean word length", "upper case", "digits", "marks", "plain punctuation", "distinct words",
    "words equal to the one before", "ends a sentence", "begins in upper case", "equals the line before",
)


@dataclass
class Lines:
    """The lines with words of a block of texts: features, lengths in bytes, and the first line of each text."""

    features: np.ndarray
    lengths: np.ndarray
    first: np.ndarray


def line_features(texts: pa.Array) -> Lines:
    """Cut texts into lines and describe each by itself and its neighbours."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    owner, lines = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    words = words_of(lines)
    n_words = np.diff(words.first)
    full = np.flatnonzero(n_words)
    ends = np.cumsum(pc.binary_length(lines).to_numpy())
    begins = (ends - np.diff(np.append(0, ends)))[full]
    ends, n_words = ends[full], n_words[full].astype(float)
    first = np.searchsorted(owner[full], np.arange(len(texts) + 1))

    def share(of: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(of[words.data], dtype=np.int64))
        return sums[ends] - sums[begins]

    solid = np.maximum(ends - begins - share(_SPACE), 1).astype(float)
    hashes = words.hashes()
    line = np.repeat(np.arange(len(full)), n_words.astype(np.int64))
    order = np.argsort(hashes)
    order = order[np.argsort(line[order], kind="stable")]
    a, h = line[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
    same = (line[1:] == line[:-1]) & (hashes[1:] == hashes[:-1])
    sums = np.bincount(line, hashes.astype(np.float64), len(full))
    starts, last = words.starts[words.first[:-1][full]], words.ends[words.first[1:][full] - 1] - 1
    again = np.zeros(len(full))
    again[1:] = (sums[1:] == sums[:-1]) & (n_words[1:] == n_words[:-1])
    again[first[:-1][first[:-1] < len(full)]] = 0
    own = np.column_stack(
        [
            np.log1p(n_words), np.log1p(ends - begins), solid / n_words, share(_UPPER) / solid, share(_DIGIT) / solid,
            share(_MARK) / solid, share(_PLAIN) / solid, np.bincount(a[new], minlength=len(full)) / n_words,
            np.bincount(line[1:][same], minlength=len(full)) / n_words, _STOP[words.data[last]], _UPPER[words.data[starts]], again,
        ]
    ).reshape(len(full), len(STATISTICS))
    heads, tails = np.zeros((len(full), 1)), np.zeros((len(full), 1))
    some = np.diff(first) > 0
    heads[first[:-1][some]] = 1
    tails[first[1:][some] - 1] = 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    features = np.hstack([own, before * (1 - heads), after * (1 - tails), heads, tails])
    return Lines(features, (ends - begins).astype(float), first)


def joined(parts: list[Lines]) -> Lines:
    """The lines of several blocks of texts; their working memory is that of one block at a time."""
    if not parts:
        return line_features(pa.array([], pa.string()))
    upto = np.cumsum([0, *(len(p.lengths) for p in parts)])
    first = [p.first[:-1] + a for p, a in zip(parts, upto.tolist())]
    return Lines(np.concatenate([p.features for p in parts]), np.concatenate([p.lengths for p in parts]), np.append(np.concatenate(first), upto[-1]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def steps(first: np.ndarray) -> list[np.ndarray]:
    """For step t, the lines that are the t-th of their text, longest texts first, so each is a prefix of the one before."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = first[:-1][order], sizes[order]
    live = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    return [begins[:n] + t for t, n in enumerate(live.tolist())]


@dataclass
class Chain:
    """A binary chain: weights of standardised features and bias, and a 2 x 2 table of transition scores."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    table: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def unary(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.spread, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]

    def messages(self, unary: np.ndarray, order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log-odds of "good" per line."""
        (t00, t01), (t10, t11) = self.table
        ahead, back = unary.copy(), np.zeros_like(unary)
        for before, now in zip(order, order[1:]):
            a = ahead[before[: len(now)]]
            ahead[now] += np.logaddexp(t01, t11 + a) - np.logaddexp(t00, t10 + a)
        for now, after in zip(order[-2::-1], order[:0:-1]):
            b = unary[after] + back[after]
            back[now[: len(after)]] = np.logaddexp(t10, t11 + b) - np.logaddexp(t00, t01 + b)
        return ahead, back

    def quality(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean marginal of "good" per text; 0 without lines."""
        ahead, back = self.messages(self.unary(lines.features), steps(lines.first))
        owner = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
        weight = np.bincount(owner, lines.lengths, len(lines.first) - 1)
        good = np.bincount(owner, lines.lengths * sigmoid(ahead + back), len(lines.first) - 1)
        return good / np.maximum(weight, 1)

    def score(self, lines: Lines) -> np.ndarray:
        quality = np.clip(self.quality(lines), 1e-6, 1 - 1e-6)
        score = sigmoid(self.slope * np.log(quality / (1 - quality)) + self.shift)
        return np.where(np.diff(lines.first) > 0, score, 0.0)


def fit(lines: Lines, label: np.ndarray, weight: np.ndarray, rounds: int = 250, ridge: float = 1e-3) -> Chain:
    """Maximise the penalised likelihood of the line labels by Adam steps; then fit the logistic curve.

    Each text counts ``weight``, shared evenly by its lines, so that long texts don't decide alone.
    """
    sizes = np.diff(lines.first)
    y, owner = np.repeat(label, sizes).astype(float), np.repeat(np.arange(len(sizes)), sizes)
    each = (weight / np.maximum(sizes, 1))[owner]
    total = each.sum()
    mean, spread = lines.features.mean(0), lines.features.std(0) + 1e-3
    chain = Chain(mean, spread, np.zeros(lines.features.shape[1] + 1), np.zeros((2, 2)))
    z = np.clip((lines.features - mean) / spread, -8, 8)
    order = steps(lines.first)
    left = np.flatnonzero(owner[1:] == owner[:-1])
    right = left + 1
    pair_weight = each[right]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[left].astype(int), y[right].astype(int)), pair_weight)
    values, first, second = np.zeros(len(chain.weights) + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        unary = z @ chain.weights[:-1] + chain.weights[-1]
        ahead, back = chain.messages(unary, order)
        miss = each * (y - sigmoid(ahead + back))
        after = unary[right] + back[right]
        logs = np.stack(
            [
                np.full(len(left), chain.table[0, 0]), chain.table[0, 1] + after,
                chain.table[1, 0] + ahead[left], chain.table[1, 1] + ahead[left] + after,
            ]
        )
        logs = np.exp(logs - logs.max(0, initial=-np.inf, where=True)) if len(left) else logs
        pairs = (logs / logs.sum(0) * pair_weight).sum(1).reshape(2, 2) if len(left) else np.zeros((2, 2))
        slope = np.concatenate([miss @ z, [miss.sum()], (seen - pairs).ravel()]) / total - ridge * values
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        rate = 0.1 * min(1.0, 2 * (1 - k / (rounds + 1)))
        values = values + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        chain.weights, chain.table = values[:-4], values[-4:].reshape(2, 2)
    some = sizes > 0
    quality = np.clip(chain.quality(lines)[some], 1e-6, 1 - 1e-6)
    chain.slope, chain.shift = logistic(np.log(quality / (1 - quality)), label[some].astype(float), weight[some])
    return chain


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridge logistic curve, by Newton steps; the slope stays positive."""
    design, at = np.column_stack([x, np.ones_like(x)]), np.array([1.0, 0.0])
    penalty = np.diag([1.0, 0.1])
    for _ in range(50):
        p = sigmoid(design @ at)
        slope = design.T @ (weight * (y - p)) - penalty @ (at - [1.0, 0.0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty
        at = at + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return max(float(at[0]), 1e-3), float(at[1])


def held_out(id_col: Column) -> Column:
    """Whether a row is never learned from; a null id is not held out, but has no label either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> Chain:
    """Fit the chain to at most ``sample`` labelled documents of each label that are not held out.

    The sample is the ids with the smallest hashes, so it does not depend on the order of rows. Documents
    with more than ``SAMPLE_LINES`` lines or ``SAMPLE_BYTES`` are no examples. The labels' shares in the whole table weigh the
    two halves. Ids labelled both ways and null labels are passed over; without any labelled document, or
    with one label only, the chain is flat and every text with a word scores that label's share.
    """
    usable = (
        labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("_y"), F.max(label_col).alias("_y2"))
        .where("_y = _y2")
    )
    counts = dict(usable.groupBy("_y").count().collect())
    halves = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample).select("_id", "_y") for y in (0, 1)]
    chosen = staged(halves[0].unionByName(halves[1]), "sample")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    examples = (
        texts.join(F.broadcast(chosen), "_id")  # at most twice the sample
        .where((F.regexp_count("_text", F.lit("\n")) < SAMPLE_LINES) & (F.octet_length("_text") <= SAMPLE_BYTES))
        .dropDuplicates(["_id"])
        .select("_id", "_y", "_text")
    )
    rows = examples.orderBy("_id").limit(2 * sample).toArrow()
    lines = joined([line_features(some.column("_text")) for part in rows.to_batches() for some in slices(part, "_text")])
    label = rows.column("_y").to_numpy()
    del rows
    give_back()
    if len(set(label.tolist())) < 2:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        flat = np.zeros(3 * len(STATISTICS) + 2)
        return Chain(flat, flat + 1, np.append(flat, 0.0), np.zeros((2, 2)), 1.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    weight = np.array([counts[y] / (label == y).sum() for y in label.tolist()])
    chain = fit(lines, label, weight * len(label) / weight.sum())
    del lines
    give_back()
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, score, predicted``.

    Defined results: a text without words (null, empty, blank) scores 0; repeated rows score alike; null
    ids are handed on; an empty table gives no rows; other columns are not looked at.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in slices(part, "_text"):
                values = chain.score(line_features(rows.column("_text")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(giving_back(read), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def keep_good(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score as good, with all their columns, in one pass.

    Defined results: texts without words (null, empty, blank) go; repeated rows stay or go together; null ids and columns of
    any name are handed on; an empty table gives no rows.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in slices(part, text_col):
                yield rows.filter(pa.array(chain.score(line_features(rows.column(text_col))) >= GOOD))

    return docs.mapInArrow(giving_back(read), docs.schema)
