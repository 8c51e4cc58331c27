"""Periodic runs of words, by suffix trees and Lyndon roots.

A run is a stretch of words with smallest period ``q`` that cannot be extended to either side and is long
enough: ``LEAST`` words and ``TIMES`` periods. Each run holds a Lyndon word as long as its period, and that is
the longest Lyndon word at its start, in the order of the words or in the reverse order (the runs theorem,
Bannai et al., 2017). So every start gives two candidates, the longest Lyndon words there. Each is extended in both directions
by longest common extensions: to the right in the suffix tree of the words, to the left in that of their
reversal. The trees are Ukkonen's; a common extension is the depth of the lowest common ancestor of two
leaves, a range minimum over the Euler tour, looked up in a sparse table in constant time.

Trees are made for the stretches of a document that can hold a run. In a run, all windows of ``GRAM`` words but
those in its first period occur also a period before. A stretch of such windows bounds the period, so windows
that occur too far before drop out, until nothing changes; a stretch with the longest possible period in
front of it holds all runs whose windows it has, and the words beside them. This only compares hashes of words,
for a block of documents at once, and loses nothing. The stretches of a block share a tree; a
separator of its own ends each, below all words in both orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, inside_text, slices, windows, words_of

#: The least length of a run, in words and in periods.
LEAST, TIMES = 24, 3
#: Words of a window. The windows of a run but those of its first period are at least LEAST_WINDOWS, whatever the period:
#: the length less the period is least where LEAST is TIMES periods, and is there 16.
GRAM = 8
LEAST_WINDOWS = LEAST - LEAST // TIMES - GRAM + 1
#: Words of stretches that share a tree, unless one stretch is longer.
TREE_WORDS = 60_000


# -- stretches -------------------------------------------------------------


def last_before(keys: np.ndarray) -> np.ndarray:
    """How far before each key the same key occurs last; 0 if it does not."""
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    back = np.zeros(len(keys), np.int64)
    back[order[same + 1]] = order[same + 1] - order[same]
    return back


def stretches(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of a block that can hold runs; each lies in one text."""
    n, first = len(hashes), words.first
    if n < GRAM:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = windows(hashes, GRAM, seed=5)
    whole = np.flatnonzero(inside_text(first, GRAM))
    back = np.zeros(n + 1, np.int64)
    nearest = last_before(grams[whole])
    source = whole[np.arange(len(whole)) - nearest]
    back[whole] = np.where((nearest > 0) & (text[source] == text[whole]), whole - source, 0)
    alive = back > 0
    while True:
        edge = np.flatnonzero(np.diff(alive.astype(np.int8), prepend=0, append=0))
        starts, ends = edge[::2], edge[1::2]
        # neighbours of two texts are never one stretch: the last windows of a text are not whole
        longest = (ends - starts + GRAM - 1) // (TIMES - 1)
        keep = ends - starts >= LEAST_WINDOWS
        bound = np.zeros(n + 1, np.int64)
        bound[:-1] = spread(np.where(keep, longest, 0), starts, ends, n)
        now = alive & (back <= bound)
        if np.array_equal(now, alive):
            break
        alive = now
    return np.maximum(starts - longest - 1, first[text[starts]]), np.minimum(ends + GRAM, first[text[starts] + 1])


def spread(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Each value over its range, zero elsewhere; the ranges are apart."""
    out = np.zeros(n + 1, np.int64)
    out[starts] += values
    out[ends] -= values
    return np.cumsum(out)[:n]


# -- suffix trees ----------------------------------------------------------


@dataclass
class Tree:
    """A suffix tree: per node its parent, first word, depth in words, and for leaves the start of the suffix (else -1)."""

    parent: np.ndarray
    letter: np.ndarray
    depth: np.ndarray
    suffix: np.ndarray


def ukkonen(codes: list[int]) -> Tree:
    """The suffix tree of ``codes``, built from left to right. The last code occurs once."""
    n, width = len(codes), max(codes, default=0) + 1
    child: dict[int, int] = {}
    start, link, depth, suffix = [0], [0], [0], [-1]
    node = edge = length = waiting = 0
    for i, code in enumerate(codes):
        waiting += 1
        above = 0  # the inner node made last, which still needs its link
        while waiting:
            if not length:
                edge = i
            key = node * width + codes[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                link.append(0)
                depth.append(n - (i - waiting + 1))
                suffix.append(i - waiting + 1)
                if above:
                    link[above] = node
                    above = 0
            else:
                span = depth[below] - depth[node]
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                middle = start[below] + length
                if codes[middle] == code:
                    length += 1
                    if above:
                        link[above] = node
                    break
                split = len(start)
                child[key] = split
                start.append(start[below])
                link.append(0)
                depth.append(depth[node] + length)
                suffix.append(-1)
                start[below] = middle
                child[split * width + codes[middle]] = below
                child[split * width + code] = split + 1
                start.append(i)
                link.append(0)
                depth.append(n - (i - waiting + 1))
                suffix.append(i - waiting + 1)
                if above:
                    link[above] = split
                above = split
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    size = len(start)
    keys = np.fromiter(child.keys(), np.int64, len(child))
    nodes = np.fromiter(child.values(), np.int64, len(child))
    parent, letter = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    parent[nodes], letter[nodes] = keys // width, keys % width
    return Tree(parent, letter, np.array(depth, np.int64), np.array(suffix, np.int64))


@dataclass
class Children:
    """The children of all nodes in an order, as one array; those of node ``x`` are ``nodes[at[x]:at[x + 1]]``."""

    nodes: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, tree: Tree, letter: np.ndarray) -> Children:
        nodes = 1 + np.lexsort((letter[1:], tree.parent[1:]))
        return cls(nodes, np.searchsorted(tree.parent[nodes], np.arange(len(tree.parent) + 1)))


class Extensions:
    """Longest common prefixes of suffixes, each by one look into a sparse table over the Euler tour."""

    def __init__(self, tree: Tree, children: Children):
        nodes, at, depth = children.nodes.tolist(), children.at.tolist(), tree.depth.tolist()
        stack, tour, entered = [0], [], [0] * len(depth)
        order: list[int] = []
        while stack:
            x = stack.pop()
            if x < 0:  # back at an inner node
                tour.append(depth[~x])
                continue
            entered[x] = len(tour)
            order.append(x)
            tour.append(depth[x])
            for c in reversed(nodes[at[x] : at[x + 1]]):
                stack.append(~x)
                stack.append(c)
        self.order = np.array(order, np.int64)
        leaf = np.flatnonzero(tree.suffix >= 0)
        self.place = np.empty(len(leaf), np.int64)
        self.place[tree.suffix[leaf]] = np.array(entered, np.int64)[leaf]
        self.levels = [np.array(tour, np.int32)]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(tour):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common length of the suffixes at ``a`` and at ``b``, pairs of different ones."""
        low, high = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b]) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            table = self.levels[k]
            out[some] = np.minimum(table[low[some]], table[high[some] - (1 << k)])
        return out


def leaf_counts(tree: Tree, order: np.ndarray) -> np.ndarray:
    """The leaves below each node; ``order`` is that of a walk that enters parents before children."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    last = place.tolist()
    back = order[:0:-1]
    for x, p in zip(back.tolist(), tree.parent[back].tolist()):
        if last[x] > last[p]:
            last[p] = last[x]
    upto = np.concatenate([[0], np.cumsum(tree.suffix[order] >= 0)])
    return upto[np.array(last) + 1] - upto[place]


def ranks(tree: Tree, order: np.ndarray, count: np.ndarray, children: Children) -> np.ndarray:
    """The rank of each suffix where children follow each other as given: the leaves of all nodes passed on the way."""
    nodes, parent = children.nodes, tree.parent[children.nodes]
    before = np.zeros(len(order), np.int64)
    upto = np.cumsum(count[nodes]) - count[nodes]
    before[nodes] = upto - upto[children.at[parent]]
    rank = before.tolist()
    for x, p in zip(order[1:].tolist(), tree.parent[order[1:]].tolist()):
        rank[x] += rank[p]
    leaf = np.flatnonzero(tree.suffix >= 0)
    out = np.empty(len(leaf), np.int64)
    out[tree.suffix[leaf]] = np.array(rank, np.int64)[leaf]
    return out


def lyndon(rank: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word at each place: up to the next smaller suffix."""
    n = len(rank)
    out = [0] * n
    waiting: list[int] = []
    values = rank.tolist()
    for i, r in enumerate(values):
        while waiting and values[waiting[-1]] > r:
            j = waiting.pop()
            out[j] = i - j
        waiting.append(i)
    for j in waiting:
        out[j] = n - j
    return np.array(out, np.int64)


def runs_of(codes: np.ndarray, separators: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of at least ``TIMES`` periods and ``LEAST`` words.

    Codes below ``separators`` are those that end the stretches, each used once.
    """
    n = len(codes)
    # an end mark beyond all others; as a separator, it is smaller than any word, too
    ahead = np.append(codes + 1, 0)
    tree = ukkonen(ahead.tolist())
    plain = Children.of(tree, tree.letter)
    right = Extensions(tree, plain)
    turned = np.where(tree.letter <= separators, tree.letter, separators + 1 + tree.letter.max() - tree.letter)
    count = leaf_counts(tree, right.order)
    orders = [ranks(tree, right.order, count, children) for children in (plain, Children.of(tree, turned))]
    mirror = np.append(codes[::-1] + 1, 0)
    back = ukkonen(mirror.tolist())
    left = Extensions(back, Children.of(back, back.letter))
    found = []
    word = np.flatnonzero(codes >= separators)
    for rank in orders:
        period = lyndon(rank[:n])[word]
        again = word + period
        on = again < n
        i, p, j = word[on], period[on], again[on]
        ahead_of = right.common(i, j)
        behind = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        behind[inner] = left.common(n - i[inner], n - j[inner])
        length = p + ahead_of + behind
        long = (length >= LEAST) & (length >= TIMES * p)
        found.append(np.stack([i - behind, length, p])[:, long])
    starts, lengths, periods = np.unique(np.concatenate(found, axis=1), axis=1)
    return starts, lengths, periods


# -- documents -------------------------------------------------------------


def block_runs(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Rows ``text, start, length, period`` of all runs of a block of texts, in that order."""
    begins, ends = stretches(words, hashes)
    found = [np.empty((0, 4), np.int64)]
    size = np.cumsum(ends - begins)
    group = (size - 1) // TREE_WORDS if len(size) else size
    cuts = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1 if len(group) else 0)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        low, lengths = begins[a:b], (ends - begins)[a:b]
        k = b - a
        at = np.cumsum(lengths + 1) - lengths - 1
        places = np.arange(int(lengths.sum())) + np.repeat(low - (np.cumsum(lengths) - lengths), lengths)
        codes = np.empty(int(lengths.sum()) + k, np.int64)
        codes[at + lengths] = np.arange(k)
        inside = np.ones(len(codes), bool)
        inside[at + lengths] = False
        codes[inside] = k + np.unique(hashes[places], return_inverse=True)[1]
        starts, sizes, periods = runs_of(codes, k)
        stretch = np.searchsorted(at, starts, side="right") - 1
        start = low[stretch] + starts - at[stretch]
        text = np.searchsorted(words.first, start, side="right") - 1
        # What touches a cut inside the text belongs to a neighbouring stretch, which has it whole.
        whole = (start > low[stretch]) | (start == words.first[text])
        end = start + sizes
        whole &= (end < low[stretch] + lengths[stretch]) | (end == words.first[text + 1])
        found.append(np.stack([text, start - words.first[text], sizes, periods], axis=1)[whole])
    return np.unique(np.concatenate(found), axis=0)


def collapsed(words: Words, runs: np.ndarray) -> pa.Array:
    """Per text, the words outside the repeated periods of its runs, joined by one space."""
    n, first = len(words.starts), words.first
    edge = np.zeros(n + 1, np.int64)
    start = first[runs[:, 0]] + runs[:, 1]
    np.add.at(edge, start + runs[:, 3], 1)
    np.add.at(edge, start + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    starts, ends = words.starts[kept], words.ends[kept]
    at = np.searchsorted(kept, first)
    followed = np.ones(len(kept), bool)
    followed[at[1:][at[1:] > at[:-1]] - 1] = False
    # The byte after a word that another one follows is a separator of the same text.
    change = np.zeros(len(words.data) + 2, np.int8)
    change[starts] = 1
    change[ends + followed] -= 1
    data = words.data.copy()
    data[ends[followed]] = ord(" ")
    out = data[np.cumsum(change[: len(data)], dtype=np.int8) > 0]
    upto = np.concatenate([[0], np.cumsum(ends - starts + followed)])[at]
    buffers = [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(out)]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, buffers).cast(pa.string())


SCHEMA = "runs array<struct<start:long,length:long,period:long>>, collapsed string"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, runs`` (by start, then period) and ``collapsed``.

    Words are maximal runs of characters other than space and U+0009 to U+000D, numbered from 0. ``collapsed`` has the words, joined by
    one space, without those that some run contains after its first period.

    Defined results: a null text has no words, no runs and an empty ``collapsed``; repeated rows and null ids
    are rows like any other; an empty table gives no rows; other columns are not looked at. Rows
    stay in their tasks. A task holds about 2 MB of text, or one text if that is longer, and some 300 bytes for each word
    of a tree.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in slices(part, "_text"):
                words = words_of(block.column("_text"))
                found = block_runs(words, words.hashes())
                at = np.searchsorted(found[:, 0], np.arange(block.num_rows + 1))
                lists = pa.ListArray.from_arrays(
                    pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, k].copy()) for k in (1, 2, 3)], fields=list(run))
                )
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array(np.diff(words.first), pa.int64()), lists, collapsed(words, found)],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return rows.mapInArrow(read, f"doc_id {kind}, n_words long, {SCHEMA}")
