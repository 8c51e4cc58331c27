"""SentencePiece encoding and decoding with sampled segmentations.

The lattice of a text has a node between any two characters and an edge for every
vocabulary piece (bytes where no piece fits). Paths are the segmentations; their
probabilities follow from the pieces' scores. Gumbel top-k draws distinct paths without
replacement: each path has its log-probability perturbed by a Gumbel value, and a best-first
(A*) search finds the paths of the largest ones without visiting the others:

* the bound of a set of paths is its perturbed log-mass. The root's is a plain Gumbel
  value; a set split into parts hands its bound to one part, drawn by mass, and gives the
  others lower, truncated values;
* following that part down to a single path is ancestral sampling. At each step the rest
  of the edges becomes an open set in the queue; the best open set is split next.

No piece crosses the start of a run of spaces or holds a line feed, so the lattice falls into
units there, and a unit's backward masses serve every place where it occurs. Units are sampled side by side
with NumPy. All random values are hashes of seed, row key, sample and place, so a row's
samples depend on nothing else.

The model is a public vocabulary of the BPE kind, which has ranks but no probabilities.
Pieces get log-probabilities by Zipf's law of their rank. Texts come back exactly: spaces and
the word mark are told apart by writing the mark itself in bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Numbers, give_back, giving_back, keys, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct segmentations per text.
SAMPLES = 2
#: Zipf's law: a piece of rank r has weight 1 / (r + OFFSET); a byte counts as the rarest piece, BYTE nats below.
OFFSET, BYTE = 2.7, 2.0
#: The mark that stands for a space in the vocabulary.
MARK = "▁"
#: Open sets whose log-mass is so far below the largest cannot win within double precision.
FAR = 37.0
#: The nodes of lattices kept by a task, beyond which they are made anew, and the bytes of text sampled at a time.
KEPT_NODES, BLOCK_BYTES = 1_200_000, 128 << 10

#: Slots that the table of units starts with, as a power of two.
UNIT_BITS = 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Units hashed in one go.
_UNITS_AT_ONCE = 200_000


#: Slots of the table of trie links, as a power of two.
SLOT_BITS = 19


def slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * _STEP) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Vocabulary:
    """Pieces (the mark read as a space) as a trie, and what each id scores and decodes to.

    ``links`` is an open-addressing table of the keys ``node << 21 | character`` of the trie's links, ``targets`` the
    nodes they lead to, ``probes`` the longest search in it, ``piece_at`` the piece that ends at a node, or -1.
    """

    scores: np.ndarray
    byte_ids: np.ndarray
    decoded: list[bytes]
    links: np.ndarray
    targets: np.ndarray
    probes: int
    piece_at: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        byte_ids, decoded, scores = np.zeros(256, np.int32), [b""] * n, np.full(n, -np.inf)
        ranks = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        trie, ends = {}, [-1]
        for rank, i in enumerate(ranks, 1):
            piece, node = model.id_to_piece(i).replace(MARK, " "), 0
            scores[i], decoded[i] = -math.log(rank + OFFSET), piece.encode()
            for c in piece:
                node = trie.setdefault(node << 21 | ord(c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                byte_ids[value], decoded[i], scores[i] = i, bytes([value]), -math.log(len(ranks) + OFFSET) - BYTE
        size, probes = 1 << SLOT_BITS, 1
        links, targets = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        for key, at in zip(trie, slots(np.array(list(trie), np.int64)).tolist()):
            tried = 1
            while links[at] >= 0:
                at, tried = (at + 1) % size, tried + 1
            links[at], targets[at], probes = key, trie[key], max(probes, tried)
        return cls(scores, byte_ids, decoded, links, targets, probes, np.array(ends, np.int32))

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The node behind each link, or -1."""
        at = slots(keys)
        found = np.where(self.links[at] == keys, self.targets[at], -1)
        for _ in range(1, self.probes):
            open_ = np.flatnonzero((found < 0) & (self.links[at] >= 0))
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % len(self.links)
            found[open_] = np.where(self.links[at[open_]] == keys[open_], self.targets[at[open_]], -1)
        return found

    @cached_property
    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that all ids decode to, one after the other, and where each id's begin (and the end)."""
        return np.frombuffer(b"".join(self.decoded), np.uint8), np.cumsum([0, *map(len, self.decoded)])

    def byte_tokens(self, code: int) -> np.ndarray:
        return self.byte_ids[list(chr(code).encode("utf-8", "surrogatepass"))]


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker, for all its tasks."""
    return Vocabulary.load(path)


class Growing:
    """An array that grows at its end; ``used`` is the part in use.

    It is made large enough at once: memory is taken up page by page as it is written, and nothing is copied.
    """

    def __init__(self, kind: type, *first: int) -> None:
        self.room, self.first = np.empty(4 * KEPT_NODES, kind), first
        self.forget()

    def forget(self) -> None:
        """Start anew in the same memory, unless a long text has made it larger."""
        if len(self.room) > 4 * KEPT_NODES:
            self.room = np.empty(4 * KEPT_NODES, self.room.dtype)
        self.n = len(self.first)
        self.room[: self.n] = self.first
        self.used = self.room[: self.n]

    def extend(self, values: np.ndarray) -> np.ndarray:
        end = self.n + len(values)
        if end > len(self.room):
            room = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.used
            self.room = room
        self.room[self.n : end] = values
        self.n, self.used = end, self.room[:end]
        return self.used


@dataclass
class Lattices:
    """The lattices of all units seen, as flat arrays. A node per character, each with a run of edges, longest first.

    ``limit`` is the probability of an edge or one before it (single precision, for draws only), ``head`` the node behind it (-1: the end of the unit),
    ``token`` its piece, or below zero the character that is written in bytes: -1 - code.
    """

    vocabulary: Vocabulary
    n_nodes: int = 0

    def __post_init__(self) -> None:
        self.arrays = {"edge_at": Growing(np.int64, 0), "limit": Growing(np.float32), "chance": Growing(np.float64),
                       "head": Growing(np.int32), "token": Growing(np.int32)}
        self.forget()

    def forget(self) -> None:
        """Drop all units. The arrays stay: new ones would be cut from freed memory here and there, and the process would grow with each."""
        self.root, self.n_nodes = Numbers(UNIT_BITS), 0
        for array in self.arrays.values():
            array.forget()
        self.extend()

    def extend(self, **more: np.ndarray) -> None:
        for name, array in self.arrays.items():
            setattr(self, name, array.extend(more[name]) if name in more else array.used)

    def roots(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first node of each unit; units lie in ``data`` one after the other, and new ones get their lattices."""
        hashes = unit_hashes(data, starts)
        found = self.root.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, example = np.unique(hashes[new], return_index=True)
            ends = np.append(starts[1:], len(data))
            view, at = data.data, new[example]
            units = [str(view[a:b], "utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            sizes = np.array([len(u) for u in units])
            self.root.add(distinct, (self.n_nodes + np.cumsum(sizes) - sizes).astype(np.int32))
            self.build(np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), sizes)
            found[new] = self.root.find(hashes[new])
        return found.astype(np.int64)

    def build(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Lattices of new units, given as one run of characters, all at once."""
        v, n = self.vocabulary, len(codes)
        end = np.repeat(np.cumsum(sizes), sizes)
        begin, state, length = np.arange(n), np.zeros(n, np.int64), 0
        found, counts = [], np.zeros(n, np.int64)
        while len(begin):
            state = v.follow(state.astype(np.int64) << 21 | codes[begin + length])
            hit = state >= 0
            begin, state, length = begin[hit], state[hit], length + 1
            piece = v.piece_at[state]
            full = piece >= 0
            tails, pieces = begin[full], piece[full]
            if length == 1:  # a character that is no piece by itself is written in bytes
                single = -1 - codes
                single[tails] = pieces
                tails, pieces = np.arange(n), single
            found.append((tails, counts[tails], pieces, length))
            counts[tails] += 1
            on = begin + length < end[begin]
            begin, state = begin[on], state[on]
        at = np.concatenate([[0], np.cumsum(counts)])
        tail, token, length = (np.empty(at[-1], np.int32) for _ in range(3))
        for tails, rank, pieces, reach in found:  # the longest first
            place = at[tails + 1] - 1 - rank
            tail[place], token[place], length[place] = tails, pieces, reach
        in_bytes = token < 0
        code = -1 - token
        width = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)
        score = np.where(in_bytes, width * v.scores[v.byte_ids[0]], v.scores[np.maximum(token, 0)])
        weight = self.masses(end - np.arange(n), tail, tail + length, score, at, end)
        chance = np.exp(weight)
        sums = np.cumsum(chance)
        limit = sums - (sums[at[:-1]] - chance[at[:-1]])[tail]
        limit[at[1:] - 1] = 1.0
        head = np.where(tail + length < end[tail], self.n_nodes + tail + length, -1)
        self.extend(edge_at=self.edge_at[-1] + at[1:], limit=limit, chance=chance, head=head, token=token)
        self.n_nodes += n

    @staticmethod
    def masses(left: np.ndarray, tail: np.ndarray, to: np.ndarray, score: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-probability of each edge at its node, from backward log-masses; nodes with the same way to go at once."""
        mass = np.zeros(len(left) + 1)
        weight = np.empty(len(tail))
        order = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2))
        inner = to < end[tail]
        for a, b in zip(bounds, bounds[1:]):
            nodes = order[a:b]
            counts = at[nodes + 1] - at[nodes]
            begins = np.cumsum(counts) - counts
            edges = np.arange(int(counts.sum())) + np.repeat(at[nodes] - begins, counts)
            w = score[edges] + np.where(inner[edges], mass[to[edges]], 0.0)
            top = np.maximum.reduceat(w, begins)
            total = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, counts)), begins))
            mass[nodes] = total
            weight[edges] = w - np.repeat(total, counts)
        return weight

    def draw(self, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        """An edge at each node by a value in (0, 1); most end at the first, longest edge."""
        edge = self.edge_at[node]
        open_ = np.flatnonzero(self.limit[edge] < value)
        while len(open_):
            edge[open_] += 1
            open_ = open_[self.limit[edge[open_]] < value[open_]]
        return edge

    def token_ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of edges one after the other, and how many each edge has."""
        tokens = self.token[edges]
        odd = np.flatnonzero(tokens < 0)
        spelled = {t: self.vocabulary.byte_tokens(-1 - t) for t in np.unique(tokens[odd]).tolist()}
        counts = np.ones(len(tokens), np.int64)
        for t, ids in spelled.items():
            counts[odd[tokens[odd] == t]] = len(ids)
        begins = np.cumsum(counts) - counts
        out = np.repeat(tokens, counts)
        for t, ids in spelled.items():
            for k, i in enumerate(ids.tolist()):
                out[begins[odd[tokens[odd] == t]] + k] = i
        return out, counts


def uniform(state: np.ndarray) -> np.ndarray:
    """Values in (0, 1) from hashed states."""
    return ((mix(state) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def units_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, a space put before each, where units start in them, and where each text's units begin (and the end).

    A unit is a line feed, or a run of spaces with what follows up to the next space or line feed.
    """
    raw = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    space, feed = data == ord(" "), data == ord("\n")
    start = feed | space
    start[1:] &= ~(space[1:] & space[:-1])
    start[1:] |= feed[:-1]
    begins = np.concatenate([[0], ends])
    start[begins[:-1][np.diff(begins) > 0]] = True
    starts = np.flatnonzero(start)
    return data, starts, np.searchsorted(starts, begins)


def unit_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """An odd 64-bit hash per unit."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = np.diff(np.append(starts, len(data)))
    weights, out = keys(int(sizes.max()), seed=33), np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), _UNITS_AT_ONCE):
        low, size = starts[a : a + _UNITS_AT_ONCE], sizes[a : a + _UNITS_AT_ONCE]
        block = data[low[0] : low[0] + int(size.sum())]
        place = np.arange(len(block)) - np.repeat(low - low[0], size)
        out[a : a + _UNITS_AT_ONCE] = np.add.reduceat((block.astype(np.uint64) + np.uint64(1)) * weights[place], low - low[0])
    return mix(out) | np.uint64(1)


@dataclass
class Walk:
    """One path per text: the edges of all texts in order, where each text's and each unit's begin."""

    edges: np.ndarray
    units_at: np.ndarray


def walk(lattices: Lattices, roots: np.ndarray, streams: np.ndarray) -> Walk:
    """Ancestral samples of all units at once; ``streams`` holds a random state per unit."""
    node, live, chosen, owners = roots, np.arange(len(roots)), [], []
    step = np.zeros(1, np.uint64)
    while len(live):
        step = step + _STEP
        edge = lattices.draw(node, uniform(streams[live] + step))
        chosen.append(edge)
        owners.append(live)
        node = lattices.head[edge]
        on = node >= 0
        node, live = node[on], live[on]
    if not chosen:
        return Walk(np.empty(0, np.int64), np.zeros(1, np.int64))
    owner = np.concatenate(owners)
    sizes = np.bincount(owner, minlength=len(roots))
    at = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.empty(len(owner), np.int64)
    for t, (edge, live) in enumerate(zip(chosen, owners)):
        edges[at[live] + t] = edge
    return Walk(edges, at)


@dataclass
class Open:
    """A set of paths in the queue: those of a sample up to ``step`` that then take none of the edges ``taken``.

    ``before`` is the log-probability of the steps up to there.
    """

    bound: float
    sample: int
    step: int
    taken: tuple[int, ...]
    before: float


@dataclass
class Path:
    edges: np.ndarray
    log_prob: float
    bound: float


class Sampler:
    """Draws ``k`` distinct segmentations of each text of a block."""

    def __init__(self, model: str, k: int, seed: int) -> None:
        self.vocabulary, self.k, self.seed = vocabulary(model), k, seed
        self.lattices = Lattices(self.vocabulary)

    def sample(self, texts: list[str], keys: np.ndarray) -> list[tuple[list[Path], float]]:
        """Per text its paths by falling bound, and the bound of the best path not taken (minus infinity if none)."""
        if self.lattices.n_nodes > KEPT_NODES:
            self.lattices.forget()
        lattices = self.lattices
        data, starts, first = units_of(texts)
        roots = lattices.roots(data, starts)
        text_of = np.repeat(np.arange(len(texts)), np.diff(first))
        place = mix((np.arange(len(roots)) - first[text_of]).astype(np.uint64))
        keys = mix(keys ^ mix(np.array([self.seed], np.uint64)))
        paths: list[list[Path]] = [[] for _ in texts]
        queues: list[list[Open]] = [[] for _ in texts]
        live = np.flatnonzero(np.diff(first)).tolist()
        for nth in range(self.k):
            stream = mix(keys + np.full(1, nth + 1, np.uint64) * _STEP)
            fresh = walk(lattices, roots, mix(stream[text_of] + place))
            upto = np.concatenate([[0.0], np.cumsum(np.log(lattices.chance[fresh.edges]))])
            begins = fresh.units_at[first]
            if nth == 0:
                bounds = -np.log(-np.log(uniform(stream)))
                for i in live:
                    a, b = begins[i], begins[i + 1]
                    paths[i].append(Path(fresh.edges[a:b], float(upto[b] - upto[a]), float(bounds[i])))
                splits = [Open(paths[i][0].bound, 0, 0, (), 0.0) for i in live]
            else:
                live = [i for i in live if queues[i]]
                splits = [queues[i].pop(max(range(len(queues[i])), key=lambda q: queues[i][q].bound)) for i in live]  # noqa: B023
                for i, path in zip(live, self.branches([paths[i] for i in live], splits, fresh, upto, roots, first[live], begins[np.array(live, np.int64) + 1], stream[live])):
                    paths[i].append(path)
            self.open(nth, [queues[i] for i in live], [paths[i][-1] for i in live], splits, stream[live])
        return [(p, max((o.bound for o in q), default=-math.inf)) for p, q in zip(paths, queues)]

    def branches(
        self, sources: list[list[Path]], splits: list[Open], fresh: Walk, upto: np.ndarray, roots: np.ndarray, first: np.ndarray, ends: np.ndarray, streams: np.ndarray
    ) -> list[Path]:
        """Leave a path of each text at an open set: draw another edge there, finish the unit, take fresh units after it."""
        if not splits:
            return []
        lattices, rows = self.lattices, np.arange(len(splits))
        stems = [paths[o.sample].edges[: o.step] for paths, o in zip(sources, splits)]
        steps = np.array([o.step for o in splits])
        heads = lattices.head[np.concatenate([np.empty(0, np.int64), *stems])]
        row = np.repeat(rows, steps)
        unit = np.bincount(row[heads < 0], minlength=len(rows))
        last = np.concatenate([[-1], heads])[np.cumsum(steps)]
        node = np.where((steps > 0) & (last >= 0), last, roots[np.minimum(first + unit, len(roots) - 1)])
        # The other edges of each node, one row per text.
        begin, count = lattices.edge_at[node], lattices.edge_at[node + 1] - lattices.edge_at[node]
        edges = begin[:, None] + np.arange(int(count.max()))
        open_ = edges < (begin + count)[:, None]
        for r, o in enumerate(splits):
            for e in o.taken:
                open_[r, e - begin[r]] = False
        weights = np.cumsum(np.where(open_, lattices.chance[np.where(open_, edges, 0)], 0.0), axis=1)
        state = mix(streams + np.uint64(7))
        value = uniform(state) * weights[:, -1]
        place = np.argmax(open_ & (weights >= value[:, None]), axis=1)
        edge = begin + place
        chosen, owners, live = [edge], [rows], rows
        while True:
            node = lattices.head[edge]
            live, node = live[node >= 0], node[node >= 0]
            if not len(live):
                break
            state[live] = mix(state[live] + _STEP)
            edge = lattices.draw(node, uniform(state[live]))
            chosen.append(edge)
            owners.append(live)
        owner, own = np.concatenate(owners), np.concatenate(chosen)
        order = np.argsort(owner, kind="stable")
        own, at = own[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))])
        logs = np.bincount(owner, np.log(lattices.chance[np.concatenate(chosen)]), minlength=len(rows))
        after = fresh.units_at[first + unit + 1]
        total = np.array([o.before for o in splits]) + (logs + upto[ends] - upto[after])
        return [
            Path(np.concatenate([stem, own[a:b], fresh.edges[c:d]]).astype(np.int64), log_prob, o.bound)
            for stem, a, b, c, d, log_prob, o in zip(stems, at.tolist(), at[1:].tolist(), after.tolist(), ends.tolist(), total.tolist(), splits)
        ]

    def open(
        self, nth: int, queues: list[list[Open]], paths: list[Path], splits: list[Open], streams: np.ndarray, columns: int = 64
    ) -> None:
        """Queue the open sets along new paths, as many of the best as can still be split.

        One row per text, one column per step. Texts whose steps are so likely that the columns do not reach far
        enough are done again, among themselves, with more columns.
        """
        if not paths:
            return
        chance, sizes = self.lattices.chance, np.array([len(p.edges) for p in paths])
        start, before, bound = (np.array([getattr(o, name) for o in splits]) for name in ("step", "before", "bound"))
        steps = start[:, None] + np.arange(columns)
        there = steps < sizes[:, None]
        edges = np.zeros(there.shape, np.int64)
        edges[there] = np.concatenate([p.edges[o.step : o.step + columns] for p, o in zip(paths, splits)])
        odds = np.where(there, chance[edges], 1.0)
        logs = np.log(odds)
        prefix = before[:, None] + np.cumsum(logs, axis=1) - logs
        near = there & (prefix >= before[:, None] - FAR)
        short = near[:, -1] & (start + columns < sizes)
        left = np.where(odds < 1.0, 1.0 - odds, 0.0)
        for row, o in enumerate(splits):
            if o.taken:
                left[row, 0] = self.rest(int(edges[row, 0]), o.taken)
        mass = prefix + np.log(left + 1e-300)
        draws = -np.log(uniform(streams[:, None] + (steps + 11).astype(np.uint64) * _STEP))
        values = mass - np.log(np.exp(np.minimum(mass - bound[:, None], 700.0)) + draws)
        values[~near | (left <= 1e-15)] = -np.inf
        best = np.argpartition(-values, min(self.k, columns) - 1, axis=1)[:, : self.k].tolist()
        for row in np.flatnonzero(~short).tolist():
            o = splits[row]
            for s in best[row]:
                if values[row, s] > -np.inf:
                    taken = (*o.taken, int(edges[row, 0])) if s == 0 else (int(edges[row, s]),)
                    queues[row].append(Open(float(values[row, s]), nth, o.step + s, taken, float(prefix[row, s])))
        again = np.flatnonzero(short).tolist()
        # A block has about as many cells as the block's texts have characters, however long a text.
        for i in range(0, len(again), some := max(1, 100_000 // (8 * columns))):
            rows = again[i : i + some]
            self.open(nth, *([x[r] for r in rows] for x in (queues, paths, splits)), streams[rows], 8 * columns)

    def rest(self, edge: int, taken: tuple[int, ...]) -> float:
        """The chance of the edges of a node that are neither this one nor taken; exactly 0 if there are none."""
        lattices = self.lattices
        node = int(np.searchsorted(lattices.edge_at, edge, side="right")) - 1
        others = [e for e in range(lattices.edge_at[node], lattices.edge_at[node + 1]) if e != edge and e not in taken]
        return float(lattices.chance[others].sum())


def decode_ids(decoded: list[bytes], ids: list[int]) -> str:
    """The text of token ids, without the space that encoding puts first."""
    return b"".join([decoded[i] for i in ids])[1:].decode("utf-8", "replace")


SCHEMA = (
    "sample int, n_ids long, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"
)


def encode(
    docs: DataFrame, k: int = SAMPLES, seed: int = 17, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Up to ``k`` distinct segmentations per row of ``docs``, best perturbed first.

    Columns: ``doc_id``, ``sample`` (0 first), ``n_ids``, ``ids``, ``log_prob``, ``perturbed`` (falling with ``sample``),
    ``log_inclusion`` (logarithm of the chance that the path is among the samples, given the bound of the best path
    left out; 0 if none is), and ``round_trip`` (whether decoding the ids gives the text).

    Defined results: null and empty texts have one row without ids and log-probability 0; a text with fewer than ``k``
    segmentations has them all; repeated rows get the same samples; a null id is a row key like any other;
    an empty table gives no rows; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_key"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        sampler = Sampler(model, k, seed)
        for part in parts:
            for some in slices(part, "_text", BLOCK_BYTES):
                texts = pc.fill_null(some.column("_text"), "").to_pylist()
                yield encoded_rows(sampler, some.column("doc_id"), texts, some.column("_key").to_numpy().view(np.uint64))

    return rows.mapInArrow(giving_back(read), f"doc_id {kind}, {SCHEMA}")


def same_bytes(vocabulary: Vocabulary, ids: np.ndarray, at: np.ndarray, texts: list[str]) -> np.ndarray:
    """Whether each run of ids decodes to its text, with the space that encoding puts first."""
    data, begins = vocabulary.pieces
    sizes = begins[ids + 1] - begins[ids]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    found = data[np.arange(upto[-1]) + np.repeat(begins[ids] - upto[:-1], sizes)]
    wanted = [(" " + t).encode() if t else b"" for t in texts]
    place, ends = upto[at], np.cumsum([0, *map(len, wanted)])
    if np.array_equal(place, ends):
        differ = np.concatenate([[0], np.cumsum(found != np.frombuffer(b"".join(wanted), np.uint8))])
        return differ[ends[1:]] == differ[ends[:-1]]
    return np.array([found[a:b].tobytes() == w for a, b, w in zip(place, place[1:], wanted)], bool)


def encoded_rows(sampler: Sampler, doc_ids: pa.Array, texts: list[str], keys: np.ndarray) -> pa.RecordBatch:
    drawn = sampler.sample(texts, keys)
    nothing = Path(np.empty(0, np.int64), 0.0, 0.0)
    found = [(i, nth, path, rest) for i, (paths, rest) in enumerate(drawn) for nth, path in enumerate(paths or [nothing])]
    flat, widths = sampler.lattices.token_ids(np.concatenate([np.empty(0, np.int64), *(f[2].edges for f in found)]))
    upto = np.concatenate([[0], np.cumsum(widths)])
    at = upto[np.concatenate([[0], np.cumsum([len(f[2].edges) for f in found])]).astype(np.int64)]
    exact = same_bytes(sampler.vocabulary, flat, at, [texts[f[0]] for f in found])
    # log(1 - exp(-exp(odds))), which is odds itself where that is far below zero
    odds = [path.log_prob - rest for _, _, path, rest in found]
    chances = [o if o < -30 else math.log(-math.expm1(-math.exp(min(o, 700.0)))) for o in odds]
    which, sample = [f[0] for f in found], [f[1] for f in found]
    logs, bounds = [f[2].log_prob for f in found], [f[2].bound for f in found]
    offsets = pa.array(at.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            doc_ids.take(pa.array(which, pa.int64())), pa.array(sample, pa.int32()), pa.array(np.diff(at), pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(logs, pa.float64()), pa.array(bounds, pa.float64()),
            pa.array(chances, pa.float64()), pa.array(exact),
        ],
        ["doc_id", "sample", "n_ids", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"],
    )


def decode(rows: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """Replace the token ids by ``text``. Null ids give a null text; unknown and control ids decode to nothing."""
    kept = [c for c in rows.columns if c != ids_col]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = vocabulary(model).decoded
        for part in parts:
            texts = [None if ids is None else decode_ids(decoded, ids) for ids in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = rows.drop(ids_col).withColumn("text", F.lit("").cast("string")).schema
    return rows.select(*kept, ids_col).mapInArrow(read, schema)
