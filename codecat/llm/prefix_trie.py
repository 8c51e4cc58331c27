"""The trie of conversation prefixes, from sorted sequences and range minima over their common prefixes.

Conversations are sequences of turn digests (16 bytes each), sorted. The members of a prefix lie side by side, and
the prefix holds from one member to the next as far as their common prefix is no shorter. A sparse table over these common lengths answers
range minima, so each candidate prefix searches its left and its right extent by itself, in powers of two, without a stack.
A node is a prefix whose left extent ends at its own sequence. Sums over a node's subtree are differences of running sums over its interval.

The sorted sequences are cut into blocks of bounded size, whatever they hold, and blocks are worked on apart. Only prefixes that
a block shares with its neighbours go on: they are the common prefix of the last sequence of a block and the first of the next, so there
are no more of them than turns in one sequence per block. Their parts are merged by key; sums over the blocks that lie wholly inside
such a node are differences of running sums over blocks. Large groups of copies are spread over blocks like anything else.

Texts never move: turns are digested where they are read, and 20 bytes a turn are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import fits_broadcast, sized_join
from ..sources.scratch import staged
from .words import WORD

#: Bytes of a turn's digest.
DIGEST = 16
#: Turns of a block, unless one sequence is longer.
BLOCK_TURNS = 50_000
#: Conversation ids hashed in one piece.
IDS_AT_ONCE = 400


# -- sequences -------------------------------------------------------------


def sequences(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, turns, words`` per conversation: the digests of its turns in order, and the words of their texts.

    Turns are ordered by their number, null first, and where that is equal by their digests. Null roles and texts are empty. Rows
    without a conversation id belong to no conversation. A conversation's digests are gathered, 20 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"), digest.alias("digest"), F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"))).alias("words")
        ).alias("_turn"),
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return ordered.select(
        "conv_id", F.unhex(F.array_join("_turns.digest", "")).alias("turns"), F.col("_turns.words").alias("words")
    )


def first_turns(count: Column) -> tuple[Column, Column]:
    """The first turns of a sequence."""
    return F.substring(F.col("turns"), F.lit(1), (DIGEST * count).cast("int")), F.slice("words", F.lit(1), count)


def with_heads(sequences: DataFrame, base: Column, count: Column) -> DataFrame:
    """Give each sequence the first ``count`` turns of the one named by ``base``, in place of its own first ``count``.

    Where there is no such sequence, or it is shorter, there are so many fewer turns. ``count`` is at most a few.
    """
    rows = sequences.select("*", base.cast("long").alias("_base"), count.cast("int").alias("_count"))
    bases = rows.select("_base", "_count").distinct()
    turns, words = first_turns(F.col("_count"))
    heads = bases.join(sequences, F.col("_base") == F.col("conv_id")).select("_base", "_count", turns.alias("_turns"), words.alias("_words"))
    own = F.expr(f"substring(turns, {DIGEST} * _count + 1, greatest(octet_length(turns) - {DIGEST} * _count, 0))")
    rest = F.expr("slice(words, _count + 1, greatest(size(words) - _count, 0))")
    return rows.join(heads, ["_base", "_count"], "left").select(
        "conv_id",
        F.concat(F.coalesce("_turns", F.lit(b"")), own).alias("turns"),
        F.concat(F.coalesce("_words", F.expr("cast(array() as array<int>)")), rest).alias("words"),
    )


# -- blocks ----------------------------------------------------------------

BLOCK = (
    "part int, number int, before binary, after binary, first binary, last binary, "
    "ids binary, sizes binary, turns binary, words binary"
)


def blocks(parts: Iterator[pa.RecordBatch], block_turns: int) -> Iterator[pa.RecordBatch]:
    """Pack sorted sequences into rows of about ``block_turns`` turns, each with the sequences next to it in its partition."""
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    number, size = 0, 0
    waiting: dict | None = None

    def packed() -> Iterator[pa.RecordBatch]:
        """The block before this one goes out when the first sequence of this one is known."""
        nonlocal waiting, held, number, size
        table = pa.Table.from_batches(held)
        turns = table.column("turns").cast(pa.large_binary()).combine_chunks()
        first = turns[0].as_py()
        if waiting is not None:
            yield pa.RecordBatch.from_pylist([waiting | {"after": first}], _BLOCK)
        waiting = {
            "part": part, "number": number, "before": waiting and waiting["last"], "first": first, "last": turns[-1].as_py(),
            "ids": table.column("conv_id").to_numpy().astype("<i8").tobytes(),
            "sizes": np.diff(offsets(turns)).astype("<i8").tobytes(),
            "turns": data_of(turns).tobytes(),
            "words": table.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes(),
        }
        held, number, size = [], number + 1, 0

    for batch in parts:
        sizes = 1 + pc.binary_length(batch.column("turns")).to_numpy(zero_copy_only=False) // DIGEST
        group = (size + np.cumsum(sizes)) // block_turns
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield from packed()
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(sizes[a:b].sum())
    if held:
        yield from packed()
    if waiting is not None:
        yield pa.RecordBatch.from_pylist([waiting | {"after": None}], _BLOCK)


def offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


def data_of(column: pa.Array) -> np.ndarray:
    at = offsets(column)
    buffer = column.buffers()[2]
    return np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer else np.empty(0, np.uint8)


_BLOCK = pa.schema(
    [("part", pa.int32()), ("number", pa.int32())]
    + [(name, pa.binary()) for name in ("before", "after", "first", "last", "ids", "sizes", "turns", "words")]
)


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """The common turns of two sequences; -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) // DIGEST if len(differ) else n // DIGEST


class RangeMinimum:
    """A sparse table; ``reach`` searches by it."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minima of ``values[low:high + 1]``."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            out[some] = np.minimum(self.levels[k][low[some]], self.levels[k][high[some] + 1 - (1 << k)])
        return out

    def reach(self, start: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
        """How many values in a row from ``start`` on (``step`` 1: up, -1: down, from the one before) are at least ``bound``."""
        far, n = np.zeros(len(start), np.int64), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            low = start + far if step > 0 else start - far - (1 << k)
            inside = (low >= 0) & (low + (1 << k) <= n)
            hit = np.flatnonzero(inside)
            hit = hit[self.levels[k][low[hit]] >= bound[hit]]
            far[hit] += 1 << k
        return far


@dataclass
class Nodes:
    """The nodes of a block by the flat number of their candidate, ``base[row] + depth``, where ``row`` is their first sequence."""

    row: np.ndarray
    depth: np.ndarray
    right: np.ndarray
    parent: np.ndarray
    words: np.ndarray


def nodes_of(turns: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[Nodes, RangeMinimum]:
    """All distinct prefixes of sorted sequences: every prefix of every sequence searches its extents, and those whose left one is their own stay."""
    n = len(sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    least = np.minimum(sizes[1:], sizes[:-1])
    lines = np.repeat(np.arange(n - 1), least)
    place = np.arange(int(least.sum())) - np.repeat(np.cumsum(least) - least, least)
    halves = turns.reshape(-1, DIGEST).copy().view("<u8")
    other = (halves[first[lines + 1] + place] != halves[first[lines] + place]).any(axis=1)
    common = least.copy()
    np.minimum.at(common, lines[other], place[other])
    ranges = RangeMinimum(common)
    row = np.repeat(np.arange(n), sizes + 1)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    depth = np.arange(len(row)) - base[row]
    if n > 1:
        left = row - ranges.reach(row, depth, -1)
        right = row + ranges.reach(row, depth, 1)
    else:
        left = right = row
    own = np.flatnonzero(left == row)
    number = np.full(len(row), -1, np.int64)
    number[own] = np.arange(len(own))
    above = np.maximum(own - 1, 0)  # the same sequence's prefix that is a turn shorter
    parent = np.where(depth[own] > 0, number[base[left[above]] + depth[above]], -1)
    last = np.where(depth[own] > 0, words[np.maximum(first[row[own]] + depth[own] - 1, 0)] if len(words) else 0, 0)
    return Nodes(row[own], depth[own], right[own], parent, last), ranges


def joined_ids(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


NOTHING = hashlib.sha256(b"").hexdigest()
COUNTS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
FOUND = f"kind int, {COUNTS}, ends_sha256 string, parent_key binary, key binary, words long, block long, piece int, ids binary"
WHOLE, SHARED, ENDS = 0, 1, 2
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]

_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_FOUND = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in FOUND.split(", ")])


def block_nodes(block: dict) -> Iterator[pa.RecordBatch]:
    """The nodes that lie in one block (``WHOLE``), the parts of those shared with its neighbours (``SHARED``), and the ids that end at the latter (``ENDS``)."""
    ids, sizes = (np.frombuffer(block[c], "<i8") for c in ("ids", "sizes"))
    sizes = sizes // DIGEST
    words, turns = np.frombuffer(block["words"], "<i4").astype(np.int64), np.frombuffer(block["turns"], np.uint8)
    nodes, _ = nodes_of(turns, sizes, words)
    n, row, right, depth, parent = len(sizes), nodes.row, nodes.right, nodes.depth, nodes.parent
    # What reaches the first sequence and holds in the block before, or the last one and holds after, is shared.
    before, after = common_turns(block["before"], block["first"]), common_turns(block["last"], block["after"])
    shared = ((row == 0) & (depth <= before)) | ((right == n - 1) & (depth <= after))
    members = right - row + 1
    least = RangeMinimum(ids).least(row, right)
    children = np.bincount(parent[1:][~shared[1:]], minlength=len(row))  # the root is first; shared children are counted where they are merged
    all_children = np.bincount(parent[1:], minlength=len(row))
    own = np.where(shared, 0, (members - 1) * nodes.words)
    leaf = ((all_children == 0) & ~shared).astype(np.int64)
    # Nodes lie by sequence and depth: those of a subtree are the node itself, the deeper ones of its sequence, and all of the others.
    end = np.searchsorted(row, right, side="right")
    upto_own, upto_leaf = (np.concatenate([[0], np.cumsum(x)]) for x in (own, leaf))
    at = np.arange(len(row))
    saved, leaves = upto_own[end] - upto_own[at], upto_leaf[end] - upto_leaf[at]
    # Sequences that end at a node are the first of its members.
    same = np.ones(n, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], ~repeats(turns, sizes)]))
    same[edge] = np.diff(np.append(edge, n))
    ends = np.where(sizes[row] == depth, same[row], 0)
    chains = prefix_keys(block["first"], before), prefix_keys(block["last"], after)
    keys = {i: chains[0 if row[i] == 0 and depth[i] <= before else 1][depth[i]] for i in np.flatnonzero(shared).tolist()}
    whole = np.flatnonzero(~shared)
    hashes = [hashlib.sha256(joined_ids(ids[r : r + e])).hexdigest() if e else NOTHING for r, e in zip(row[whole].tolist(), ends[whole].tolist())]
    above = parent[whole]
    below_shared = (above >= 0) & shared[above]
    columns = {
        "kind": np.full(len(whole), WHOLE), "conv_id": least[whole], "depth": depth[whole], "n_convs": members[whole],
        "n_children": all_children[whole], "n_leaves": leaves[whole], "saved_tokens": saved[whole], "ends_sha256": hashes,
        "parent_conv_id": pa.array(least[above], pa.int64(), mask=below_shared | (above < 0)),
        "parent_key": [keys[p] if s else None for p, s in zip(above.tolist(), below_shared.tolist())],
    }
    yield from found_rows(columns, len(whole))
    some = np.array(list(keys), np.int64)
    columns = {
        "kind": np.full(len(some), SHARED), "conv_id": least[some], "depth": depth[some], "n_convs": members[some],
        "n_children": children[some], "n_leaves": leaves[some], "saved_tokens": saved[some], "words": nodes.words[some],
        "key": list(keys.values()), "parent_key": [keys.get(p) for p in parent[some].tolist()], "block": np.full(len(some), block["block"]),
    }
    yield from found_rows(columns, len(some))
    pieces = [
        (keys[i], k, joined_ids(ids[row[i] + a : row[i] + min(a + IDS_AT_ONCE, ends[i])]))
        for i in some.tolist()
        for k, a in enumerate(range(0, int(ends[i]), IDS_AT_ONCE))
    ]
    key, piece, text = zip(*pieces) if pieces else ((), (), ())
    columns = {"kind": np.full(len(pieces), ENDS), "key": key, "piece": piece, "ids": text, "block": np.full(len(pieces), block["block"])}
    yield from found_rows(columns, len(pieces))


def repeats(turns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each sequence but the first equals the one before."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    out = sizes[1:] == sizes[:-1]
    halves = turns.reshape(-1, DIGEST).copy().view("<u8")
    lines = np.flatnonzero(out)
    counts = sizes[1:][lines]
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    line = np.repeat(lines, counts)
    other = (halves[first[line + 1] + place] != halves[first[line] + place]).any(axis=1)
    out[line[other]] = False
    return out


def prefix_keys(turns: bytes, most: int) -> list[bytes]:
    """Keys of the prefixes of a sequence with up to ``most`` turns."""
    state, keys = hashlib.md5(), []
    for d in range(most + 1):
        keys.append(state.digest())
        state.update(turns[DIGEST * d : DIGEST * (d + 1)])
    return keys


def found_rows(columns: dict, n: int) -> Iterator[pa.RecordBatch]:
    def array(field: pa.Field) -> pa.Array:
        values = columns.get(field.name)
        return pa.nulls(n, field.type) if values is None else values if isinstance(values, pa.Array) else pa.array(values, field.type)

    batch = pa.RecordBatch.from_arrays([array(field) for field in _FOUND], schema=_FOUND)
    for a in range(0, n, 20_000):
        yield batch.slice(a, 20_000)


# -- the trie --------------------------------------------------------------


def ends_of(pieces: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the ids in ``pieces(key, block, piece, ids)``, read as a sorted stream."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for part in parts:
            for k, ids in zip(part.column("key").to_pylist(), part.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
        if key is not None:
            done.append((key, state.hexdigest()))
        keys, digests = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])

    dealt = pieces.repartition("key").sortWithinPartitions("key", "block", "piece")
    return dealt.select("key", "ids").mapInArrow(read, "key binary, ends_sha256 string")


def numbered(packed: DataFrame) -> DataFrame:
    """Number the blocks in order, and give those at the edges of partitions their neighbours, by one row per partition."""
    first = packed.where("number = 0").select("part", "first")
    last = packed.where("after is null").select("part", "last", (F.col("number") + 1).cast("long").alias("_blocks"))
    order = Window.orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = first.join(last, "part").select(
        "part",
        F.lag("last").over(order).alias("_before"),
        F.lead("first").over(order).alias("_after"),
        F.coalesce(F.sum("_blocks").over(before), F.lit(0)).alias("_blocks"),
    )
    return packed.join(staged(parts, "parts"), "part").select(
        (F.col("_blocks") + F.col("number")).alias("block"),
        F.when(F.col("number") == 0, F.col("_before")).otherwise(F.col("before")).alias("before"),
        F.coalesce("after", "_after").alias("after"),
        *("first", "last", "ids", "sizes", "turns", "words"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """The nodes that several blocks share, whole; ``parts`` has a row per node and block.

    A shared node that starts in a block has all of the block's sequences from there on. So of the shared nodes that
    start in the same block the deeper ones lie below it, as do all that start in later blocks before its last one.
    The sums over those are differences of running sums, with one row per block.
    """
    whole = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
        F.first("words").alias("words"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("_children"),
        F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"), F.min("block").alias("_first"), F.max("block").alias("_last"),
    )
    whole = staged(whole, "shared")
    below = whole.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_below"))
    whole = whole.join(below, "key", "left").withColumn("n_children", F.col("_children") + F.coalesce("_below", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).alias("_leaf")
    whole = staged(whole.select("*", leaf, ((F.col("n_convs") - 1) * F.col("words")).alias("_own")), "shared")
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = whole.groupBy(F.col("_first").alias("block")).agg(F.sum("_leaf").alias("_leaf"), F.sum("_own").alias("_own"))
    sums = parts.select("block").distinct().join(starts, "block", "left").select(
        "block", *(F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in ("_leaf", "_own"))
    )
    sums = staged(sums, "sums")
    low = sums.select(F.col("block").alias("_first"), F.col("_leaf").alias("_leaf_low"), F.col("_own").alias("_own_low"))
    high = sums.select((F.col("block") + 1).alias("_last"), F.col("_leaf").alias("_leaf_high"), F.col("_own").alias("_own_high"))
    chain = Window.partitionBy("_first").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return whole.join(low, "_first").join(high, "_last").select(
        "key", "conv_id", "depth", "parent_key", "n_convs", "n_children",
        (F.col("_leaves") + F.sum("_leaf").over(chain) + F.col("_leaf_high") - F.col("_leaf_low")).alias("n_leaves"),
        (F.col("_saved") + F.sum("_own").over(chain) + F.col("_own_high") - F.col("_own_low")).alias("saved_tokens"),
    )


def trie(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The nodes of the trie of ``rows(conv_id, turns, words)``, as :func:`sequences` makes them.

    Columns: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of
    the subtree), ``saved_tokens`` (the words that members after the first need not be given again, over the subtree), and
    ``ends_sha256`` of the ids, ascending and joined by commas, of the members that end there.

    Defined results: a sequence without turns is a member of the root alone; repeated ids are members of their own;
    an empty table gives no rows. What a digest of ids takes is one stream per node; of a node in several blocks it gets a row for each 400 ids.
    """
    rows = staged(rows.select("conv_id", "turns", F.col("words").cast("array<int>").alias("words")), "sequences")
    dealt = rows.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    packed = staged(dealt.mapInArrow(lambda parts: blocks(parts, block_turns), BLOCK), "blocks")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                yield from block_nodes(part.slice(i, 1).to_pylist()[0])

    found = staged(numbered(packed).mapInArrow(read, FOUND), "nodes")
    digests = ends_of(found.where(F.col("kind") == ENDS).select("key", "block", "piece", "ids"))
    shared = staged(merged(found.where(F.col("kind") == SHARED)).join(digests, "key", "left"), "shared")
    names = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    small = fits_broadcast(names)
    whole = found.where(F.col("kind") == WHOLE)
    own = whole.where("parent_key is null").select(NODE)
    below = sized_join(whole.where("parent_key is not null").drop("key"), names, "parent_key", "conv_id", small=small)
    between = sized_join(
        shared.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), names, "parent_key", "conv_id", how="left", small=small
    )
    return own.unionByName(below.withColumn("parent_conv_id", F.col("_parent")).select(NODE)).unionByName(
        between.withColumn("parent_conv_id", F.col("_parent")).select(NODE)
    )


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The prefix trie of a table of turns; see :func:`sequences` and :func:`trie`. Other columns are not looked at."""
    return trie(sequences(conversations, id_col, turn_col, role_col, text_col))
