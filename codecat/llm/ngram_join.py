"""Similarity join on word n-grams with multiple global orders.

Two sets with a Jaccard similarity of t or more share a token among the first
``n - ceil(t * n) + 1`` of each, whichever global order the tokens are put in. One order
lets many pairs through by chance. So candidates must meet under every one of
``ORDERS``, and only the intersection is verified, on the full sets.

* *Orders.* Each puts tokens of small estimated frequency first. The estimates are counts over all
  documents in a sketch of fixed size, one per order with a hash function of its own, so their errors
  differ: a frequent token that one order takes for a rare one is seldom so lucky in another.
* *Classes.* Documents with one set are one class, named by a digest. Only classes meet.
* *Meeting.* Prefix tokens that two classes share are found by one shuffle for all orders, without
  groups (:mod:`.sharing`); most tokens end there.
* *Positions.* What precedes the first token that two prefixes share is in one set only. So that token
  stands early in both, or the sets are too different; meetings at later positions are not paired.
* *Sketches.* Counts of a set's tokens by their hash bound what two sets share. Pairs that they refute are
  dropped before texts move.
* *Hot groups.* Thousands of near copies share their prefixes. So the first round verifies each
  class only with the leader of each token group, the class whose prefix tokens are shared by the most classes in the mean: in a
  family of copies that is the original, or a copy with few edits. (A count of tokens of its own would not do: a copy with many edits of
  which another was made has none, and led its family though it was similar to few of it.) The links form components. The second round verifies what is
  left: pairs that share a token, one of them outside its leader's component. A link within a component
  changes nothing, so the result is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import key_filter, marked
from ..sources.scratch import staged
from . import sharing
from .components import components
from .words import Words, giving_back, inside_text, keys, mix, slices, windows, words_of

#: Global orders under which candidates must meet.
ORDERS = 2
#: A sketch has this many bits of token hash, in chunks of 4096 counts: 2 MB of ranks per order at any input size.
SKETCH_BITS, CHUNK_BITS = 20, 12
_CHUNKS = 1 << (SKETCH_BITS - CHUNK_BITS)
#: Ranks are logarithms of counts in steps of 1/1024.
_STEPS = 1024


def buckets(token: np.ndarray, order: int) -> np.ndarray:
    """The sketch bucket of each token under an order."""
    return (mix(token + keys(ORDERS, seed=21)[order]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def token_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, token, size``: the distinct n-grams of each text, sorted by text and hash, and their number.

    A text with fewer words than ``width`` has all its words as one n-gram; a text without words has none.
    """
    hashes, counts = words.hashes(lower=True), np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = inside_text(words.first, width)
    tokens, owners = [windows(hashes, width, seed=width + 10)[whole]], [text[: len(whole)][whole]]
    for short in range(1, width):
        which = np.flatnonzero(counts == short)
        if len(which):
            tokens.append(windows(hashes, short, seed=short + 10)[words.first[which]])
            owners.append(which)
    token, text = np.concatenate(tokens), np.concatenate(owners)
    order = np.argsort(token)
    order = order[np.argsort(text[order], kind="stable")]
    token, text = token[order], text[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    token, text = token[new], text[new]
    return text, token, np.bincount(text, minlength=len(counts))


def set_classes(text: np.ndarray, token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, whatever order its tokens come in."""
    sums = np.zeros(len(size), np.uint64)
    np.add.at(sums, text, mix(token ^ np.uint64(0x5851F42D4C957F2D)))
    return mix(sums + mix(size.astype(np.uint64))).view(np.int64)


def frequency_ranks(rows: DataFrame, width: int) -> np.ndarray:
    """Per order and sketch bucket the logarithm of the number of (text, token) pairs in it, over all texts.

    Each task sends one array per chunk; they are added as a stream. What reaches the driver has a fixed size.
    """
    size = 1 << SKETCH_BITS

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ORDERS, size), np.uint32)
        for part in parts:
            for some in slices(part, "_text"):
                _, token, _ = token_sets(words_of(some.column("_text")), width)
                for order in range(ORDERS):
                    total[order] += np.bincount(buckets(token, order), minlength=size).astype(np.uint32)
        yield chunk_rows({i: narrow(chunk) for i, chunk in enumerate(total.reshape(ORDERS * _CHUNKS, -1))})

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for chunk, counts in zip(part.column(0).to_pylist(), part.column(1)):
                kind = np.dtype(f"u{len(counts.as_buffer()) >> CHUNK_BITS}")
                values = np.frombuffer(counts.as_buffer(), kind).astype(np.int64)
                total[chunk] = total[chunk] + values if chunk in total else values
        yield chunk_rows({c: (_STEPS * np.log2(v + 1.0)).astype(np.uint16) for c, v in total.items()})

    schema = "chunk int, counts binary"
    summed = rows.mapInArrow(giving_back(count), schema).repartition("chunk").mapInArrow(add, schema)
    table = np.zeros((ORDERS * _CHUNKS, 1 << CHUNK_BITS), np.uint16)
    for row in summed.collect():
        table[row["chunk"]] = np.frombuffer(row["counts"], np.uint16)
    return table.reshape(ORDERS, size)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes each as the largest needs: 1, 2 or 4."""
    return counts.astype(np.min_scalar_type(int(counts.max())))


def chunk_rows(counts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.int32()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["chunk", "counts"]
    )


def prefix_length(n, percent: int):
    """Tokens of a set of size n among which a similar set must have one."""
    return n - (percent * n + 99) // 100 + 1


#: The two low bits of a key tell the order of its token, or that the row is a document's set.
ORDER_BITS, SET = 2, 2
#: The low bits of a place hold a token's position in the prefix, from 1; the size of the set is above.
POSITION_BITS = 24
#: Prefix tokens combined at once before the shuffle, and those of one more slice; bounds a task's memory whatever the size of batches.
BLOCK_TOKENS = 200_000


def set_keys(width: int, percent: int, ranks: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All that is matched of ``_id, _text`` rows, from one pass over the texts.

    Rows of :data:`sharing.KEYED_SCHEMA`. For each order the tokens of a text's prefix: key the token, owner the
    class, place the size of the set and the position. And one row that is only handed on: owner the class, place the id,
    own_key the size.
    """

    def prefixes(some: pa.RecordBatch) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        text, token, size = token_sets(words_of(some.column("_text")), width)
        classes, ids = set_classes(text, token, size), some.column("_id").to_numpy()
        length = np.where(size > 0, prefix_length(size, percent), 0)
        first = np.concatenate([[0], np.cumsum(size)])
        keyed, owned, placed = [], [], []
        for nth in range(ORDERS):
            rank = ranks[nth][buckets(token, nth)].astype(np.uint64)
            place = (rank << np.uint64(48)) | (mix(token ^ np.uint64(nth + 1)) >> np.uint64(16))
            order = np.argsort(place)
            order = order[np.argsort(text[order], kind="stable")]
            before = np.arange(len(order)) - first[text]
            chosen = before < length[text]
            keyed.append((token[order[chosen]] << np.uint64(ORDER_BITS)) | np.uint64(nth))
            owned.append(np.repeat(classes, length))
            placed.append(np.repeat(size.astype(np.int64) << POSITION_BITS, length) | (before[chosen] + 1))
        known = np.full(len(ids), sharing.PASSED, np.int8)
        own_key = (size.astype(np.int64) << ORDER_BITS) | SET
        sets = (mix(ids.view(np.uint64)).view(np.int64), classes, ids, known, own_key)
        return sets, (np.concatenate(keyed), np.concatenate(owned), np.concatenate(placed))

    def combined(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        return sharing.combined_shared(*columns, with_key=True)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Prefix tokens not yet combined; a batch of texts can have many times BLOCK_TOKENS.
        held: list[tuple[np.ndarray, ...]] = []
        for part in parts:
            for some in slices(part, "_text"):
                sets, found = prefixes(some)
                yield from sharing.batches(*sets)
                held.append(found)
                if sum(len(f[0]) for f in held) >= BLOCK_TOKENS:
                    del sets, found
                    yield from combined(held)
        if held:
            yield from combined(held)

    return read


def of_order(found: DataFrame, order: int) -> DataFrame:
    return found.where(F.col("key").bitwiseAND((1 << ORDER_BITS) - 1) == order)


def common(found: DataFrame) -> DataFrame:
    """``class, common``: the logarithms of the number of classes that share a prefix token under the first order, summed per class."""
    rows = of_order(found, 0).select(F.col("owner").alias("class"), "key").repartition("key").distinct()
    sharers = F.count(F.lit(1)).over(Window.partitionBy("key"))
    logs = rows.select("class", F.floor(_STEPS * F.log2(sharers)).alias("common"))
    return staged(logs.groupBy("class").agg(F.sum("common").alias("common")), "common")


def meeting(found: DataFrame, order: int, percent: int, shares: DataFrame) -> DataFrame:
    """``class, n, far, tokens``: per class the prefix tokens under an order that it shares with another class.

    ``tokens`` holds ``key, pos`` and is bounded by the prefix; ``far`` is the less, the more classes share a token of the prefix
    in the mean, and the same under all orders. Classes without such tokens under the first order are left out: they are in no candidate.
    """
    token = F.struct("key", F.col("place").bitwiseAND((1 << POSITION_BITS) - 1).alias("pos"))
    size = F.max(F.shiftright("place", POSITION_BITS)).alias("n")
    tokens = of_order(found, order).groupBy(F.col("owner").alias("class")).agg(size, F.collect_set(token).alias("tokens"))
    length = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    far = F.floor(-F.col("common") / length).alias("far")
    return staged(tokens.join(shares, "class").select("class", "n", far, "tokens"), "meeting")


def can_be_similar(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be similar if the token at which they meet is the first that they share.

    All before it is in one of them only, so at most the tokens from there on are in both.
    """
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos")) + 1
    return (100 + percent) * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def leader_pairs(met: DataFrame, percent: int) -> DataFrame:
    """``a, b`` with a < b: each class with the leader of each of its token groups, the least far one."""
    # One shuffle by token gives each row the leader of its group.
    rows = met.select("class", "n", "far", F.inline("tokens"))
    led = F.min(F.struct("far", "class", "n", "pos")).over(Window.partitionBy("key"))
    pairs = rows.select(F.struct("class", "n", "pos").alias("x"), led.alias("y")).where(
        (F.col("x.class") != F.col("y.class")) & can_be_similar("x", "y", percent)
    )
    return pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def open_pairs(met: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """``a, b`` with a < b: classes that share a token and lie in different components.

    One side are only classes outside the component of their group's leader, so a hot group of one
    component, and most of a group with few strays, is never paired.
    """
    named = met.join(found.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "n", "far", F.coalesce("component", "class").alias("c"), F.inline("tokens")
    )
    group = Window.partitionBy("key")
    led = F.min(F.struct("far", "class", "c")).over(group)
    marked = named.select("*", led["c"].alias("led_by"), F.min("c").over(group).alias("low"), F.max("c").over(group).alias("high"))
    left = staged(marked.where("low <> high").select("class", "n", "key", "pos", "c", "led_by"), "open")
    pairs = left.where("c <> led_by").alias("x").join(
        left.alias("y"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & can_be_similar("x", "y", percent),
    )
    return pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def split_classes(loose: DataFrame, found: DataFrame) -> DataFrame:
    """``class``: members of components of tried pairs that the verified links leave in pieces."""
    centres = loose.select(F.col("component").alias("node"), "component").distinct()
    members = loose.unionByName(centres).select(F.col("node").alias("class"), F.col("component").alias("whole"))
    named = members.join(found.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "whole", F.coalesce("component", "class").alias("c")
    )
    pieces = named.groupBy("whole").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return staged(named.join(pieces, "whole", "left_semi").select("class"), "split")


#: Bits of the filter that spares texts the shuffle, and of one chunk of it: 2 MB at any input size. Fuller filters let more texts through.
FILTER_BITS, FILTER_CHUNK = 24, 15


def id_filter(ids: DataFrame) -> np.ndarray:
    """A table of bits, one set per id of ``ids(_id)`` by its hash; ids not in ``ids`` may hit a set bit, too."""
    n = 1 << (FILTER_BITS - FILTER_CHUNK)

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for part in parts:
            bits[id_bits(part.column(0))] = True
        chunks = np.packbits(bits).reshape(n, -1)
        yield chunk_rows({i: chunks[i] for i in np.flatnonzero(chunks.any(axis=1)).tolist()})

    def unite(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for chunk, packed in zip(part.column(0).to_pylist(), part.column(1)):
                values = np.frombuffer(packed.as_buffer(), np.uint8)
                total[chunk] = total[chunk] | values if chunk in total else values
        yield chunk_rows(total)

    schema = "chunk int, counts binary"
    table = np.zeros((n, 1 << (FILTER_CHUNK - 3)), np.uint8)
    for row in ids.mapInArrow(giving_back(mark), schema).repartition("chunk").mapInArrow(unite, schema).collect():
        table[row["chunk"]] = np.frombuffer(row["counts"], np.uint8)
    return np.unpackbits(table.reshape(-1)).astype(bool)


def id_bits(ids: pa.Array) -> np.ndarray:
    return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, _text`` for ``wanted(class, _id)``. Most other texts are left out before the join, by a filter on ids."""
    packed = np.packbits(id_filter(wanted.select("_id")))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for part in parts:
            chosen = part.filter(pa.array(bits[id_bits(part.column(0))]))
            if chosen.num_rows:
                yield chosen

    known = rows.where("_id is not null").mapInArrow(giving_back(read), "_id long, _text string")
    return staged(known.join(wanted, "_id").select("class", "_text"), "texts")


#: Buckets of a sketch, which counts the tokens of a set by their hash.
SKETCH_BUCKETS = 256


def sketches_of(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``class, counts`` for ``wanted(class, _id)``: how many tokens of the set lie in each bucket, in 16 bits. Texts do not move."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in slices(part, "_text"):
                text, token, size = token_sets(words_of(some.column("_text")), width)
                place = text * SKETCH_BUCKETS + (mix(token) % np.uint64(SKETCH_BUCKETS)).astype(np.int64)
                counts = np.bincount(place, minlength=len(size) * SKETCH_BUCKETS).reshape(-1, SKETCH_BUCKETS)
                # A bucket that is full says nothing.
                counts = np.minimum(counts, FULL).astype(np.uint16)
                values = pa.array([c.tobytes() for c in counts], pa.binary())
                classes = pa.array(set_classes(text, token, size))
                yield pa.RecordBatch.from_arrays([classes, values], ["class", "counts"])

    chosen = marked(rows.where("_id is not null"), "_id", key_filter(wanted, "_id")).where("_likely").select("_id", "_text")
    found = chosen.mapInArrow(giving_back(read), "class long, counts binary").join(wanted.select("class"), "class", "left_semi")
    return staged(found.groupBy("class").agg(F.first("counts").alias("counts")), "sketches")


#: The count of a full bucket.
FULL = (1 << 16) - 1


def not_refuted(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` that can be similar by their sketches: no bucket shares more tokens than the lesser of its counts.

    This is exact: it drops no similar pair. A class without a sketch refutes nothing.
    """

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                some = part.slice(at, 4096)
                known = some.filter(pc.and_(some.column("_one").is_valid(), some.column("_two").is_valid()))
                one, two = (
                    np.frombuffer(b"".join(known.column(c).to_pylist()), np.uint16).reshape(-1, SKETCH_BUCKETS).astype(np.int64)
                    for c in ("_one", "_two")
                )
                most, full = np.minimum(one, two).sum(axis=1), ((one == FULL) | (two == FULL)).any(axis=1)
                good = full | (100 * most >= percent * (one.sum(axis=1) + two.sum(axis=1) - most))
                out = known.filter(pa.array(good))
                open_ = some.filter(pc.or_(some.column("_one").is_null(), some.column("_two").is_null()))
                for batch in (out, open_):
                    if batch.num_rows:
                        yield batch.select(["a", "b"])

    one = sketches.select(F.col("class").alias("a"), F.col("counts").alias("_one"))
    two = sketches.select(F.col("class").alias("b"), F.col("counts").alias("_two"))
    rows = pairs.join(one, "a", "left").join(two, "b", "left").select("a", "b", "_one", "_two")
    return staged(rows.mapInArrow(giving_back(check), "a long, b long"), "pairs")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The stored ``pairs(a, b)`` whose full sets are similar, as edges ``u, v``. ``texts`` are ``class, _text``.

    Only texts of classes in pairs move. Their classes are stored, so that few of them pick their texts where these lie.
    """

    def side(name: str, text: str) -> DataFrame:
        named = staged(pairs.select(name).distinct(), "classes")
        return texts.select(F.col("class").alias(name), F.col("_text").alias(text)).join(named, name, "left_semi")

    one, two = side("a", "_one"), side("b", "_text")

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in slices(part, "_text"):
                sets = [token_sets(words_of(some.column(c)), width) for c in ("_one", "_text")]
                a, b = some.column("a").to_numpy(), some.column("b").to_numpy()
                pair = np.concatenate([s[0] for s in sets])
                token = np.concatenate([s[1] for s in sets])
                order = np.lexsort((token, pair))
                pair, token = pair[order], token[order]
                twice = (pair[1:] == pair[:-1]) & (token[1:] == token[:-1])
                shared = np.bincount(pair[1:][twice], minlength=len(a))
                joined = sets[0][2] + sets[1][2] - shared
                own = (set_classes(*sets[0]) == a) & (set_classes(*sets[1]) == b)
                good = own & (100 * shared >= percent * joined)
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["u", "v"])

    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "_one", "_text")
    return rows.mapInArrow(giving_back(check), "u long, v long")


def near_duplicates(
    docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Words are split at white space and A to Z lower-cased. Documents whose sets of ``width``-word
    n-grams have a Jaccard similarity of ``percent`` per cent or more are linked; ``component_id`` is the
    smallest id reachable by links, the document's own included.

    Defined results: null and empty texts have no set and link with nothing; a null id has no component
    and links with nothing; repeated rows are copies; rows that share an id but not a text are one
    document with several sets, each row reporting the component of its own set; an empty table gives no
    rows; other columns are not looked at. ``percent`` must be over 50.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ranks = frequency_ranks(rows, width)
    keys_of = set_keys(width, percent, ranks)
    shared = staged(sharing.shared_packed(rows.where("_id is not null"), keys_of), "shared")
    known = shared.where(F.col("key").bitwiseAND((1 << ORDER_BITS) - 1) == SET).select(
        F.col("place").alias("doc_id"), F.col("owner").alias("class"), F.shiftright("key", ORDER_BITS).alias("n")
    )
    shares = common(shared)
    met = [meeting(shared, order, percent, shares) for order in range(ORDERS)]

    def candidates(pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
        found = pairs(met[0])
        for other in met[1:]:
            found = found.join(pairs(other), ["a", "b"], "left_semi")
        return found

    ids = known.groupBy("class").agg(F.min("doc_id").alias("_id"))

    def of_pairs(pairs: DataFrame) -> DataFrame:
        return ids.join(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class", "left_semi")

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs left by sketches, which are much smaller than texts."""
        return not_refuted(pairs, sketches_of(rows, staged(of_pairs(pairs), "wanted"), width), percent)

    led = staged(candidates(lambda m: leader_pairs(m, percent)), "led")
    tried = possible(led)
    # Verified links join no more than all tried pairs would, and refuted ones are no links. So a pair of the second round either lies between
    # components of tried pairs, and is found already here, or within one that verified links leave in pieces.
    loose = components(tried.select(F.col("a").alias("u"), F.col("b").alias("v")))
    apart = candidates(lambda m: open_pairs(m, loose, percent)).join(led, ["a", "b"], "left_anti")
    apart = possible(staged(apart, "apart"))
    texts = texts_of(rows, staged(of_pairs(tried.unionByName(apart)), "first"))

    edges = staged(verified(tried, texts, width, percent), "links")
    found = components(edges)
    split = split_classes(loose, found)
    within = candidates(lambda m: open_pairs(m.join(split, "class", "left_semi"), found, percent))
    rest = staged(apart.unionByName(within).distinct().join(led, ["a", "b"], "left_anti"), "rest")
    more = staged(verified(rest, texts, width, percent), "links")
    found = components(found.toDF("u", "v").unionByName(more))

    named = known.join(found.withColumnRenamed("node", "class"), "class", "left").select(
        "doc_id", "n", F.coalesce("component", "class").alias("c")
    )
    least = named.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = staged(least.where("least <> most"), "least")
    result = named.join(least, "c", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return result.unionByName(rows.where("_id is null").mapInArrow(sizes_only(width), RESULT))


#: The columns of :func:`near_duplicates`.
RESULT = "doc_id long, n_shingles long, component_id long"


def sizes_only(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Results of rows without an id."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in slices(part, "_text"):
                size = token_sets(words_of(some.column("_text")), width)[2]
                none = pa.nulls(len(size), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(size.astype(np.int64)), none], ["doc_id", "n_shingles", "component_id"])

    return read


def drop_near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose id is that of their group (:func:`near_duplicates`), with all their columns.

    Rows with a null id, and rows that repeat the id of their group, stay. Only the ids of dropped rows
    travel, stored once so that Spark knows their size.
    """
    found = near_duplicates(docs, width, percent, id_col, text_col)
    dropped = staged(found.where("component_id < doc_id").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    rows = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"))
    return rows.join(dropped, F.col("_id") == F.col("_dropped"), "left_anti").select("_doc.*")
