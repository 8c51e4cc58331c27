"""Keys that occur under more than one owner, found without gathering a group.

Occurrences are ``key, owner, place, known``. They are dealt by key, sorted by key
and owner, and read as a stream, so a group is never held. Before the shuffle each
batch is combined: what it can decide by itself leaves the group (``known`` is
PASSED and the key is random), so that a hot key sends about one row per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import giving_back, mix

#: Values of ``known``: undecided; its key is shared; decided, only to be handed on.
OPEN, SHARED, PASSED = 0, 1, 2
SCHEMA = "key long, owner long, place long, known byte"
#: With the key of PASSED rows, for those who ask for keys.
KEYED_SCHEMA = f"{SCHEMA}, own_key long"
PLACES = "owner long, place long"
_AT_ONCE = 200_000


def batches(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA or KEYED_SCHEMA."""
    names = ["key", "owner", "place", "known", "own_key"][: len(columns)]
    for a in range(0, len(columns[0]), _AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + _AT_ONCE]) for c in columns], names)


def _moved(key: np.ndarray, owner: np.ndarray, place: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """The keys, those of PASSED rows replaced by random ones."""
    other = mix(key + mix(place.astype(np.uint64)) + mix(owner.view(np.uint64)))
    return np.where(passed, other, key).view(np.int64)


def _runs(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal keys, and the run of each row."""
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _as_given(order: np.ndarray, columns: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Rows back in the order they had before sorting: neighbours of one owner compress well in the shuffle."""
    there = np.zeros(size, bool)
    there[order] = True
    out = []
    for column in columns:
        full = np.empty(size, column.dtype)
        full[order] = column
        out.append(full[there])
    return out


def combined_shared(
    key: np.ndarray, owner: np.ndarray, place: np.ndarray, with_key: bool = False
) -> Iterator[pa.RecordBatch]:
    """Combine a batch for :func:`shared`: of a key with two owners one row stays in the group.

    Rows that are equal in all three columns become one.
    """
    if not len(key):
        return
    size, order = len(key), np.lexsort((place, owner, key))
    key, owner, place = key[order], owner[order], place[order]
    new = np.ones(size, bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    order, key, owner, place = order[new], key[new], owner[new], place[new]
    starts, run = _runs(key, owner)
    ends = np.append(starts[1:], len(key)) - 1
    known = np.where((owner[starts] != owner[ends])[run], PASSED, OPEN)
    first = starts[known[starts] == PASSED]
    known[first] = SHARED
    passed = known == PASSED
    columns = [_moved(key, owner, place, passed), owner, place, known.astype(np.int8)]
    columns += [np.where(passed, key, 0).view(np.int64)] if with_key else []
    yield from batches(*_as_given(order, columns, size))


def combined_later(key: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Combine a batch for :func:`later`: only rows of the smallest owner stay in the group."""
    if not len(key):
        return
    order = np.lexsort((owner, key))
    key, owner, place = key[order], owner[order], place[order]
    starts, run = _runs(key, owner)
    passed = owner > owner[starts][run]
    columns = [_moved(key, owner, place, passed), owner, place, np.where(passed, PASSED, OPEN).astype(np.int8)]
    yield from batches(*_as_given(order, columns, len(order)))


def _dealt(occurrences: DataFrame) -> DataFrame:
    return occurrences.repartition("key").sortWithinPartitions("key", "owner")


PACKED = "target int, data binary"


def pack(batches_: Iterator[pa.RecordBatch], targets: int) -> Iterator[pa.RecordBatch]:
    """Rows of KEYED_SCHEMA as one binary value per batch and task of the next stage, which takes half as much in the shuffle.

    Owners are numbered, and the bytes of all other numbers come by their place in the number, so that those
    which hardly change lie side by side.
    """
    for batch in batches_:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        target = ((mix(columns[0].view(np.uint64)) >> np.uint64(33)) % np.uint64(targets)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        cuts = np.searchsorted(target[order], np.arange(targets + 1)).tolist()
        filled = [t for t in range(targets) if cuts[t] < cuts[t + 1]]
        values = [_packed([c[order[cuts[t] : cuts[t + 1]]] for c in columns]) for t in filled]
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(values, pa.binary())], ["target", "data"])


def _packed(columns: list[np.ndarray]) -> bytes:
    key, owner, place, known, own_key = columns
    owners, number = np.unique(owner, return_inverse=True)
    parts = [np.array([len(key), len(owners)], np.int64), owners]
    return b"".join([*(p.tobytes() for p in parts), *map(_planes, (key, number.astype(np.int32), place, known, own_key))])


def _planes(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), -1).T.tobytes()


def unpack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of KEYED_SCHEMA out of the values that :func:`pack` makes."""
    kinds = (np.dtype(np.int64), np.dtype(np.int32), np.dtype(np.int64), np.dtype(np.int8), np.dtype(np.int64))
    for part in parts:
        for value in part.column(0):
            data = value.as_buffer()
            n, m = np.frombuffer(data, np.int64, 2).tolist()
            owners, at, columns = np.frombuffer(data, np.int64, m, 16), 16 + 8 * m, []
            for kind in kinds:
                planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
                columns.append(np.ascontiguousarray(planes.T).view(kind)[:, 0])
                at += n * kind.itemsize
            columns[1] = owners[columns[1]]
            yield from batches(*columns)


def shared_packed(rows: DataFrame, occurrences: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``key, owner, place`` of :func:`shared` with keys; ``occurrences`` makes rows of KEYED_SCHEMA from ``rows``, which are shuffled packed.

    A task of the next stage unpacks and sorts its part, on disk where it is large.
    """
    targets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The next stage runs two Python workers per task.
    packed = rows.mapInArrow(giving_back(lambda parts: pack(occurrences(parts), targets)), PACKED)
    dealt = packed.repartitionById(targets, F.col("target")).select("data").mapInArrow(giving_back(unpack), KEYED_SCHEMA)
    return shared(dealt, with_key=True, dealt=dealt.sortWithinPartitions("key", "owner"))


def shared(occurrences: DataFrame, with_key: bool = False, dealt: DataFrame | None = None) -> DataFrame:
    """``owner, place`` of the occurrences whose key has two owners or more.

    ``with_key`` adds ``key``; the occurrences are then rows of KEYED_SCHEMA. ``dealt`` are the same rows,
    where they lie by key already, sorted.
    """
    schema = f"key long, {PLACES}" if with_key else PLACES

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the open run, as long as they have one owner; they belong to one text.
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        open_key = open_owner = None
        decided = False
        for part in parts:
            key, owner, place, known = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            done = known == PASSED
            own_key = part.column(4).to_numpy(zero_copy_only=False) if with_key else key
            out = [(own_key[done], owner[done], place[done])]
            key, owner, place, known = key[~done], owner[~done], place[~done], known[~done]
            if len(key):
                starts, run = _runs(key, owner)
                ends = np.append(starts[1:], len(key)) - 1
                both = owner[starts] != owner[ends]
                np.logical_or.at(both, run, known == SHARED)
                if key[0] == open_key:
                    both[0] |= decided or owner[ends[0]] != open_owner or owner[0] != open_owner
                    if both[0]:
                        out += held
                        held = []
                else:
                    held = []
                mask = both[run]
                out.append((key[mask], owner[mask], place[mask]))
                last = starts[-1]
                if key[last] != open_key or len(starts) > 1:
                    held = []
                open_key, open_owner, decided = key[-1], owner[-1], bool(both[-1])
                if not decided:
                    held.append((key[last:], owner[last:], place[last:]))
            columns = [np.concatenate(c) for c in zip(*out)]
            if len(columns[0]):
                yield from _places(columns if with_key else columns[1:], schema)

    return (_dealt(occurrences) if dealt is None else dealt).mapInArrow(giving_back(stream), schema)


def later(occurrences: DataFrame) -> DataFrame:
    """``owner, place`` of the occurrences whose key also has a smaller owner."""

    def stream(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = least = None
        for part in parts:
            key, owner, place, known = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            mask = known == PASSED
            mine = np.flatnonzero(~mask)
            if len(mine):
                starts, run = _runs(key[mine], owner[mine])
                first = owner[mine][starts]
                if key[mine[0]] == open_key:
                    first[0] = least
                mask[mine] = owner[mine] > first[run]
                open_key, least = key[mine[-1]], first[-1]
            if mask.any():
                yield from _places([owner[mask], place[mask]], PLACES)

    return _dealt(occurrences).mapInArrow(stream, PLACES)


def _places(columns: list[np.ndarray], schema: str) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in schema.split(", ")]
    for a in range(0, len(columns[0]), _AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + _AT_ONCE]) for c in columns], names)
