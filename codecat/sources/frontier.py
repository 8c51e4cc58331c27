"""A walk of a live file tree in rounds, nothing of which is listed on the driver.

The folders still to be listed are a table. In each round it is dealt evenly, by their number, to tasks that
list them and go on below them, up to a number of entries; what is left then goes to the next round.
So a deep or lopsided tree is dealt again and again, and a shallow one takes a round or two. The rounds are
stored, and an executor that is lost costs its tasks of one round. Contents are read afterwards, dealt anew.
"""

from __future__ import annotations

import os
import sys
from collections import deque
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parts import BATCH_BYTES, EXPANDED, batch_of, parts_of
from .scratch import scratch_dir, staged

# Executors need no copy of this package: what runs in tasks is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries that a task lists in a round before it hands on the folders it has not come to.
ENTRIES_PER_ROUND = 20_000
#: Folders that a task starts a round with, where there are more than tasks at a time.
FOLDERS_PER_TASK = 200
#: Bytes of contents, and files, that a task reads, about.
BYTES_PER_TASK, FILES_PER_TASK = 256 << 20, 5000
#: Rows of a batch.
_ROWS = 10_000

FILE, FOLDER = "file", "folder"
ENTRIES = "raw binary, kind string, length long, reason string"
_ENTRIES = pa.schema([("raw", pa.binary()), ("kind", pa.string()), ("length", pa.int64()), ("reason", pa.string())])


def shown(raw: bytes) -> str:
    """A path as text; bytes that are none become U+FFFD."""
    return raw.decode("utf-8", "replace")


def list_folder(folder: bytes) -> tuple[list[bytes], list[tuple[bytes, int]]]:
    """Names of the folders in a folder, and names and sizes of its files; links and special files are passed over."""
    folders, files = [], []
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.is_dir(follow_symlinks=False):
                folders.append(entry.name)
            elif entry.is_file(follow_symlinks=False):
                try:
                    files.append((entry.name, entry.stat(follow_symlinks=False).st_size))
                except FileNotFoundError:
                    pass  # removed since it was listed
    return folders, files


def walk(roots: list[bytes], most: int, skip_hidden: bool, exclude: Collection[str], suffixes: tuple[bytes, ...]) -> Iterator[tuple]:
    """Entries below some folders, those nearest first; after ``most`` of them, the folders not listed yet."""
    pending, listed = deque(roots), 0
    parts = [os.fsencode(p) for p in exclude]
    while pending and listed < most:
        folder = pending.popleft()
        try:
            folders, files = list_folder(folder)
        except (PermissionError, FileNotFoundError, NotADirectoryError) as error:
            yield folder, FILE, None, f"unreadable folder: {type(error).__name__}"
            continue
        listed += 1 + len(folders) + len(files)
        stem = folder.rstrip(b"/") + b"/"
        for name, length in files:
            if not suffixes or name.endswith(suffixes):
                yield stem + name, FILE, length, None
        for name in folders:
            below = stem + name
            if not (skip_hidden and name.startswith(b".")) and not any(p in below + b"/" for p in parts):
                pending.append(below)
    for folder in pending:
        yield folder, FOLDER, None, None


def scan_tree(
    spark: SparkSession,
    root: str,
    skip_hidden: bool = False,
    exclude: Collection[str] = (),
    suffixes: Collection[str] = (),
    entries_per_round: int = ENTRIES_PER_ROUND,
) -> DataFrame:
    """``(raw, path, length, reason)`` of all files below a folder that all executors mount.

    ``raw`` is the path in bytes. ``skip_hidden`` and ``exclude`` (parts of paths) prune folders, ``suffixes`` keeps
    files with these endings. A folder that may not be read, or is gone, has a row with a reason, and so has a missing root;
    other errors may pass, so they fail the task, which Spark runs again.
    """
    ends = tuple(os.fsencode(s) for s in suffixes)
    work, rounds = scratch_dir(spark, "tree"), []

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = [raw for part in parts for raw in part.column("raw").to_pylist()]
        rows = []
        for row in walk(roots, entries_per_round, skip_hidden, exclude, ends):
            rows.append(row)
            if len(rows) >= _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRIES)], schema=_ENTRIES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENTRIES)], schema=_ENTRIES)

    start = os.fsencode(root.rstrip("/") or "/")
    frontier, waiting = spark.createDataFrame([(bytearray(start),)], "raw binary"), 1
    at_a_time = 2 * spark.sparkContext.defaultParallelism
    while waiting:
        tasks = max(min(waiting, at_a_time), -(-waiting // FOLDERS_PER_TASK))
        found = staged(frontier.repartition(tasks).mapInArrow(read, ENTRIES), f"round={len(rounds)}", under=work)
        rounds.append(f"{work}/round={len(rounds)}")
        frontier = found.where(F.col("kind") == FOLDER).select("raw")
        waiting = frontier.count()
    files = spark.read.schema(ENTRIES).parquet(*rounds).where(F.col("kind") == FILE)
    return files.select("raw", F.make_valid_utf8(F.col("raw").cast("string")).alias("path"), "length", "reason")


def read_tree(files: DataFrame) -> DataFrame:
    """Contents of the files of :func:`scan_tree`, in parts as of :mod:`codecat.sources.parts`; ``archive`` is null.

    Files are dealt evenly by their number, to as many tasks as their bytes and their number call for. A task holds one part
    of a file at a time. What cannot be read has a row with a reason.
    """
    known = files.select("raw", "path", F.coalesce("length", F.lit(0)).alias("length"), "reason")
    total = known.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files")).collect()[0]
    tasks = max(1, -(-(total["bytes"] or 0) // BYTES_PER_TASK), -(-total["files"] // FILES_PER_TASK))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in parts:
            for row in part.to_pylist():
                for found in read_file(row["raw"], row["path"], row["reason"]):
                    size = len(found[4] or b"") + 64
                    if rows and held + size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                    rows.append(found)
                    held += size
        if rows:
            yield batch_of(rows)

    return known.repartitionByRange(tasks, F.xxhash64("raw"), "raw").mapInArrow(read, EXPANDED)


def read_file(raw: bytes, path: str, reason: str | None) -> Iterator[tuple]:
    if reason:
        yield None, path, 0, False, None, reason
        return
    part = 0
    try:
        with open(raw, "rb") as file:
            for part, more, content, refused in parts_of(file, path):
                yield None, path, part, more, content, refused
    except (PermissionError, FileNotFoundError) as error:
        yield None, path, part, False, None, f"unreadable file: {type(error).__name__}"
