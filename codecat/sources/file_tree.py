"""A data source that lists and reads a live file tree.

``spark.read.format("file_tree")`` visits hidden and underscore names, which
the built-in file sources skip, and does not follow links. The root must be
mounted on all executors.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Executors need no copy of this package: what runs in tasks is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SCHEMA = pa.schema(
    [("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("reason", pa.string())]
)
#: Longer contents do not fit a row.
MOST_BYTES = 1 << 30
#: Bytes that a task gathers before it hands a batch on.
BATCH_BYTES = 32 << 20


@dataclass
class _Subtree(InputPartition):
    """Whole directories, or a slice of the files directly in one."""

    roots: tuple[str, ...]
    recursive: bool
    slice: int = 0
    slices: int = 1


def _name(path: str) -> str:
    return os.fsencode(path).decode("utf-8", "replace")


def _flag(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() == "true"


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/") or "/"
        self.content = _flag(options.get("content"), True)
        self.skip_hidden = _flag(options.get("skipHidden"), False)
        self.exclude = [part for part in options.get("exclude", "").split(",") if part]
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)
        self.target = int(options.get("partitions", "64"))
        self.slices = int(options.get("slices", "8"))

    def _pruned(self, entry: os.DirEntry) -> bool:
        hidden = self.skip_hidden and entry.name.startswith(".")
        return hidden or any(part in entry.path + "/" for part in self.exclude)

    def _children(self, folder: str) -> tuple[list[os.DirEntry], list[os.DirEntry]]:
        """Directories to visit and files of a folder."""
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
        folders = [e for e in entries if e.is_dir(follow_symlinks=False) and not self._pruned(e)]
        return folders, [e for e in entries if e.is_file(follow_symlinks=False)]

    def partitions(self) -> list[_Subtree]:
        """Split level by level until there are enough subtrees.

        Files directly in a folder that was split are read in slices by the
        hash of their name, so a flat folder is not left to one task.
        """
        os.scandir(self.root).close()  # a missing root is an error
        split, whole = [], [self.root]
        while whole and len(whole) < self.target:
            below = []
            for folder in whole:
                try:
                    below += [child.path for child in self._children(folder)[0]]
                except (PermissionError, FileNotFoundError):
                    pass  # the task that reads it reports it
            split += whole
            whole = below
        flat = [
            _Subtree((folder,), False, i, self.slices) for folder in split for i in range(self.slices)
        ]
        shares = min(len(whole), 4 * self.target)
        return flat + [_Subtree(tuple(whole[i::shares]), True) for i in range(shares)]

    def _walk(self, part: _Subtree) -> Iterator[os.DirEntry | str]:
        """The files of a subtree, and the paths of folders that may not be read."""
        pending = list(part.roots)
        while pending:
            folder = pending.pop()
            try:
                folders, files = self._children(folder)
            except (PermissionError, FileNotFoundError):
                if part.slice == 0:
                    yield folder
                continue
            for entry in files:
                if part.slices == 1 or zlib.crc32(os.fsencode(entry.name)) % part.slices == part.slice:
                    yield entry
            if part.recursive:
                pending += [folder.path for folder in folders]

    def _row(self, entry: os.DirEntry | str) -> tuple:
        """A file, or a reason why it is missing. Errors that may pass fail the task, which Spark runs again."""
        if isinstance(entry, str):
            return _name(entry), None, None, "unreadable folder"
        try:
            length, data, reason = entry.stat(follow_symlinks=False).st_size, None, None
            if self.content and length > MOST_BYTES:
                reason = "content too long"
            elif self.content:
                with open(entry.path, "rb") as file:
                    data = file.read()
        except (PermissionError, FileNotFoundError) as error:
            return _name(entry.path), None, None, f"unreadable file: {type(error).__name__}"
        return _name(entry.path), length, data, reason

    def read(self, part: _Subtree) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for entry in self._walk(part):
            if not isinstance(entry, str) and self.suffixes and not entry.name.endswith(self.suffixes):
                continue
            row = self._row(entry)
            size = len(row[2] or b"") + 64
            if rows and held + size > BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
            rows.append(row)
            held += size
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), _SCHEMA)]
        return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


class FileTree(DataSource):
    """Options: ``path``; ``content`` (true: read contents); ``skipHidden`` and
    ``exclude`` (comma-separated path parts) prune directories while listing;
    ``suffixes`` keeps files with these endings; ``partitions`` and ``slices``
    steer how the tree is split. What cannot be read has a row with a ``reason``
    and no content."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, length bigint, content binary, reason string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the ``file_tree`` format known to a session."""
    spark.dataSource.register(FileTree)
