"""Expansion of zip archives to files."""

from __future__ import annotations

import io
import lzma
import posixpath
import struct
import sys
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import BATCH_BYTES, EXPANDED, batch_of, parts_of
from .scratch import staged

# Executors need no copy of this package: what runs in tasks is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Archives that a task opens, at most.
ARCHIVES_PER_TASK = 8

#: Facts about the data. Any other error may pass, so it fails the task and Spark runs it again.
_BAD_ARCHIVE = (zipfile.BadZipFile, zipfile.LargeZipFile, ValueError, NotImplementedError, struct.error, EOFError)
_BAD_ENTRY = (*_BAD_ARCHIVE, zlib.error, lzma.LZMAError, RuntimeError)


def _entries(archive: str, out_dir: str, source: str | io.BytesIO) -> Iterator[tuple]:
    """Rows of one archive; one with a reason and no content per refused entry."""
    try:
        opened = zipfile.ZipFile(source)
    except (*_BAD_ARCHIVE, FileNotFoundError) as error:
        yield archive, None, 0, False, None, f"bad archive: {type(error).__name__}"
        return
    with opened:
        # Of entries with one target path the last is kept.
        wanted = {}
        for info in opened.infolist():
            name = info.filename
            if info.is_dir():
                continue
            if name.startswith("/") or ".." in name.split("/"):
                yield archive, name, 0, False, None, "entry leaves its directory"
            else:
                wanted[posixpath.join(out_dir, posixpath.normpath(name))] = info
        for path, info in wanted.items():
            part = 0
            try:
                with opened.open(info) as entry:
                    for part, more, content, reason in parts_of(entry, path):
                        yield archive, path, part, more, content, reason
            except OSError as error:
                if error.errno is not None:
                    raise
                # The bzip2 decoder's error for bad data.
                yield archive, path, part, False, None, f"bad entry: {type(error).__name__}"
            except _BAD_ENTRY as error:
                yield archive, path, part, False, None, f"bad entry: {type(error).__name__}"


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``path, out_dir`` and, unless the path is to be opened, ``content``."""
    rows, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            archive, out_dir, *data = (column[i].as_py() for column in batch.columns)
            for row in _entries(archive, out_dir, io.BytesIO(data[0]) if data else archive):
                size = len(row[4] or b"") + 64
                if rows and held + size > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
                rows.append(row)
                held += size
    if rows:
        yield batch_of(rows)


def _placed(wanted: DataFrame, root: str) -> DataFrame:
    out_dir = F.concat(F.lit(root.rstrip("/") + "/"), F.col("out_dir"))
    return wanted.select("path", out_dir.alias("out_dir")).distinct()


def expand_archives(archives: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """``(archive, path, part, more, content, reason)``: the entries of archives.

    ``archives(path, content)`` are read where ``wanted(path, out_dir)`` names
    them, and an entry goes to ``<root>/<out_dir>/<entry>``. A long entry has a
    row per part, see :mod:`codecat.sources.parts`. Refused entries and archives have a reason
    and no content; what was read of an entry before its error stays in parts
    before it. Each archive is one row, so at most 2 GB; larger ones are for
    :func:`expand_mounted`, which is the way to go where executors see the
    archives as files: it never moves contents. Here they are shuffled only
    when ``wanted``, which is stored first, is too large to broadcast.
    """
    placed = staged(_placed(wanted, root), "wanted")
    chosen = archives.join(placed, "path").select("path", "out_dir", "content")
    return chosen.mapInArrow(_expand, EXPANDED)


def expand_mounted(wanted: DataFrame, root: str) -> DataFrame:
    """As :func:`expand_archives`, for archives on a file system that all executors mount.

    Only paths are shuffled, dealt evenly to one task per ARCHIVES_PER_TASK
    archives. Each task opens its archives in place and reads one part at a
    time, so neither an archive nor an entry has to fit a row.
    """
    placed = staged(_placed(wanted, root), "wanted")
    tasks = max(1, -(-placed.count() // ARCHIVES_PER_TASK))
    return placed.select("path", "out_dir").repartition(tasks).mapInArrow(_expand, EXPANDED)


def expanded_files(expanded: DataFrame) -> DataFrame:
    """``files(path, content)`` of the accepted entries that come whole; bad bytes become U+FFFD.

    Entries in parts are for :func:`codecat.operators.digest.digest_parts`.
    """
    whole = F.col("reason").isNull() & (F.col("part") == 0) & ~F.col("more")
    return expanded.where(whole).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def expansion_rejects(expanded: DataFrame) -> DataFrame:
    """Refused archives and entries, and refused files of a tree."""
    place = F.concat_ws("!", "archive", "path")
    stage = F.when(F.col("archive").isNull(), "tree").otherwise("archive")
    return expanded.where(F.col("reason").isNotNull()).select(place.alias("path"), stage.alias("stage"), "reason")
