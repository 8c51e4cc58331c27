"""Where the files of a stored corpus lie: which Parquet file, which row.

The index is a narrow table beside the corpus, in ranges of paths, kept up by a stream
that sees each Parquet file once. With it, contents are read at their places: hits
meet the index, and tasks read the named rows of the named files. Contents are never
shuffled, whatever the number of hits, and files without a hit are not opened.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ends_with_any
from ..operators.digest import JS_SUFFIXES
from .corpus import stream_corpus
from .tables import stored

# Executors need no copy of this package: what runs in tasks is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Endings of the files that a catalogue can name.
SOURCE_SUFFIXES = (".java", ".py", *JS_SUFFIXES, ".go")
LOCATIONS = "path string, file string, row long, batch long"
#: Rows that a task reads, about; bytes of contents that it holds.
ROWS_PER_TASK = 2000
BATCH_BYTES = 32 << 20


def update_locations(spark: SparkSession, corpus: str, table: str, checkpoint: str) -> None:
    """Add the Parquet files that came to ``corpus`` since the last run to the index ``table``.

    The files of a corpus do not change and are not removed. A run that was cut off can be repeated: a replayed
    batch replaces its part. Only files that a catalogue can name are located; contents are not read.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        rows = batch.repartitionByRange("path").sortWithinPartitions("path")
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    files = stream_corpus(spark, corpus).where(ends_with_any(F.col("path"), SOURCE_SUFFIXES))
    located = files.select("path", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    run = located.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def open_locations(spark: SparkSession, table: str) -> DataFrame:
    """``(path, file, row)`` of the index; empty when there is none yet."""
    return stored(spark, table, LOCATIONS).drop("batch")


def opened(uri: str) -> pa.NativeFile:
    """A file by its URI as Spark writes it, with escaped characters."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parsed.path) if parsed.scheme else uri)
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def rows_of(uri: str, rows: np.ndarray) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """``path, content`` of some rows of a Parquet file, given in order without repeats; row groups without any are not read."""
    with opened(uri) as file:
        parquet = pq.ParquetFile(file)
        counts = [parquet.metadata.row_group(g).num_rows for g in range(parquet.num_row_groups)]
        ends = np.cumsum(counts)
        if len(rows) and (not len(ends) or rows[-1] >= ends[-1]):
            raise ValueError(f"{uri} has no row {rows[-1]}; build the index anew")
        group = np.searchsorted(ends, rows, side="right")
        for g in np.unique(group).tolist():
            wanted = rows[group == g] - (ends[g] - counts[g])
            size = max(1, parquet.metadata.row_group(g).total_byte_size // max(1, counts[g]))
            some = max(1, min(8192, BATCH_BYTES // 4 // size))
            at = 0
            for batch in parquet.iter_batches(some, [g], columns=["path", "content"], use_threads=False):
                here = wanted[(wanted >= at) & (wanted < at + batch.num_rows)]
                if len(here):
                    yield here + (ends[g] - counts[g]), batch.take(pa.array(here - at))
                at += batch.num_rows
                if at > wanted[-1]:
                    break


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of ``file, row, path, …`` rows, sorted by file and row; the other columns come along."""
    for part in parts:
        files = part.column("file").dictionary_encode()
        code, names = files.indices.to_numpy(), files.dictionary.to_pylist()
        row = part.column("row").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            uri = names[code[a]]
            for found, data in rows_of(uri, np.unique(row[a:b])):
                mine = a + np.flatnonzero(np.isin(row[a:b], found))
                place = np.searchsorted(found, row[mine])
                sizes = np.asarray(pc.fill_null(pc.binary_length(data.column("content")), 0))[place]
                # A content is repeated for each of its hits, so batches are cut by what goes out.
                block = np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES
                edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(mine)]
                for c, d in zip(edges, edges[1:]):
                    hits = part.take(pa.array(mine[c:d]))
                    rows = data.take(pa.array(place[c:d]))
                    if not rows.column("path").cast(pa.string()).equals(hits.column("path").cast(pa.string())):
                        raise ValueError(f"{uri} holds other files than the index says; build it anew")
                    columns = [hits.column(i) for i, name in enumerate(hits.schema.names) if name not in ("file", "row")]
                    yield pa.RecordBatch.from_arrays([*columns, rows.column("content").cast(pa.binary())], [n for n in hits.schema.names if n not in ("file", "row")] + ["content"])


def read_located(places: DataFrame) -> DataFrame:
    """Add ``content`` to the rows ``file, row, path, …`` of a stored table, in place of ``file`` and ``row``.

    Rows are dealt by file and row, evenly by their number, so the hits of one large file go to several
    tasks, which read its row groups apart. Repeated places give repeated rows; no places give none. A row that holds
    another path than the index says fails its task.
    """
    kept = [f for f in places.schema if f.name not in ("file", "row")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    tasks = max(1, -(-places.count() // ROWS_PER_TASK))
    dealt = places.repartitionByRange(tasks, "file", "row").sortWithinPartitions("file", "row")
    return dealt.mapInArrow(_read, f"{schema}, content binary").withColumn("content", F.col("content").cast("string"))
