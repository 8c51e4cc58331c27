"""WARC archives: a writer, and a reader that salvages damaged files.

The writer makes one gzip member per record, so a reader can start at any record.
The reader checks each member (its CRC), version line, header, length and payload
digest. After a failed check it searches for the next valid member or version line,
goes on from there, and logs the bytes between as a quarantined gap. The same goes on
in the unpacked bytes of members that hold several records.

Files are read and written by the tasks with ``pyarrow.fs``, in blocks; a record is
the most that a task holds. Paths are those of the cluster's shared storage.
"""

from __future__ import annotations

import base64
import hashlib
import io
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, staged

#: Payloads of at least so many bytes are stored once, others refer to them.
LEAST_SHARED = 1000
#: A file is closed when it has so many bytes.
FILE_BYTES = 32 << 20
#: Bytes read at a time, and of a header at first.
BLOCK, HEADER_BYTES = 1 << 20, 1 << 16
#: Compressed bytes unpacked at a time, and the most states of zlib kept to go back in a member.
PIECE, STATES = 1 << 16, 64
#: Bytes of payload that leave a task in one batch.
BATCH_BYTES = 8 << 20
#: The date of records whose rows have none; fixed, so that archives can be compared.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it. ``file:/x``, as Spark writes it, counts as ``/x``."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path)


# -- writing ---------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page_id, url, payload, digest, kind, refers_to`` per page.

    Only payloads that occur twice are grouped; the groups (one row per digest, combined before the
    shuffle, stored so that Spark knows their size) are joined back.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    groups = (
        rows.where(F.octet_length("payload") >= LEAST_SHARED)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_first"))
        .where("_n > 1")
        .drop("_n")
    )
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(staged(groups, "payloads"), "digest", "left").select(
        "page_id",
        "url",
        F.when(~other, F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("length"),
        "digest",
        F.when(other, "revisit").otherwise("response").alias("kind"),
        F.when(other, F.col("_first")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_bytes(row: dict) -> bytes:
    """A record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['length']}\r\n\r\n"
    block = http.encode() + (row["payload"] or b"")
    url = "".join(c for c in row["url"] or "" if c >= " ")
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['kind']}",
        f"WARC-Record-ID: {record_id(row['page_id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if row["kind"] == "revisit":
        head[6:6] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'])}"]
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per page and return the stored list of files: ``path, records, bytes``.

    Of equal payloads of at least ``LEAST_SHARED`` bytes the page with the largest id is the response,
    the others are revisits that refer to it. A file gets its final name when it is complete; names differ between
    attempts of a task, which may deal rows to files in another way, and the list has the files of one attempt only.

    Defined results: a null html is an empty payload; a null id has no page number and is never referred
    to, unless all ids of its group are null, when all are responses; rows that repeat the largest id are
    all responses; control characters are dropped from urls; an empty table gives no files; other columns
    are not stored.
    """
    target = folder or scratch_dir(pages.sparkSession, "warc")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(target)
        store.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        number, out = 0, None
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out, number
            if out is not None:
                out.close()
                final = f"{root}/part-{task:06d}-{number:05d}-{attempt}.warc.gz"
                store.move(draft, final)
                done.append((final if target.startswith(("/", "file:")) else f"{target}/{final.rpartition('/')[2]}", records, size))
                out, number = None, number + 1

        for part in parts:
            for row in part.to_pylist():
                if out is None:
                    draft = f"{root}/.{task:06d}-{number:05d}-{uuid.uuid4().hex}"
                    out, records, size = store.open_output_stream(draft), 0, 0
                data = record_bytes(row)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    close()
        close()
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["path", "records", "bytes"],
        )

    planned = plan_records(pages, id_col, url_col, html_col)
    return staged(planned.mapInArrow(write, "path string, records long, bytes long"), "warc-files")


# -- reading ---------------------------------------------------------------


class Damaged(Exception):
    """A failed check; the message is the reason that is logged. The search goes on at ``resume`` or later."""

    def __init__(self, reason: str, resume: int = 0):
        super().__init__(reason)
        self.resume = resume


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    start: int
    end: int
    http_length: int | None = None
    digest: str = ""


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Unpacked:
    """The bytes of the gzip member at ``start`` as a file that ends where the member ends or fails.

    They are unpacked as they are read. To go back, zlib's state is kept at up to ``STATES`` places.
    """

    def __init__(self, outer: Salvage, start: int):
        self.outer, self.start = outer, start
        self.states = [(0, start, zlib.decompressobj(31))]
        self.restore(0)

    def restore(self, i: int) -> None:
        self.at, self.place, state = self.states[i]
        self.unpack, self.ahead, self.failure = state.copy(), b"", ""

    def forget(self, at: int) -> None:
        """Nothing before ``at`` is read again."""
        while len(self.states) > 1 and self.states[1][0] <= at:
            del self.states[0]

    def seek(self, at: int) -> None:
        if at < self.at:
            self.restore(max(i for i, state in enumerate(self.states) if state[0] <= at))
        while self.at < at and (self.ahead or self.fill()):
            skipped = min(at - self.at, len(self.ahead))
            self.at, self.ahead = self.at + skipped, self.ahead[skipped:]

    def read(self, n: int) -> bytes:
        parts = []
        while n and (self.ahead or self.fill()):
            parts.append(self.ahead[:n])
            n, self.at, self.ahead = n - len(parts[-1]), self.at + len(parts[-1]), self.ahead[n:]
        return b"".join(parts)

    def fill(self) -> bool:
        """Unpack the next bytes; false at the end."""
        if self.at >= self.states[-1][0] + BLOCK:
            self.states.append((self.at, self.place, self.unpack.copy()))
            if len(self.states) > STATES:
                del self.states[1::2]
        while not (self.ahead or self.unpack.eof or self.failure):
            data = self.outer.some(self.place)
            if not data:
                self.failure = "member is cut off"
                break
            before = self.unpack.copy()
            try:
                self.ahead = self.unpack.decompress(data)
                self.place += len(data) - len(self.unpack.unused_data)
            except zlib.error:
                self.failure = "member fails its check"
                self.ahead = self.creep(before, data)
        return bool(self.ahead)

    def creep(self, unpack, data: bytes) -> bytes:
        """What the bytes before the first one that fails unpack to."""
        parts, step = [], len(data)
        while step := step // 2:
            trial = unpack.copy()
            try:
                parts.append(trial.decompress(data[:step]))
                unpack, data, self.place = trial, data[step:], self.place + step
            except zlib.error:
                data = data[:step]
            step = len(data)
        return b"".join(parts)


@dataclass
class Salvage:
    """Read the records of one file, compressed or not, and the gaps between them.

    The size of an unpacked member is not known before its end; until then it is ``sys.maxsize``.
    """

    file: io.IOBase | Unpacked
    size: int
    buffer: bytes = field(default=b"", repr=False)
    base: int = 0

    def read(self, at: int, n: int) -> bytes:
        """Bytes from ``at``, fewer at the end of the file; keeps the last block for the search."""
        if not (self.base <= at and at + n <= self.base + len(self.buffer)):
            self.file.seek(at)
            self.base, self.buffer = at, self.file.read(max(n, BLOCK))
            if isinstance(self.file, Unpacked) and len(self.buffer) < max(n, BLOCK):
                self.size = self.file.at
        return self.buffer[at - self.base : at - self.base + n]

    def some(self, at: int) -> bytes:
        """At least one byte from ``at`` and at most ``PIECE``, none at the end of the file."""
        if at >= self.size:
            return b""
        if not self.base <= at < self.base + len(self.buffer):
            self.read(at, 1)
        return self.buffer[at - self.base : at - self.base + PIECE]

    def records(self) -> Iterator[Record | Gap]:
        at, bad, why = 0, None, ""
        while at < self.size and (first := self.read(at, 2)):
            packed = None
            try:
                if isinstance(self.file, Unpacked):
                    self.file.forget(at)
                elif first == b"\x1f\x8b":
                    packed = Unpacked(self, at)
                for found in (self.plain(at),) if packed is None else self.member(packed):
                    if bad is not None:
                        yield Gap(bad, at, why)
                        bad = None
                    after = found.end
                    yield found
                at = after if packed is None else packed.place
            except Damaged as failed:
                if bad is None:
                    bad, why = at, str(failed)
                at = self.search(max(at + 1, failed.resume))
        if bad is not None:
            yield Gap(bad, self.size, why)

    def search(self, at: int) -> int:
        """The next place that looks like a member or a version line, or the end of the file."""
        while at < self.size:
            block = self.read(at, min(BLOCK, self.size - at))
            found = [i for i in (block.find(b"\x1f\x8b\x08"), block.find(b"WARC/1.")) if i >= 0]
            if found:
                return at + min(found)
            if at + len(block) >= self.size or not block:
                return self.size
            at += len(block) - 6
        return self.size

    def member(self, packed: Unpacked) -> Iterator[Record | Gap]:
        """The records in a gzip member, and the gaps between them at the offsets of the member.

        zlib checks the member's CRC and length at its end. A record that is alone in its member waits
        for that. Those of a member of several are handed out as they are read, as from a file that is
        not compressed, and ``end`` is then how far the member was read; if the check fails, a gap follows.
        """
        inner, held, several = Salvage(packed, sys.maxsize), [], False
        for found in inner.records():
            if isinstance(found, Record) and not several:
                several = any(isinstance(h, Record) for h in held) or inner.read(found.end, 7) == b"WARC/1."
            held.append(found)
            if several:
                for h in held:
                    h.start, h.end = packed.start, packed.place
                yield from held
                held = []
        if packed.failure:
            raise Damaged(packed.failure, packed.place if several else 0)
        if not several and not any(isinstance(h, Record) for h in held):
            raise Damaged(held[0].reason if held else "no version line")
        for h in held:
            h.start, h.end = packed.start, packed.place
        yield from held

    def plain(self, at: int) -> Record:
        """The uncompressed record at ``at``."""
        n = HEADER_BYTES
        head = self.read(at, n)
        if not head.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
            raise Damaged("no version line")
        while (stop := head.find(b"\r\n\r\n")) < 0:
            if any(b":" not in line for line in head[10:].split(b"\r\n")[:-1]):
                raise Damaged("header line without a name")
            if len(head) < n:
                raise Damaged("header does not end")
            n *= 2
            head = self.read(at, n)
        headers = {}
        for line in head[10:stop].decode("utf-8", "replace").split("\r\n"):
            name, colon, value = line.partition(":")
            if not colon:
                raise Damaged("header line without a name")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise Damaged("no content length")
        begin = at + stop + 4
        end = begin + int(length)
        if end + 4 > self.size or self.read(end, 4) != b"\r\n\r\n":
            raise Damaged("record does not end where its length says")
        record = Record(headers, self.read(begin, int(length)), at, end + 4)
        return self.checked(record)

    def checked(self, record: Record) -> Record:
        """Part HTTP headers from the payload and compare the payload with its digest."""
        if record.headers.get("content-type", "").startswith("application/http"):
            head, blank, record.payload = record.payload.partition(b"\r\n\r\n")
            if not blank:
                raise Damaged("HTTP header does not end")
            for line in head.split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    record.http_length = int(value)
        algorithm, _, stated = record.headers.get("warc-payload-digest", "").partition(":")
        record.digest = hashlib.sha1(record.payload).hexdigest()
        if algorithm.lower() == "sha1":
            try:
                digest = stated.lower() if len(stated) == 40 else base64.b32decode(stated.upper()).hex()
            except ValueError as error:
                raise Damaged("payload digest cannot be read") from error
            if record.headers.get("warc-type") == "revisit":
                record.digest = digest
            elif digest != record.digest:
                raise Damaged("payload differs from its digest")
        return record


_READ = pa.schema(
    [
        ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()),
        ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ]
)
READ_SCHEMA = (
    "path string, start long, end long, gap string, record_type string, record_id string, url string, "
    "refers_to string, payload_bytes long, payload_digest string, payload binary"
)


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives listed in ``files(path)``.

    A row is a record (``gap`` is null) or a gap (the reason). ``payload_bytes`` and ``payload_digest``
    are measured on the payload; for a revisit they are what its headers say of the full payload.
    Records of a member with several have the member's start, and the end is how far it was read.
    Each file is one task's work, so a damaged file costs only itself.

    Defined results: an empty file has no rows; a file without any record is one gap; a missing or
    unreadable file fails its task, which Spark runs again; a null path is passed over.
    """
    listed = files.where("path is not null").select("path")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column(0).to_pylist():
                store, inside = filesystem(path)
                with store.open_input_file(inside) as file:
                    rows, size = [], 0
                    for found in Salvage(file, file.size()).records():
                        rows.append(read_row(path, found, with_payload))
                        size += len(rows[-1]["payload"] or b"") + 200
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, _READ)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _READ)

    return listed.repartition(max(1, listed.count())).mapInArrow(read, READ_SCHEMA)


def read_row(path: str, found: Record | Gap, with_payload: bool) -> dict:
    row = {"path": path, "start": found.start, "end": found.end, "payload": None}
    if isinstance(found, Gap):
        return row | {"gap": found.reason}
    kind = found.headers.get("warc-type")
    revisit = kind == "revisit"
    return row | {
        "record_type": kind,
        "record_id": found.headers.get("warc-record-id"),
        "url": found.headers.get("warc-target-uri"),
        "refers_to": found.headers.get("warc-refers-to"),
        "payload_bytes": found.http_length if revisit else len(found.payload),
        "payload_digest": found.digest,
        "payload": found.payload if with_payload and not revisit else None,
    }


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the archives below a folder, by Spark's own listing; contents are not read.

    In a folder of :func:`write_warc` there may be files of lost attempts besides; its list has those that count.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").where(
        F.col("path").rlike(r"\.warc(\.gz)?$")
    )
