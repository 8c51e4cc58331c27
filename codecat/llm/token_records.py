"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A file is a run of frames as in TFRecord files: the length of the payload (64 bits, little-endian),
its masked CRC-32C, the payload, and the payload's masked CRC-32C. A payload is a header of 16
bytes and the ids. The header has flags (1: the document has no id; 2: ids have four bytes, else two),
seven zero bytes, and the document's id; all numbers are little-endian.

Beside each file lies its index ``<file>.idx``: a pair of 64-bit numbers per record, its offset and the
number of ids before it in the file, and a last pair for the end. A record can so be read by itself, which is
what :func:`read_shuffled` does. The returned list of files says which files count; files of lost
attempts have names of their own and are not listed.

Documents are dealt by ranges of their ids, so each task encodes and writes a run of the order,
and texts move once. The words of a block of texts are told apart by 64-bit hashes, and each distinct
word is encoded once, where the tokenizer's rules let no token cross white space.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, staged
from .warc import filesystem
from .words import SLICE_BYTES, Numbers, Words, slices, words_of

MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: The id after each document.
END_ID = 1
#: A file is closed when it has so many bytes.
FILE_BYTES = 64 << 20
#: Bytes read at a time, and bytes of ids that leave a task in one batch.
BLOCK, BATCH_BYTES = 4 << 20, 4 << 20
#: Distinct words whose ids a worker keeps, beyond which it starts anew; slots that their table starts with, as a power of two.
KEPT_WORDS, SLOT_BITS = 1_200_000, 20
#: Words looked up at a time, and words encoded in one call.
WORDS_AT_ONCE, WORDS_A_CALL = 400_000, 512
#: Open files of a task that reads in shuffled order.
OPEN_FILES = 32
NO_ID, WIDE = 1, 2
HEADER = struct.Struct("<Bxxxxxxxq")


# -- checksums -------------------------------------------------------------


@cache
def byte_tables() -> np.ndarray:
    """CRC-32C of each byte with 0 to 7 zero bytes behind it."""
    tables = np.zeros((8, 256), np.uint32)
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0x82F63B78), value >> 1).astype(np.uint32)
    tables[0] = value
    for k in range(1, 8):
        tables[k] = (tables[k - 1] >> 8) ^ value[tables[k - 1] & 255]
    return tables


@cache
def shift_tables(level: int) -> np.ndarray:
    """What ``8 << level`` zero bytes make of a checksum, per byte of it."""
    if level == 0:
        t = byte_tables()
        return t[[7, 6, 5, 4]]
    return np.stack([shifted(table, level - 1) for table in shift_tables(level - 1)])


def shifted(crc: np.ndarray, level: int) -> np.ndarray:
    t = shift_tables(level)
    return t[0][crc & 255] ^ t[1][(crc >> 8) & 255] ^ t[2][(crc >> 16) & 255] ^ t[3][crc >> 24]


def crc32c(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32C of many parts of ``data`` (bytes), each of four bytes or more.

    A checksum is linear and does not see zeros in front, so parts are filled up in front to whole 64-bit
    words; the words' checksums are combined in pairs, level by level.
    """
    counts = (sizes + 7) // 8
    ends = np.cumsum(counts)
    padded = np.zeros(8 * int(ends[-1] if len(ends) else 0), np.uint8)
    begin = 8 * ends - sizes
    if len(sizes) and sizes.min() == sizes.max() == 8:
        padded[:] = data[(starts[:, None] + np.arange(8)).ravel()]
    else:
        for to, start, size in zip(begin.tolist(), starts.tolist(), sizes.tolist()):
            padded[to : to + size] = data[start : start + size]
    for k in range(4):
        padded[begin + k] ^= 255
    t = byte_tables()
    crc = np.zeros(len(padded) // 8, np.uint32)
    for k, column in enumerate(padded.reshape(-1, 8).T):
        crc ^= t[7 - k][column]
    level = 0
    while len(crc) > len(sizes):
        halves = (counts + 1) // 2
        upto = np.cumsum(halves)
        part = np.repeat(np.arange(len(sizes)), halves)
        right = np.repeat(ends, halves) - 1 - 2 * (np.repeat(upto, halves) - 1 - np.arange(int(upto[-1])))
        paired = right > (ends - counts)[part]
        joined = crc[right]
        joined[paired] ^= shifted(crc[right[paired] - 1], level)
        crc, counts, ends, level = joined, halves, upto, level + 1
    return crc ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Turned and moved, as in TFRecord files: checksums of data that hold checksums stay apart."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


# -- encoding --------------------------------------------------------------


class Encoder:
    """Ids of many texts by the ``tokenizers`` library, without special tokens.

    Where a tokenizer takes words each by itself, the ids of the words seen are kept, in one array, numbered by
    64-bit hashes. Words that are runs of plain lower-case letters need neither the tokenizer's normaliser
    nor its pattern; they are encoded with a digit between them, which tells where their ids end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.by_word = ends_at_spaces(rules)
        if self.by_word:
            bytewise = rules["pre_tokenizer"]["pretokenizers"][1:]
            plain = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *bytewise]}
            self.plain = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": plain}))
            self.between = self.plain.encode("0", add_special_tokens=False).ids
            self.by_word = len(self.between) == 1
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers(SLOT_BITS)
        self.pieces, self.piece_at = np.empty(0, self.kind), np.zeros(1, np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (and the end)."""
        if not self.by_word:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            flat = np.concatenate([np.empty(0, self.kind), *(np.array(e, self.kind) for e in each)])
            return flat, np.concatenate([[0], np.cumsum([len(e) for e in each], dtype=np.int64)])
        words = without_marks(words_of(texts))
        hashes = word_hashes(words)
        flat, counts = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        for a in range(0, len(hashes), WORDS_AT_ONCE):
            code = self.known(words, a, hashes[a : a + WORDS_AT_ONCE])
            counts.append(self.piece_at[code + 1] - self.piece_at[code])
            before = np.cumsum(counts[-1]) - counts[-1]
            flat.append(self.pieces[np.arange(int(counts[-1].sum())) + np.repeat(self.piece_at[code] - before, counts[-1])])
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(flat), upto[words.first]

    def known(self, words: Words, first: int, hashes: np.ndarray) -> np.ndarray:
        """The numbers of the words from ``first`` on among the words kept; new ones are encoded."""
        if len(self.piece_at) > KEPT_WORDS:
            self.forget()
        code = self.numbers.find(hashes)
        new = np.flatnonzero(code < 0)
        if len(new):
            distinct, example = np.unique(hashes[new], return_index=True)
            at, number = first + new[example], len(self.piece_at) - 1
            data = words.data.data
            self.encode([str(data[a:b], "utf-8", "replace") for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())])
            self.numbers.add(distinct, np.arange(number, number + len(distinct), dtype=np.int32))
            code[new] = self.numbers.find(hashes[new])
        return code

    def encode(self, words: list[str]) -> None:
        """Number new words and keep their ids."""
        plain = np.fromiter((PLAIN(w) is not None for w in words), bool, len(words))
        lists: list[np.ndarray] = [np.empty(0, self.kind)] * len(words)
        some = np.flatnonzero(plain).tolist()
        for a in range(0, len(some), WORDS_A_CALL):
            part = some[a : a + WORDS_A_CALL]
            joined = " 0 ".join([words[i].lower() for i in part])
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == self.between[0])
            for i, start, end in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)]):
                lists[i] = ids[start:end]
        rest = np.flatnonzero(~plain).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            lists[i] = np.array(e.ids, self.kind)
        self.pieces = np.concatenate([self.pieces, *lists])
        self.piece_at = np.concatenate([self.piece_at, self.piece_at[-1] + np.cumsum([len(x) for x in lists])])


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker, for all its tasks."""
    return Encoder(path)


def ends_at_spaces(rules: dict) -> bool:
    """Whether a tokenizer encodes words between white space each by itself.

    It does if it keeps what a pattern finds outside white space, marks the ends of words itself, changes
    characters only by NFC, by runs of white space and by case, and has no token that looks beyond its own characters.
    """
    split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    parts = (rules.get("normalizer") or {}).get("normalizers", [])
    spaces = [p for p in parts if p["type"] == "Replace"]
    return bool(
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert")
        and split.get("pattern", {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and all(p["type"] in ("NFC", "Lowercase", "Replace") for p in parts)
        and all(p["pattern"] == {"Regex": r"\s+"} and p["content"] == " " for p in spaces)
        and rules["model"].get("end_of_word_suffix")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1 for t in rules["added_tokens"])
    )


#: Runs of letters that the normaliser leaves alone, but for the case of A to Z in pure ASCII; those letters beyond ASCII are lower-case and composed.
PLAIN = re.compile("[A-Za-z]+|[a-zß-öø-ÿ]+").fullmatch

#: Kinds of bytes: ASCII letters and digits; marks that are neither part of a contraction nor of a special token; all that keeps its case.
ALNUM, MARK, ODD = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[ord("0") : ord("9") + 1] = _KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = ALNUM
_KIND[list(b".,;:!?#$%&*()=+-/")] = MARK
_KIND[ord("|")] = _KIND[128:] = ODD


def without_marks(words: Words) -> Words:
    """Marks that follow a letter or digit at the end of a word as a word of their own: no token holds both.

    The letters are those of ASCII and of Latin-1, whose first byte is C3.
    """
    data = words.data
    if not len(words.starts):
        return words
    other = np.maximum.accumulate(np.where(_KIND[data] == MARK, -1, np.arange(len(data))))
    cut = other[words.ends - 1] + 1
    before, second = data[cut - 1], data[np.maximum(cut - 2, 0)]
    letter = (_KIND[before] == ALNUM) | ((second == 0xC3) & (before != 0x97) & (before != 0xB7))
    apart = (cut > words.starts) & (cut < words.ends) & letter
    shift = np.concatenate([[0], np.cumsum(apart)])
    places = np.arange(len(cut)) + shift[:-1]
    starts, ends = (np.empty(len(cut) + int(shift[-1]), np.int64) for _ in range(2))
    starts[places], ends[places] = words.starts, np.where(apart, cut, words.ends)
    starts[places[apart] + 1], ends[places[apart] + 1] = cut[apart], words.ends[apart]
    return Words(data, starts, ends, words.first + shift[words.first])


def word_hashes(words: Words) -> np.ndarray:
    """Equal for words that differ in the case of A to Z only, if they are ASCII and can be no special token."""
    if not len(words.starts):
        return np.empty(0, np.uint64)
    odd = np.bitwise_or.reduceat(_KIND[words.data] & ODD, words.starts) > 0
    return np.where(odd, words.hashes(seed=7), words.hashes(lower=True, seed=8)) | np.uint64(1)


# -- writing ---------------------------------------------------------------


def frames(doc_ids: pa.Array, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of a block of documents, and where each begins (and the end)."""
    n, width = len(doc_ids), ids.dtype.itemsize
    sizes = HEADER.size + width * np.diff(first)
    at = np.concatenate([[0], np.cumsum(sizes + 16)])
    data = np.zeros(int(at[-1]), np.uint8)
    places = at[:-1, None] + np.arange(8)
    data[places] = sizes.astype("<u8").view(np.uint8).reshape(n, 8)
    lacks = np.asarray(pc.is_null(doc_ids).to_numpy(zero_copy_only=False))
    data[places[:, 0] + 12] = NO_ID * lacks + (WIDE if width == 4 else 0)
    data[places + 20] = np.asarray(pc.fill_null(doc_ids, 0).to_numpy(), "<i8").view(np.uint8).reshape(n, 8)
    begin = at[:-1] + 12 + HEADER.size
    flat = np.ascontiguousarray(ids).view(np.uint8)
    for to, a, b in zip(begin.tolist(), (width * first[:-1]).tolist(), (width * first[1:]).tolist()):
        data[to : to + b - a] = flat[a:b]
    for starts, lengths, place in ((at[:-1], np.full(n, 8), at[:-1] + 8), (at[:-1] + 12, sizes, at[1:] - 4)):
        sums = masked(crc32c(data, starts, lengths)).astype("<u4").view(np.uint8).reshape(n, 4)
        data[place[:, None] + np.arange(4)] = sums
    return data, at


FILES = "path string, part int, number int, records long, ids long, bytes long"


def write_records(
    docs: DataFrame,
    folder: str | None = None,
    model: str = MODEL,
    end_id: int | None = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode all texts and write them by ascending id; returns the stored list of files.

    Columns: ``path, part, number`` (files are in the order of ``part, number``), ``records``, ``ids``, ``bytes`` and
    ``start`` (the ids in all files before). ``end_id`` is put after each document.

    Defined results: a null text has no ids of its own; null ids come first; rows that repeat an id are records of
    their own, ordered by a hash of their texts, and may go to several tasks; an empty table gives no files; other columns are not
    looked at. Ids are cast to 64-bit integers. A task holds about 2 MB of text and what belongs to it, or one text if that is longer,
    and the ids of up to ``KEPT_WORDS`` words.
    """
    target = folder or scratch_dir(docs.sparkSession, "records")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    order = ["_id", F.xxhash64("_text"), F.monotonically_increasing_id()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions("_id", F.xxhash64("_text"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(target)
        store.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out = None
        done: list[tuple] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                with store.open_output_stream(f"{path}.idx") as index:
                    index.write(np.concatenate([*entries, [[size, n_ids]]]).astype("<u8").tobytes())
                shown = path if target.startswith(("/", "file:")) else f"{target}/{path.rpartition('/')[2]}"
                done.append((shown, task, len(done), sum(map(len, entries)), n_ids, size))
                out = None

        for part in parts:
            for block in slices(part, "_text", min(SLICE_BYTES, file_bytes)):
                ids, first = encoder(model).ids(block.column("_text"))
                if end_id is not None:
                    ids = np.insert(ids, first[1:], end_id)
                    first = first + np.arange(len(first))
                data, at = frames(block.column("_id"), ids, first)
                if out is None:
                    path = f"{root}/part-{task:06d}-{len(done):05d}-{attempt}.tfrecord"
                    out, entries, size, n_ids = store.open_output_stream(path), [], 0, 0
                out.write(data.tobytes())
                entries.append(np.stack([size + at[:-1], n_ids + first[:-1]], axis=1))
                size, n_ids = size + len(data), n_ids + int(first[-1])
                if size >= file_bytes:
                    close()
        close()
        columns = list(zip(*done)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in FILES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = dealt.mapInArrow(write, FILES)
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return staged(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "record-list")


# -- reading ---------------------------------------------------------------


class Corrupt(ValueError):
    """A record whose lengths or checksums do not fit."""


def parse(data: bytes, path: str, offset: int) -> tuple[list[int], list[int]]:
    """Where the payloads of the whole frames at the start of ``data`` begin and how long they are; all are checked."""
    at, starts, sizes = 0, [], []
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        if size < HEADER.size or size > 1 << 40:
            check(data, np.array([at]), np.array([8]), path, offset)
            raise Corrupt(f"{path}: a payload of {size} bytes at {offset + at}")
        if at + 16 + size > len(data):
            break
        starts.append(at + 12)
        sizes.append(size)
        at += 16 + size
    if starts:
        begin = np.array(starts)
        check(data, begin - 12, np.full(len(begin), 8), path, offset)
        check(data, begin, np.array(sizes), path, offset)
    return starts, sizes


def check(data: bytes, starts: np.ndarray, sizes: np.ndarray, path: str, offset: int) -> None:
    flat = np.frombuffer(data, np.uint8)
    ends = starts + sizes
    said = flat[ends[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    wrong = np.flatnonzero(said != masked(crc32c(flat, starts, sizes)))
    if len(wrong):
        raise Corrupt(f"{path}: a checksum does not fit at {offset + int(starts[wrong[0]])}")


def payload(data: bytes, start: int, size: int) -> tuple[int | None, np.ndarray]:
    flags, doc_id = HEADER.unpack_from(data, start)
    kind = np.dtype("<u4" if flags & WIDE else "<u2")
    ids = np.frombuffer(data, kind, (size - HEADER.size) // kind.itemsize, start + HEADER.size)
    return None if flags & NO_ID else doc_id, ids.astype("<u4")


class Batches:
    """Rows ``doc_id, start, ids`` put together until they have ``BATCH_BYTES`` of ids."""

    def __init__(self) -> None:
        self.rows: list[tuple[int | None, int, bytes]] = []
        self.size = 0

    def add(self, doc_id: int | None, start: int, ids: np.ndarray) -> bool:
        self.rows.append((doc_id, start, ids.tobytes()))
        self.size += 4 * len(ids) + 16
        return self.size >= BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 3
        self.rows, self.size = [], 0
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "ids"])


RECORDS = "doc_id long, start long, ids binary"


def read_records(files: DataFrame) -> DataFrame:
    """The records of ``files(path, start)`` as ``doc_id, start, ids``; every checksum is verified.

    ``start`` counts the ids of all records before; ``ids`` are little-endian unsigned 32-bit numbers
    (:func:`id_list` makes an array of them). A file is one task's work, or several small ones are where ``files`` has their
    ``bytes``; it is read in blocks of 4 MB, or of a record if that is longer.

    Defined results: no files give no rows, an empty file none; a null path is passed over; a missing file or a
    record that does not fit its checksums or its file fails the task.
    """
    listed = files.where("path is not null").select("path", F.col("start").cast("long"))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = Batches()
        for part in parts:
            for path, start in zip(*(c.to_pylist() for c in part.columns)):
                store, inside = filesystem(path)
                with store.open_input_stream(inside) as file:
                    rest, offset, need = b"", 0, 12
                    while data := file.read(max(BLOCK, need)):
                        data = rest + data
                        starts, sizes = parse(data, path, offset)
                        for a, size in zip(starts, sizes):
                            doc_id, ids = payload(data, a, size)
                            full = batch.add(doc_id, start, ids)
                            start += len(ids)
                            if full:
                                yield batch.take()
                        used = starts[-1] + sizes[-1] + 4 if starts else 0
                        rest, offset = data[used:], offset + used
                        need = 16 + int.from_bytes(rest[:8], "little") - len(rest) if len(rest) >= 12 else 12
                    if rest:
                        raise Corrupt(f"{path}: ends inside the record at {offset}")
        yield batch.take()

    return listed.repartition(reading_tasks(files)).mapInArrow(read, RECORDS)


def reading_tasks(files: DataFrame) -> int:
    """A task per file, but fewer where the files have less than ``BLOCK`` bytes each: a task's own costs, and its file of results, are then the larger part."""
    size = F.sum("bytes") if "bytes" in files.columns else F.lit(None)
    n, size = files.agg(F.count(F.lit(1)), size).first()
    return max(1, n if size is None else min(n, -(-int(size) // BLOCK)))


def read_index(files: DataFrame) -> DataFrame:
    """``path, offset, size, start`` per record, from the index files."""
    listed = files.where("path is not null").select("path", F.col("start").cast("long"))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, start in zip(*(c.to_pylist() for c in part.columns)):
                store, inside = filesystem(f"{path}.idx")
                with store.open_input_stream(inside) as file:
                    pairs = np.frombuffer(file.read(), "<u8").astype(np.int64).reshape(-1, 2)
                for a in range(0, len(pairs) - 1, 50_000):
                    b = min(a + 50_000, len(pairs) - 1)
                    offset, end = pairs[a:b, 0], pairs[a + 1 : b + 1, 0]
                    columns = [pa.array([path] * (b - a)), pa.array(offset), pa.array(end - offset), pa.array(start + pairs[a:b, 1])]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "offset", "size", "start"])

    return listed.repartition(max(1, files.count())).mapInArrow(read, "path string, offset long, size long, start long")


def read_shuffled(files: DataFrame, seed: int = 3) -> DataFrame:
    """The records of :func:`read_records` in a random order that follows from ``seed``: by partition, then by row.

    Only the entries of the index are shuffled; tasks then read their records one by one at their offsets. Results and
    failures are as of :func:`read_records`.
    """
    key = F.xxhash64(F.lit(seed), "start", "offset")
    entries = read_index(files).withColumn("_key", key).repartitionByRange("_key", "path", "offset")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, opened = Batches(), OrderedDict()
        try:
            for part in parts:
                for path, offset, size, start in zip(*(part.column(n).to_pylist() for n in ("path", "offset", "size", "start"))):
                    if path not in opened:
                        if len(opened) >= OPEN_FILES:
                            opened.popitem(last=False)[1].close()
                        store, inside = filesystem(path)
                        opened[path] = store.open_input_file(inside)
                    opened.move_to_end(path)
                    opened[path].seek(offset)
                    data = opened[path].read(size)
                    starts, sizes = parse(data, path, offset)
                    if len(starts) != 1 or sizes[0] + 16 != size:
                        raise Corrupt(f"{path}: no record of {size} bytes at {offset}")
                    doc_id, ids = payload(data, starts[0], sizes[0])
                    if batch.add(doc_id, start, ids):
                        yield batch.take()
        finally:
            for file in opened.values():
                file.close()
        yield batch.take()

    return entries.sortWithinPartitions("_key", "path", "offset").mapInArrow(read, RECORDS)


def id_list(records: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` with the ids as an array of longs."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = [np.frombuffer(b or b"", "<u4").astype(np.int64) for b in part.column("ids").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), ids], ["doc_id", "start", "ids"])

    return records.select("doc_id", "start", "ids").mapInArrow(read, "doc_id long, start long, ids array<long>")
