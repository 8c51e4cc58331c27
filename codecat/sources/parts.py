"""Long files in parts that can be read for facts by themselves.

A part ends with a line. Declarations lie within lines, but for a clause whose name may stand on a later line
than its word; no cut is made after such a word. So the facts of a file follow from those of its parts, in order, and a
cut is never inside a character. Manifests are one value each and come whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import cloudpickle

# Executors need no copy of this package: what runs in tasks is sent along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXPANDED = "archive string, path string, part int, more boolean, content binary, reason string"
_SCHEMA = pa.schema(
    [("archive", pa.string()), ("path", pa.string()), ("part", pa.int32()), ("more", pa.bool_()), ("content", pa.binary()), ("reason", pa.string())]
)
#: Bytes that a task gathers before it hands a batch on.
BATCH_BYTES = 32 << 20
#: A longer file comes in parts of about so many bytes.
PART_BYTES = 64 << 20
#: The most that fits a row. A line or a manifest above that is refused.
MOST_BYTES = 1 << 30
#: Files that are read as one value.
WHOLE = ("package.json",)

#: Words of clauses that may go on in a later line, and what may stand between.
_OPEN, _BLANKS = (b"package", b"module"), b"\t\n\f\r "
#: Bytes before a cut that are looked at.
_BACK = 4096


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), _SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def last_cut(data: bytearray) -> int:
    """The end of the last line after which a cut may be; 0 if there is none."""
    end = len(data)
    while (end := data.rfind(b"\n", 0, end) + 1) > 0:
        before = data[max(0, end - _BACK) : end].rstrip(_BLANKS)
        if before.endswith(_OPEN) or (not before and end > _BACK):
            end -= 1
        else:
            return end
    return 0


def parts_of(file: BinaryIO, path: str) -> Iterator[tuple[int, bool, bytes | None, str | None]]:
    """``part, more, content, reason`` of a file that is read from start to end; one part at least.

    ``more`` says that other parts follow. What does not fit a row ends the file with a reason.
    """
    whole = path.rpartition("/")[2] in WHOLE
    step, held, part = MOST_BYTES if whole else PART_BYTES, bytearray(), 0
    while piece := file.read(step):
        held += piece
        if len(held) <= step:
            continue
        cut = 0 if whole else last_cut(held)
        if cut:
            yield part, True, bytes(held[:cut]), None
            del held[:cut]
            part += 1
        elif len(held) > MOST_BYTES:
            yield part, False, None, "manifest too long" if whole else "line too long"
            return
    yield part, False, bytes(held), None
