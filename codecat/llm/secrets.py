"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a long run of token characters. Its character class (hexadecimal,
letters and digits, or Base64) sets the window and the least Shannon entropy. The
window slides by one character, and only two counts change with each step, so a
candidate costs time in proportion to its length. The union of neighbouring windows
above the limit is a span, unless an allow-list pattern matches the candidate. Where
pattern spans overlap a candidate, each piece of it that they leave is a candidate.

Every text is scanned by itself, so rows never move. Spans are in code points, the
end exclusive.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of spans in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JOINTS = "/_=-"
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one alphabet: the window in characters and the least entropy in bits per character."""

    name: str
    alphabet: re.Pattern[str]
    window: int
    least: float


#: The narrowest class that holds a candidate counts. A window of 16 random hexadecimal digits has about
#: 3.3 bits per character, one of 20 random letters and digits about 4.1, and one of 250 less than 3.6; words have 3.5 at most.
CLASSES = (
    CharacterClass("hex", re.compile(r"[0-9A-Fa-f]+"), 16, 3.0),
    CharacterClass("alnum", re.compile(r"[0-9A-Za-z]+"), 20, 3.6),
    CharacterClass("base64", re.compile(r"[0-9A-Za-z+/_=-]+"), 20, 3.6),
)
#: A candidate is as long as the smallest window, at least.
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{min(c.window for c in CLASSES)},}}")
#: Candidates that are no secrets: words and their compounds, numbers, identifiers in the UUID form,
#: lower-case paths and slugs of short parts, and what has such a word inside it (one that stands by itself, as in a path, hides nothing else).
ALLOWED = (
    r"[A-Za-z_=/+-]*",
    r"[0-9_=/+-]*",
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"[0-9a-z]{1,12}([/_-][0-9a-z]{1,12})+",
    r".*(?i:[0-9a-z+](?:example|placeholder|dummy)|(?:example|placeholder|dummy)[0-9a-z+]).*",
)


def window_entropies(text: str, width: int) -> Iterator[float]:
    """Entropy in bits of each window of ``width`` characters, by incremental counts."""
    counts: dict[str, int] = {}
    logs = [0.0, *(c * math.log2(c) for c in range(1, width + 1))]
    weighted = 0.0  # sum of c * log2(c) over the counts
    for i, new in enumerate(text):
        if i >= width:
            old = text[i - width]
            c = counts[old]
            counts[old] = c - 1
            weighted += logs[c - 1] - logs[c]
        c = counts.get(new, 0)
        counts[new] = c + 1
        weighted += logs[c + 1] - logs[c]
        if i >= width - 1:
            yield math.log2(width) - weighted / width


def entropy_spans(candidate: str, allowed: Sequence[re.Pattern[str]]) -> list[tuple[int, int]]:
    """Unions of the windows of a candidate that reach the entropy of its class."""
    kind = next(k for k in CLASSES if k.alphabet.fullmatch(candidate))
    if any(a.fullmatch(candidate) for a in allowed):
        return []
    spans: list[tuple[int, int]] = []
    for start, bits in enumerate(window_entropies(candidate, kind.window)):
        if bits >= kind.least:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], start + kind.window)
            else:
                spans.append((start, start + kind.window))
    return spans


def pieces(start: int, end: int, base: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the spans in ``base``, sorted by start, leave of a candidate."""
    for x, y in base:
        if x >= end:
            break
        if start < x:
            yield start, x
        start = max(start, y)
    if start < end:
        yield start, end


def piece_spans(text: str, start: int, end: int, allowed: Sequence[re.Pattern[str]]) -> list[tuple[int, int]]:
    """Entropy spans of a piece, as it is and without the marks that join it to a pattern span.

    Such a mark can hide the class of the piece, and it can also be a character of the secret.
    """
    found = [(start + a, start + b) for a, b in entropy_spans(text[start:end], allowed)]
    bare = text[start:end].strip(_JOINTS)
    if bare and len(bare) < end - start:
        at = text.index(bare, start)
        found += [(at + a, at + b) for a, b in entropy_spans(bare, allowed)]
    spans: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def find_secrets(text: str, allowed: Sequence[re.Pattern[str]]) -> list[tuple[str, int, int]]:
    """All spans of a text as ``kind, start, end``, by start and kind."""
    spans: list[tuple[str, int, int]] = []
    folded = text.lower()
    if any(word in folded for word in _ASSIGN_WORDS):
        spans += (
            ("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGNED
        )
    if "AKIA" in text:
        spans += (("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS)
    spans += (("hex", *m.span()) for m in _HEX.finditer(text))
    base, first = sorted((a, b) for _, a, b in spans), 0
    for m in _CANDIDATE.finditer(text):
        while first < len(base) and base[first][1] <= m.start():
            first += 1
        if first == len(base) or base[first][0] >= m.end():
            spans += (("entropy", m.start() + a, m.start() + b) for a, b in entropy_spans(m.group(), allowed))
        elif not any(a.fullmatch(m.group()) for a in allowed):
            for start, end in pieces(m.start(), m.end(), itertools.islice(base, first, None)):
                spans += (("entropy", a, b) for a, b in piece_spans(text, start, end, allowed))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: Iterable[str] = ALLOWED
) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``spans``, an array of ``kind, start, end``.

    ``allowed`` are regular expressions; a candidate that one of them matches as a whole is no secret.
    They do not touch the pattern kinds.

    Defined results: null and empty texts have no spans; repeated rows each get theirs; null ids are
    handed on; an empty table gives no rows; other columns are not looked at.
    """
    patterns = tuple(allowed)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p, re.DOTALL) for p in patterns]
        for part in parts:
            found = [find_secrets(text.as_py() or "", compiled) for text in part.column(1)]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")
