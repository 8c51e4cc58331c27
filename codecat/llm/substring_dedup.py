"""Substring dedup by difference-cover anchors.

A word is removed when it lies in a window of ``WINDOW`` words that also starts in
a document with a smaller id. Windows are judged on the input.

1. *Anchors.* Only the windows of ``ANCHOR`` words that start at cover positions
   (``COVER`` modulo ``PERIOD``) are hashed. ``COVER`` is a difference cover: for any
   two alignments there is a shift below ``PERIOD`` at which both are cover positions.
   As ``ANCHOR + PERIOD - 1 == WINDOW``, two equal windows share an anchor at such a shift.
2. *Sharing.* Anchors that occur in two documents are found by one shuffle of hashes.
3. *Extension.* Only windows around a shared anchor are hashed in full, and those that
   a smaller document has, too, are found by a second shuffle of hashes.
4. Documents meet the starts of their removed windows and lose the words below them.

No pairs are made: every step sends each occurrence once. Texts move once (the two
joins by document share their exchange). Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sharing
from .words import Words, inside_text, slices, windows, words_of

WINDOW = 50
#: A perfect difference set: every residue modulo 31 is the difference of two of its elements.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1

_COVERED = np.zeros(PERIOD, bool)
_COVERED[list(COVER)] = True


def _places(words: Words) -> np.ndarray:
    """The position of each word in its text."""
    return np.arange(len(words.starts)) - np.repeat(words.first[:-1], np.diff(words.first))


def anchors(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor occurrences of ``_id, _text`` rows."""
    for part in parts:
        found = []
        for rows in slices(part, "_text"):
            words = words_of(rows.column("_text"))
            place = _places(words)
            hashes = windows(words.hashes(), ANCHOR, seed=2)
            chosen = np.flatnonzero(inside_text(words.first, ANCHOR) & _COVERED[place[: len(hashes)] % PERIOD])
            owner = np.repeat(rows.column("_id").to_numpy(), np.diff(words.first))
            found.append((hashes[chosen], owner[chosen], place[chosen]))
        if found:
            yield from sharing.combined_shared(*(np.concatenate(c) for c in zip(*found)))


def packed(place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A window's start with 16 bits of its hash, by which rows that share an id know their own windows."""
    return (place << 16) | (hashes & np.uint64(0xFFFF)).astype(np.int64)


def candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full windows around the shared anchors of ``_id, _text, _anchors`` rows."""
    for part in parts:
        found = []
        for rows in slices(part, "_text"):
            words = words_of(rows.column("_text"))
            hashes = windows(words.hashes(), WINDOW, seed=3)
            lists = rows.column("_anchors")
            anchor = lists.flatten().to_numpy()
            row = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
            low = np.maximum(anchor - (WINDOW - ANCHOR), 0)
            high = np.minimum(anchor, np.diff(words.first)[row] - WINDOW)
            row, low, high = (x[low <= high] for x in (row, low, high))
            edge = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(edge, words.first[row] + low, 1)
            np.add.at(edge, words.first[row] + high + 1, -1)
            chosen = np.flatnonzero(np.cumsum(edge)[: len(hashes)] > 0)
            owner = np.repeat(rows.column("_id").to_numpy(), np.diff(words.first))
            found.append((hashes[chosen], owner[chosen], packed(_places(words)[chosen], hashes[chosen])))
        if found:
            yield from sharing.combined_later(*(np.concatenate(c) for c in zip(*found)))


def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words below the windows ``_starts`` of ``_id, _text`` rows."""
    for part in parts:
        for rows in slices(part, "_text"):
            texts, starts = rows.column("_text").cast(pa.large_binary()), rows.column("_starts")
            counts, removed, kept = [], [], []
            for i in range(rows.num_rows):
                words = (texts[i].as_py() or b"").split()
                counts.append(len(words))
                if starts[i].is_valid and len(words) >= WINDOW:
                    own = windows(words_of(rows.column("_text").slice(i, 1)).hashes(), WINDOW, seed=3)
                    place = starts[i].values.to_numpy()
                    place = place[(place >> 16) < len(own)]
                    place = place[packed(place >> 16, own[place >> 16]) == place] >> 16
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[place] += 1
                    edge[place + WINDOW] -= 1
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space).

    Defined results: a null text has no words; texts shorter than a window stay whole; a null id is
    neither smaller nor larger than another, so its row stays whole and is no source; rows that repeat
    an id are one document and never remove each other's words; an empty table gives no rows; other
    columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    known = rows.where("_id is not null")
    anchored = (
        sharing.shared(known.mapInArrow(anchors, sharing.SCHEMA))
        .groupBy("owner")
        .agg(F.collect_set("place").alias("_anchors"))
    )
    around = known.join(anchored, F.col("_id") == F.col("owner"), "left").where("_anchors is not null")
    removed = (
        sharing.later(around.select("_id", "_text", "_anchors").mapInArrow(candidates, sharing.SCHEMA))
        .groupBy("owner")
        .agg(F.collect_set("place").alias("_starts"))
    )
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    cleaned = known.join(removed, F.col("_id") == F.col("owner"), "left").select("_id", "_text", "_starts")
    apart = rows.where("_id is null").select("_id", "_text", F.lit(None).cast("array<bigint>").alias("_starts"))
    return cleaned.mapInArrow(cut, schema).unionByName(apart.mapInArrow(cut, schema))
