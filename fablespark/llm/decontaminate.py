"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of words of which a fixed mask reads five and ignores the rest, so two windows
that differ only at ignored positions still hash alike. The masks are so short and so many that a
pair at the least share of equal words still has a seed in common more than nine times in ten,
whatever the item's length; the tests measure that against brute force.
The hashes of all seeds of the test items meet the seeds of every training document; around each
hit the item is laid along the document at the hit's shift and at up to SLIDE words on either side,
and all its words are compared. The item words found are those equal at the best shift and those in
dense stretches of equal words at any other, so words put in or left out do not part a copy. A pair
is a leak when MIN_WORDS item words and MIN_SHARE of the item are found, or, however long the item,
a passage of it of which the words found less twice the words missed reach PASSAGE. Items too short
for a mask are one seed over all their words, with no ignored position.

Test items are few: they are hashed in slices of at most SLICE_SEEDS seeds, and one slice at a time
is sent to the executors (16 bytes a seed and 8 a word, with a table of BITS bits), so the documents
need no shuffle and memory stays bounded; more items make more passes over the documents.

Words are runs of bytes other than white space, lower-cased in A-Z, with ASCII punctuation dropped.

Edge cases: null or empty texts (documents or items) leak nothing and match nothing; equal items
are each reported; repeated document rows give repeated pairs; null ids are kept as null; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bounded, in_arrow, staged

# 1 reads a word, 0 ignores it.
MASKS = ("11111", "101111", "110111", "1100111", "1101011", "1101101", "101001011", "101010011", "110000111", "110010101", "110100011", "111001001")
SHORTEST = min(map(len, MASKS))
MIN_WORDS = 8
MIN_SHARE = 0.6
PASSAGE = 13
SLIDE, STRETCH, GAP = 3, 4, 2
SLICE_SEEDS = 1 << 21
BITS = 22
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words without ASCII punctuation, and their rows; words of punctuation alone vanish."""
    keep = ~PUNCTUATION[data]
    moved = np.concatenate(([0], np.cumsum(keep)))[offsets]
    return tk.word_hashes(data[keep], moved)


def _seeds(words: np.ndarray, row: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each whole window under one mask."""
    span = len(MASKS[mask])
    if len(words) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[span - 1 :] == row[: len(row) - span + 1])
    x = np.full(len(at), tk.U(mask))
    for j, read in enumerate(MASKS[mask]):
        if read == "1":
            x += words[at + j] * tk.TERMS[j]
    return tk.mix(x), at


def _short(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each window of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
    x = np.full(len(at), tk.U(1000 + n))
    for j in range(n):
        x += words[at + j] * tk.TERMS[j]
    return tk.mix(x), at


def _dense(equal: np.ndarray) -> np.ndarray:
    """The equal positions in stretches without more than GAP misses in a row, of STRETCH equal words and MIN_SHARE at least."""
    at = np.flatnonzero(equal)
    out = np.zeros(len(equal), bool)
    if len(at) >= STRETCH:
        for part in np.split(at, np.flatnonzero(np.diff(at) > GAP + 1) + 1):
            if len(part) >= STRETCH and len(part) >= MIN_SHARE * (part[-1] - part[0] + 1):
                out[part] = True
    return out


def _passage(found: np.ndarray) -> int:
    """The most that words found less twice the words missed reach in a passage."""
    sums = np.concatenate(([0], np.cumsum(np.where(found, 1, -2))))
    return int((sums - np.minimum.accumulate(sums)).max())


class Slice:
    """Seeds of some items: sorted hashes with item and position, and the items' words."""

    def __init__(self, ids: list, texts: list):
        data, offsets = tk.text_bytes(pa.array(texts, pa.string()))
        self.ids = ids
        self.words, row = _words(data, offsets)
        n = np.bincount(row, minlength=len(ids))
        self.bounds = np.concatenate(([0], np.cumsum(n)))
        parts = [_seeds(self.words, row, m) for m in range(len(MASKS))]
        self.sizes = sorted({int(x) for x in n if 0 < x < SHORTEST})
        for size in self.sizes:
            hashes, at = _short(self.words, row, size)
            whole = n[row[at]] == size
            parts.append((hashes[whole], at[whole]))
        hashes, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at, self.item = hashes[order], at[order], row[at[order]]
        self.table = np.zeros(1 << BITS, bool)
        self.table[self.hashes >> tk.U(64 - BITS)] = True

    def hits(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of the document, seed) for every equal hash."""
        maybe = np.flatnonzero(self.table[hashes >> tk.U(64 - BITS)])
        hashes, at = hashes[maybe], at[maybe]
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = high - low
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), np.repeat(low, n) + within

    def leaks(self, words: np.ndarray, row: np.ndarray, rows: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, item words found, words of the item, first word in the row of the best shift) of each leak."""
        found = [self.hits(*_seeds(words, row, m)) for m in range(len(MASKS))] + [self.hits(*_short(words, row, n)) for n in self.sizes]
        at, seed = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(at):
            return
        first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
        # One candidate for each row, item and shift, however many seeds met there.
        where, item = row[at], self.item[seed]
        shift = at - (self.at[seed] - self.bounds[item])
        tried: dict[tuple[int, int], set[int]] = {}
        for r, i, s in np.unique(np.stack((where, item, shift)), axis=1).T.tolist():
            tried.setdefault((r, i), set()).update(range(s - SLIDE, s + SLIDE + 1))
        for (r, i), shifts in tried.items():
            own = self.words[self.bounds[i] : self.bounds[i + 1]]
            n, (start, end) = len(own), first[r : r + 2].tolist()
            best, most, found = (0, 0), np.zeros(n, bool), np.zeros(n, bool)
            for s in shifts:
                low, high = max(s, start), min(s + n, end)
                if low >= high:
                    continue
                equal = np.zeros(n, bool)
                equal[low - s : high - s] = words[low:high] == own[low - s : high - s]
                found |= _dense(equal)
                if (rank := (int(equal.sum()), start - low)) > best:
                    best, most = rank, equal
            found |= most
            total = int(found.sum())
            if (total >= min(MIN_WORDS, n) and total >= MIN_SHARE * n) or _passage(found) >= PASSAGE:
                yield r, i, total, n, -best[1]


def slices(items: DataFrame) -> Iterator[Slice]:
    """All test items in slices of at most SLICE_SEEDS seeds; only one is on the driver at a time."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1] or "")
        size += len(MASKS) * (len(texts[-1].split()) + 1)
        if size >= SLICE_SEEDS:
            yield Slice(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Slice(ids, texts)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaked pairs: doc_id, item_id, n_equal, n_words, first_word; one row for each document and item."""
    spark = bounded(docs).sparkSession
    schema = "doc_id long, item_id long, n_equal long, n_words long, first_word long"
    out = spark.createDataFrame([], schema)
    for part in slices(items.select(F.col("item_id").cast("long"), "text")):
        sent = spark.sparkContext.broadcast(part)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                found = []
                for a, b, data, offsets in tk.chunks(batch.column(1)):
                    words, row = _words(data, offsets)
                    for r, i, equal, n, first in items.leaks(words, row, b - a):
                        found.append((batch.column(0)[a + r].as_py(), items.ids[i], equal, n, first))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(5)], ["doc_id", "item_id", "n_equal", "n_words", "first_word"])

        out = out.union(docs.select(F.col("doc_id").cast("long"), "text").transform(in_arrow, scan, schema))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs, with all their columns, without the documents that leak an item; one without doc_id is judged by no id and stays."""
    leaked = staged(leaks(docs, items).select("doc_id").distinct(), "leaks")
    return docs.alias("own").join(leaked.alias("leaked"), F.col("own.doc_id") == F.col("leaked.doc_id"), "left_anti").select("own.*")
